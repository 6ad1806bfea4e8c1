"""Registered queries against their SQL on the smallest tables (the slow ones are left to ``tests.compare``)."""

import pytest

from skyledger.plans import registry
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
SLOW = {"refit_check", "contribution_check", "network_exposure", "network_regimes", "centrality_disruption", "yearly_metrics", "pagerank", "components",
        "betweenness", "closeness", "final_report", "verdicts"}


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("key", [k for k in registry.all_sql() if k not in SLOW])
def test_query_matches_sql(spark, connection, key):
    ok, text = compare(registry.all_queries()[key](spark, FOLDER), connection, registry.all_sql()[key])
    assert ok, text


def test_every_sql_has_a_query():
    assert not set(registry.all_sql()) - set(registry.all_queries())
