"""Plan checks and leakage checks: what must hold at any data size."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skyledger.operators import history as H
from skyledger.plans import registry

FOLDER = "/root/testdata/sf0.001"
PACKAGE = Path(__file__).resolve().parents[1] / "skyledger"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["monthly_disruption", "entity_disruption", "airport_role_disruption", "local_to_utc", "missingness_profile", "degree_metrics", "airport_bins", "entity_days"])
def test_no_product_join_and_no_single_task_window(spark, key):
    text = plan(registry.all_queries()[key](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if "Window" in text:
        assert "SinglePartition" not in text


def test_scan_is_pruned(spark):
    text = plan(registry.all_queries()["date_coverage"](spark, FOLDER))
    scans = re.findall(r"ReadSchema: (struct<[^\n]*>)", text) or re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert scans and not any("l_extendedprice" in s or "l_tax" in s or "o_totalprice" in s for s in scans)


def test_no_local_checkpoint_and_no_driver_frames():
    for path in PACKAGE.rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and ".toPandas(" not in text and "crossJoin" not in text, path


def test_future_rows_do_not_change_history(spark):
    def rows(extra):
        data = [(f"f{i}", 1546300800 + i * 86400 * 9, "c", "A" if i % 2 else "B", "C") for i in range(14)] + extra
        df = spark.createDataFrame(data, "flight_id string, departure_utc long, carrier string, origin string, destination string")
        df = df.select("*", (F.col("departure_utc") - 7200).alias("prediction_utc"), F.concat_ws("-", "origin", "destination").alias("route"))
        out = H.prior_month_degrees(H.prior_month_counts(df, {"prior_carrier": "carrier", "prior_origin": "origin"}).drop("history_month"))
        return {r["flight_id"]: (r["prior_carrier"], r["prior_origin"], r["prior_out_degree"], r["prior_weighted_in"]) for r in out.collect()}

    before = rows([])
    after = rows([("late", 1546300800 + 86400 * 400, "c", "A", "C")])
    assert {k: after[k] for k in before} == before
