"""All registered queries and the SQL that states their expected result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyledger.session import prepare

AREAS = ("clocks", "checks", "cohorts", "disruption", "history", "sequences", "networks", "recovery",
         "evaluation", "calibration", "learning", "streams", "pasts", "rotations")


def _modules():
    for area in AREAS:
        yield importlib.import_module(f"skyledger.plans.{area}")


def _pinned(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(prepare(spark), folder)

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _modules():
        for key, build in module.QUERIES.items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = _pinned(build)
    return found


def all_sql() -> dict[str, str]:
    return {key: sql for module in _modules() for key, sql in module.SQL.items()}
