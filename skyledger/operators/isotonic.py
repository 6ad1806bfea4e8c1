"""Isotonic regression of a binary label on a score, fitted block by block and merged on the executors.

Distinct scores with their counts are range-partitioned. Each block pools its neighbours that violate the order; the pools of
``FAN_IN`` neighbouring blocks are then pooled again, and so on until one group is left. That is exact: pools that a part
of the scores has are never split by the whole. A pool is a step between corners of a convex chain through whole points
(rows, positives), and strictly convex chains are short: among n rows with e positives there are some (n * e) ** (1/3) pools at most,
however many distinct scores there are. So a merge is bounded, and nothing is collected by the driver.

The steps are a table. Distinct scores find their step by an as-of match on the score, which is split by ranges, and rows then take
the value of their own score.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.asof import asof_match
from skyledger.operators.ordering import BLOCK, range_blocks
from skyledger.session import stage

FAN_IN = 16
POOL_COLUMNS = "_group long, first double, last double, n long, e long"
STEP_COLUMNS = "first double, last double, value double, next_first double, next_value double"


def pool(rows: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring pools joined until their shares rise strictly. Counts are whole numbers, so equal shares are found exactly."""
    pools: list[list] = []
    for group, first, last, n, e in rows.sort_values("first").itertuples(index=False):
        pools.append([group, first, last, int(n), int(e)])
        while len(pools) > 1 and pools[-2][4] * pools[-1][3] >= pools[-1][4] * pools[-2][3]:
            _, _, last, n, e = pools.pop()
            below = pools[-1]
            below[2:] = [last, below[3] + n, below[4] + e]
    return pd.DataFrame(pools, columns=rows.columns)


def _steps(rows: pd.DataFrame) -> pd.DataFrame:
    out = pool(rows)
    out["value"] = out["e"] / out["n"]
    out["next_first"], out["next_value"] = out["first"].shift(-1), out["value"].shift(-1)
    return out[["first", "last", "value", "next_first", "next_value"]].astype(object).where(lambda x: x.notna(), None)


def fit_steps(df: DataFrame, score: str, label: str) -> DataFrame:
    """The steps of the fit: score range, value, and the next step's first score and value. ``label`` is 0 or 1.

    Rows without score (null or NaN) or label take no part; without any row there is no step.
    """
    x = F.col(score).cast("double")
    usable = df.where(x.isNotNull() & ~F.isnan(x) & F.col(label).isNotNull()).select((x + F.lit(0.0)).alias("first"), F.col(label).cast("long").alias("e"))
    counts = usable.groupBy("first").agg(F.count("*").alias("n"), F.sum("e").alias("e"))
    blocked = range_blocks(counts, [], ["first"])
    pools = blocked.select(F.col(BLOCK).cast("long").alias("_group"), "first", F.col("first").alias("last"), "n", "e")
    groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # no range partitioning makes more blocks
    while groups > 1:
        pools = pools.groupBy("_group").applyInPandas(pool, POOL_COLUMNS).withColumn("_group", F.expr(f"_group div {FAN_IN}"))
        groups = -(-groups // FAN_IN)
    return stage(pools.groupBy("_group").applyInPandas(_steps, STEP_COLUMNS))


def apply_steps(steps: DataFrame, df: DataFrame, score: str, out: str) -> DataFrame:
    """``df`` with the fitted value of each row: a step's value inside it, linear between two steps, the nearest value outside all.

    It is null for a row without score (null or NaN), and for all rows if there is no step.
    """
    x = F.col(score).cast("double") + F.lit(0.0)
    asked = df.select(x.alias("_x")).where("_x is not null and not isnan(_x)").distinct().select(F.lit(0).alias("_all"), F.col("_x").alias("first"))
    observed = steps.select(F.lit(0).alias("_all"), "first", F.lit(0).alias("_tie"), "last", "value", "next_first", "next_value")
    found = asof_match(asked, observed, "_all", "first", "_tie", ["last", "value", "next_first", "next_value"], float("inf"))
    between = F.col("value") + (F.col("next_value") - F.col("value")) * (F.col("first") - F.col("last")) / (F.col("next_first") - F.col("last"))
    lowest = steps.agg(F.min("value")).scalar()
    value = F.when(F.col("value").isNull(), lowest).when((F.col("first") > F.col("last")) & F.col("next_first").isNotNull(), between).otherwise(F.col("value"))
    fitted = stage(found.select(F.col("first").alias("_of_score"), value.alias("_fitted")))
    rows = df.select(F.struct(*df.columns).alias("_row"), x.alias("_x"))
    joined = rows.join(fitted, F.col("_x") == F.col("_of_score"), "left")
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns if c != out], F.col("_fitted").alias(out))
