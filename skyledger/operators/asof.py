"""As-of match: each row gets the latest observation of its station at or before its own time.

Both tables are stacked and range-partitioned on (station, time), so a station with a third of all rows is spread over many
blocks. Inside a block the last observation is carried down the rows; what a block starts with is the last observation of
earlier blocks of the station, read from a table with one row for each (station, block). No row is joined with all
observations of its station, and no observation after the row's time is ever looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators.ordering import BLOCK, range_blocks
from skyledger.session import stage

MATCHED, TOO_OLD, NO_EARLIER, NO_KEY = "matched", "too_old", "no_earlier_observation", "no_station_or_time"
_SEEN = "_observed"


def asof_match(rows: DataFrame, observed: DataFrame, key: str, at: str, tie: str, values: list[str], tolerance: int) -> DataFrame:
    """``rows`` with ``observed_at``, the ``values`` of the matched observation, its ``age`` and a ``match_reason``.

    ``observed`` has the columns ``key``, ``at``, ``tie`` and ``values``; of observations at one time the greatest ``tie`` counts, and
    those without station or time are no observations. An observation older than ``tolerance`` is not matched, its
    age is told. Rows without station or time are kept, without a match.
    """
    seen = observed.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), F.struct(F.col(at).alias("observed_at"), *values).alias(_SEEN))
    whole = F.col(key).isNotNull() & F.col(at).isNotNull()
    asking = rows.where(whole).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    blocked = range_blocks(seen.unionByName(asking, allowMissingColumns=True), ["_key"], ["_at", "_kind", "_tie"])
    order = [F.col("_at"), F.col("_kind"), F.col("_tie")]
    ends = blocked.where("_kind = 0").groupBy("_key", BLOCK).agg(F.max_by(_SEEN, F.struct("_at", "_tie")).alias("_last"))
    # A block without an observation hands on what it got, so every block of a station has a row here.
    every = blocked.select("_key", BLOCK).distinct().join(ends, ["_key", BLOCK], "left")
    earlier = Window.partitionBy("_key").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = stage(every.select(F.col("_key").alias("_of"), F.col(BLOCK).alias("_in"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried")))
    inside = Window.partitionBy("_key", BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = blocked.withColumn("_near", F.last(_SEEN, ignorenulls=True).over(inside)).where("_kind = 1")
    joined = held.join(carried, (F.col("_key") == F.col("_of")) & (F.col(BLOCK) == F.col("_in")), "left").withColumn("_near", F.coalesce("_near", "_carried"))
    age = F.col("_at") - F.col("_near.observed_at")
    reason = F.when(F.col("_near").isNull(), NO_EARLIER).when(age > tolerance, TOO_OLD).otherwise(MATCHED)
    types = seen.schema[_SEEN].dataType

    def value(name: str) -> Column:
        return F.when(reason == MATCHED, F.col(f"_near.{name}")).alias(name)

    found = joined.select("_row.*", value("observed_at"), *[value(v) for v in values], age.alias("age"), reason.alias("match_reason"))
    none = rows.where(~whole).select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in types.fields], F.lit(None).cast(found.schema["age"].dataType).alias("age"), F.lit(NO_KEY).alias("match_reason"))
    return found.unionByName(none)
