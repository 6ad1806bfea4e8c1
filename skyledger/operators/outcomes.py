"""Past-only outcome windows: what was known about an entity in the days before a flight's own.

An outcome enters on the day on which it is *known*, not on that of its flight, and a window ends on the day before. Outcomes
become one row for each (entity, day) first, so an entity with a third of all flights is as many rows as there are
days. Running totals by day answer every width as the difference of two of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.values import ratio

COUNTS = ("flights", "completed", "severe", "cancelled", "delay_minutes")
WIDTHS = (7, 30, 90)


def by_level(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """A row for each level, with ``level`` and ``entity``: the level's columns joined by ``>``. Rows that lack one of them leave the level."""
    entities = [F.struct(F.lit(name).alias("level"), F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]), F.concat_ws(">", *columns)).alias("entity")) if columns
                else F.struct(F.lit(name).alias("level"), F.lit("all").alias("entity")) for name, columns in levels.items()]
    return df.withColumn("_one", F.explode(F.array(*entities))).select("*", "_one.level", "_one.entity").drop("_one").where("entity is not null")


def outcome_windows(outcomes: DataFrame, targets: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """For each distinct (level, entity, day) of ``targets`` the outcomes known in the ``w`` days before it, for every width.

    ``outcomes`` has level, entity, ``known_day`` and one column for each of ``COUNTS``; an outcome whose day is null never becomes known. Rates
    and the mean delay are null where nothing was known; ``has_history`` says so.
    """
    daily = outcomes.where("known_day is not null").groupBy("level", "entity", F.col("known_day").alias("day")).agg(*[F.sum(c).alias(c) for c in COUNTS])
    asked = targets.select("level", "entity", "day").where("day is not null").distinct().withColumn("_asked", F.lit(1))
    both = daily.unionByName(asked, allowMissingColumns=True).groupBy("level", "entity", "day").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS], F.max("_asked").alias("_asked"))
    order = Window.partitionBy("level", "entity").orderBy("day")

    def upto(column: str, back: int):
        return F.coalesce(F.sum(column).over(order.rangeBetween(Window.unboundedPreceding, -back)), F.lit(0))

    sums = both.select("level", "entity", "day", "_asked", *[(upto(c, 1) - upto(c, w + 1)).alias(f"{c}_{w}d") for w in widths for c in COUNTS]).where("_asked = 1")
    derived = [x for w in widths for x in (
        ratio(F.col(f"severe_{w}d"), F.col(f"completed_{w}d")).alias(f"severe_rate_{w}d"), ratio(F.col(f"cancelled_{w}d"), F.col(f"flights_{w}d")).alias(f"cancellation_rate_{w}d"),
        ratio(F.col(f"delay_minutes_{w}d"), F.col(f"completed_{w}d")).alias(f"mean_delay_{w}d"), (F.col(f"flights_{w}d") > 0).alias(f"has_history_{w}d"))]
    return sums.select("level", "entity", "day", *[f"{c}_{w}d" for w in widths for c in ("flights", "completed")], *derived)
