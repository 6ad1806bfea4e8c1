"""Disruption episodes and their recovery: entity-day rates, episode rules, sensitivity, Kaplan-Meier curves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.values import ratio
from skyledger.operators.disruption import with_outcomes

GAP, LAST_DAY, RECOVERED = "censored_observation_gap", "censored_last_qualifying_day", "two_consecutive_normal_days"


@dataclass(frozen=True)
class Rules:
    """Fixed defaults: 20 completed flights a day, start at 5 percent, normal at 2 percent for 2 days."""

    name: str = "primary"
    minimum: int = 20
    start_rate: float = 0.05
    normal_rate: float = 0.02
    normal_days: int = 2


def sensitivity_rules(base: Rules, minimums: tuple[int, int], start_rate: float, normal_rate: float) -> list[Rules]:
    """The base rules and six one-at-a-time changes."""
    from dataclasses import replace

    return [base, replace(base, name="lower_minimum", minimum=minimums[0]), replace(base, name="higher_minimum", minimum=minimums[1]),
            replace(base, name="higher_start_rate", start_rate=start_rate), replace(base, name="higher_normal_rate", normal_rate=normal_rate),
            replace(base, name="one_normal_day", normal_days=1), replace(base, name="three_normal_days", normal_days=3)]


def entity_days(df: DataFrame, entity: str, before: Column | None = None) -> DataFrame:
    """Completed and severe flights per entity and day, before any minimum is applied."""
    rows = df if before is None else df.where(F.col("flight_date") < before)
    return with_outcomes(rows).groupBy(F.col(entity).alias("entity"), F.unix_date("flight_date").alias("day")).agg(
        F.sum("completed").alias("completed"), F.sum("severe").alias("severe")).withColumn("severe_rate", ratio(F.col("severe"), F.col("completed")))


def qualifying_days(days: DataFrame, rules: list[Rules]) -> DataFrame:
    """Entity-days of every scenario with enough completed flights, from an exploded array of rules."""
    scenarios = F.explode(F.array(*[F.struct(
        F.lit(r.name).alias("scenario"), F.lit(r.minimum).alias("minimum"), F.lit(r.start_rate).alias("start_limit"),
        F.lit(r.normal_rate).alias("normal_limit"), F.lit(r.normal_days).alias("normal_days")) for r in rules]))
    long = days.select("entity", "day", "completed", "severe_rate", scenarios.alias("r")).select("entity", "day", "completed", "severe_rate", "r.*")
    return long.where(F.col("completed") >= F.col("minimum"))


def episodes(days: DataFrame, rules: list[Rules]) -> DataFrame:
    """Disruption episodes per scenario and entity. Thin days are removed first, so they make a gap.

    Days without a gap between them form an island. A day ends an episode if it closes a run of enough normal days; every
    triggering day belongs to the next such day of its island, and the first trigger that belongs to it is the start.
    Triggers before no such day are open until their island ends. An entity has no more days than the calendar.
    """
    if any(r.start_rate <= r.normal_rate for r in rules):
        raise ValueError("the start rate must be above the normal rate")
    entity = Window.partitionBy("scenario", "entity")
    in_time = entity.orderBy("day")
    upto = in_time.rowsBetween(Window.unboundedPreceding, 0)
    broken = F.coalesce((F.col("day") - F.lag("day").over(in_time) > 1).cast("int"), F.lit(0))
    placed = qualifying_days(days, rules).withColumn("broken", broken).withColumn("island", F.sum("broken").over(upto))
    island = Window.partitionBy("scenario", "entity", "island").orderBy("day")
    normal = F.col("severe_rate") <= F.col("normal_limit")
    strained = F.sum(F.when(normal, 0).otherwise(1)).over(island.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("normal", normal).withColumn("strained", strained)
    calm = F.sum(F.col("normal").cast("int")).over(Window.partitionBy("scenario", "entity", "island", "strained").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("calm", calm)
    ending = F.min(F.when(F.col("calm") >= F.col("normal_days"), F.col("day"))).over(island.rowsBetween(1, Window.unboundedFollowing))
    placed = placed.withColumns({"recovery": ending, "island_end": F.max("day").over(island.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "last_day": F.max("day").over(entity)})
    first = placed.where(F.col("severe_rate") >= F.col("start_limit")).groupBy("scenario", "entity", "island", "recovery").agg(
        F.min("day").alias("start_day"), F.min_by("severe_rate", "day").alias("start_rate"), F.first("island_end").alias("island_end"), F.first("last_day").alias("last_day"))
    end = F.coalesce("recovery", "island_end")
    reason = F.when(F.col("recovery").isNotNull(), RECOVERED).when(F.col("island_end") < F.col("last_day"), GAP).otherwise(LAST_DAY)
    return first.select("scenario", "entity", "start_day", end.alias("end_day"), (end - F.col("start_day") + 1).alias("duration_days"),
                        F.col("recovery").isNotNull().cast("int").alias("recovered"), reason.alias("end_reason"), "start_rate")


def sensitivity(days: DataFrame, rules: list[Rules]) -> DataFrame:
    """Per scenario: qualifying days and entities, episodes, recoveries, censored, and the median of observed recoveries."""
    kept = qualifying_days(days, rules).groupBy("scenario").agg(F.count("*").alias("qualifying_days"), F.countDistinct("entity").alias("entities"))
    found = episodes(days, rules).groupBy("scenario").agg(
        F.count("*").alias("episodes"), F.sum(F.col("recovered").cast("long")).alias("recoveries"), F.median(F.when(F.col("recovered") == 1, F.col("duration_days"))).alias("median_observed_days"))
    joined = kept.join(found, "scenario", "left").na.fill(0, ["episodes", "recoveries"])
    return joined.withColumn("censored", F.col("episodes") - F.col("recoveries"))


def episode_checks(table: DataFrame) -> DataFrame:
    """One row of rule violations of an episode table."""
    reason_fits = F.when(F.col("recovered") == 1, F.col("end_reason") == RECOVERED).otherwise(F.col("end_reason").isin(GAP, LAST_DAY))
    repeated = table.groupBy("scenario", "entity", "start_day").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("repeated_starts"))

    def count(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    checks = table.agg(
        F.count("*").alias("episodes"), count(F.col("duration_days") != F.col("end_day") - F.col("start_day") + 1).alias("wrong_duration"),
        count(F.col("duration_days") < 1).alias("non_positive"), count(~F.col("recovered").isin(0, 1)).alias("bad_flag"), count(~reason_fits).alias("wrong_reason"))
    from skyledger.operators.attach import attach_row

    return attach_row(checks, repeated)


def km_curve(df: DataFrame, groups: list[str], duration: str, observed: str) -> DataFrame:
    """Kaplan-Meier steps per group: at risk, events, censored, survival, and Greenwood's variance.

    Rows are reduced to counts per (group, duration) first; the windows then run over distinct durations only.
    """
    counts = df.groupBy(*groups, F.col(duration).alias("t")).agg(F.count("*").alias("n"), F.sum(F.col(observed).cast("long")).alias("d"))
    part = Window.partitionBy(*(groups or [F.lit(1)]))
    risk = F.sum("n").over(part.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0))
    held = counts.withColumn("at_risk", risk)
    upto = part.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    survive = 1 - F.col("d") / F.col("at_risk")
    dead = F.max((F.col("d") == F.col("at_risk")).cast("int")).over(upto) == 1
    logs = F.sum(F.when(survive > 0, F.log(survive)).otherwise(0.0)).over(upto)
    spread = F.sum(F.when(F.col("at_risk") > F.col("d"), F.col("d") / (F.col("at_risk") * (F.col("at_risk") - F.col("d")).cast("double"))).otherwise(0.0)).over(upto)
    return held.select(
        *groups, "t", "at_risk", F.col("d").alias("events"), (F.col("n") - F.col("d")).alias("censored"),
        F.when(dead, 0.0).otherwise(F.exp(logs)).alias("survival"), spread.alias("log_variance"))


def km_intervals(curve: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Log-log confidence bounds from Greenwood's variance; empty where survival is 0 or 1."""
    s = F.col("survival")
    inside = (s > 0) & (s < 1)
    theta = z * F.sqrt("log_variance") / F.log(s)
    return curve.select("*", F.when(inside, F.pow(s, F.exp(-theta))).alias("survival_low"), F.when(inside, F.pow(s, F.exp(theta))).alias("survival_high"))


def km_summary(df: DataFrame, groups: list[str], duration: str, observed: str, reason: str, horizons: tuple[int, ...] = (7, 14)) -> DataFrame:
    """Median, recovered share by each horizon (empty when nobody is followed that long) and censoring per group."""
    curve = km_curve(df, groups, duration, observed)
    steps = curve.groupBy(*groups).agg(
        F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).cast("double").alias("median_days"),
        *[(1 - F.coalesce(F.min(F.when(F.col("t") <= h, F.col("survival"))), F.lit(1.0))).alias(f"_by_{h}") for h in horizons])
    d = F.col(duration)
    counts = df.groupBy(*groups).agg(
        F.count("*").alias("episodes"), F.sum(F.col(observed).cast("long")).alias("recoveries"), F.sum((F.col(reason) == GAP).cast("long")).alias("gap_censored"),
        *[F.sum((d >= h).cast("long")).alias(f"followed_to_{h}") for h in horizons])
    joined = counts.join(steps, groups)
    return joined.select(
        *groups, "episodes", "recoveries", (F.col("episodes") - F.col("recoveries")).alias("censored"), "gap_censored",
        (1 - ratio(F.col("recoveries"), F.col("episodes"))).alias("censoring_fraction"), "median_days", *[f"followed_to_{h}" for h in horizons],
        *[F.when(F.col(f"followed_to_{h}") > 0, F.col(f"_by_{h}")).alias(f"recovered_by_{h}") for h in horizons])
