"""Review capacity: which rows an analyst would see, what that catches, and an illustrative utility table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.values import ratio, review_count
from skyledger.operators.metrics import _stack
from skyledger.operators.ordering import keyed_rank

CAPACITIES = {"0.5%": 0.005, "1%": 0.01, "5%": 0.05, "10%": 0.10}


def review_ranks(df: DataFrame, groups: list[str], score: str = "score", identity: str = "flight_id") -> DataFrame:
    """Rank by score inside each group, ties by id, with the group size. A large day or month is split over tasks."""
    return keyed_rank(df, groups, [(score, True), identity], "review_rank")


def reviewed(fraction: float) -> Column:
    """True for rows inside the capacity of their group."""
    return F.col("review_rank") <= review_count(F.col("review_rank_size"), F.lit(fraction))


def capacity_sums(ranked: DataFrame, keys: list[str], capacities: dict[str, float], label: str = "label") -> DataFrame:
    """Flights, events, reviewed and captured per key and capacity, in one pass over the ranks."""
    y = F.col(label).cast("long")
    aggregates = [F.count("*").alias("flights"), F.sum(y).alias("events")]
    for i, f in enumerate(capacities.values()):
        aggregates += [F.sum(reviewed(f).cast("long")).alias(f"_r{i}"), F.sum(F.when(reviewed(f), y).otherwise(0)).alias(f"_c{i}")]
    wide = ranked.groupBy(*keys).agg(*aggregates) if keys else ranked.agg(*aggregates)
    return _stack(wide, keys, [{
        "capacity": F.lit(n), "fraction": F.lit(f), "flights": F.col("flights"), "events": F.col("events"),
        "reviewed": F.col(f"_r{i}"), "events_captured": F.col(f"_c{i}")} for i, (n, f) in enumerate(capacities.items())])


def review_rates(df: DataFrame) -> DataFrame:
    """False alerts, misses, precision, recall, lift and break-even ratio from the sums."""
    captured, seen, events = F.col("events_captured"), F.col("reviewed"), F.col("events")
    prevalence = events / F.col("flights")
    return df.select(
        "*", prevalence.alias("prevalence"), (seen - captured).alias("false_alerts"), (events - captured).alias("events_missed"),
        ratio(captured, seen).alias("precision"), ratio(captured, events).alias("recall"), ratio(captured / seen, prevalence).alias("lift"),
        F.when(captured > 0, (seen - captured) / captured).otherwise(F.lit(float("inf"))).alias("break_even_ratio"))


def review_capacity(df: DataFrame, schemes: dict[str, list[str]], capacities: dict[str, float] = CAPACITIES) -> DataFrame:
    """One row per scheme (whole period, by month, by day) and capacity."""
    out = None
    for name, groups in schemes.items():
        part = capacity_sums(review_ranks(df, groups), [], capacities).withColumn("scheme", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return review_rates(out)


def utility(capacity: DataFrame, ratios: list[float], false_alert_weight: float = 1.0) -> DataFrame:
    """Penalty reduction for every assumed miss-to-false-alert ratio, against a random review of the same size."""
    if false_alert_weight <= 0 or min(ratios) <= 0:
        raise ValueError("weights and ratios must be positive")
    long = capacity.select("*", F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("miss_ratio"))
    w = F.lit(float(false_alert_weight))
    by_chance = F.col("reviewed") * F.col("prevalence")
    net = F.col("miss_ratio") * w * F.col("events_captured") - w * F.col("false_alerts")
    random = F.col("miss_ratio") * w * by_chance - w * (F.col("reviewed") - by_chance)
    return long.select("scheme", "capacity", "miss_ratio", "reviewed", "events_captured", "false_alerts", net.alias("net_reduction"),
                       random.alias("random_reduction"), (net - random).alias("advantage_over_random"), (net > 0).alias("pays_off"))
