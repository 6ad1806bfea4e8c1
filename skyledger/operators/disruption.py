"""Operational summaries: periods, regimes, hours, entities, routes, lagged association and regime shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import clocks as C
from skyledger.functions.draws import mixed
from skyledger.functions.values import normalise_code, ratio, tolerant_number

SEVERE_MINUTES = 120
COUNTS = ("scheduled", "cancelled_flights", "diverted_flights", "completed", "severe")


def with_outcomes(df: DataFrame, threshold: float = SEVERE_MINUTES) -> DataFrame:
    """0/1 outcome columns and the completed delay, from ``cancelled``, ``diverted`` and ``arr_delay``."""
    work = df.withColumn("_delay", tolerant_number(F.col("arr_delay")))
    done = (F.col("cancelled") == 0) & (F.col("diverted") == 0) & F.col("_delay").isNotNull()
    work = work.withColumn("completed", done.cast("long"))
    return work.select(
        *df.columns, F.lit(1).cast("long").alias("scheduled"),
        (F.col("cancelled") == 1).cast("long").alias("cancelled_flights"), (F.col("diverted") == 1).cast("long").alias("diverted_flights"),
        "completed", ((F.col("completed") == 1) & (F.col("_delay") >= threshold)).cast("long").alias("severe"),
        F.when(F.col("completed") == 1, F.col("_delay")).otherwise(0.0).alias("delay_sum"),
    )


def rates(df: DataFrame) -> DataFrame:
    """Percent rates and mean delay from additive counts."""
    return df.select(
        "*", (ratio(F.col("cancelled_flights"), F.col("scheduled")) * 100).alias("cancellation_pct"),
        (ratio(F.col("diverted_flights"), F.col("scheduled")) * 100).alias("diversion_pct"),
        (ratio(F.col("severe"), F.col("completed")) * 100).alias("severe_pct"),
        ratio(F.col("delay_sum"), F.col("completed")).alias("mean_delay"))


def _totals(*extra: Column) -> list[Column]:
    return [F.sum(c).alias(c) for c in (*COUNTS, "delay_sum")] + list(extra)


def monthly(df: DataFrame) -> DataFrame:
    """Exact additive counts, sums and sums of squares per month, then rates."""
    work = with_outcomes(df).withColumn("month", F.trunc("flight_date", "MM"))
    grouped = work.groupBy("month").agg(*_totals(F.sum(F.col("delay_sum") * F.col("delay_sum")).alias("delay_sq")))
    return rates(grouped)


def regimes(months: DataFrame, regime: Column) -> DataFrame:
    """Roll monthly rows up to regimes; the standard deviation comes from the sums."""
    grouped = months.withColumn("regime", regime).groupBy("regime").agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"), *_totals(F.sum("delay_sq").alias("delay_sq")))
    n = F.col("completed")
    variance = (F.col("delay_sq") - F.col("delay_sum") * F.col("delay_sum") / n) / (n - 1)
    return rates(grouped).withColumn("delay_std", F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))))


def hours(df: DataFrame, regime: Column) -> DataFrame:
    """Per regime and local departure hour; 2400 counts as hour 0, unusable clocks are left out."""
    work = with_outcomes(df).withColumns({"regime": regime, "_min": C.clock_minutes(F.col("dep_hhmm"))})
    hour = C.clock_parts(F.col("_min"))["hour"]
    return rates(work.where(F.col("_min").isNotNull()).groupBy("regime", hour.alias("hour")).agg(*_totals()))


def entities(df: DataFrame, regime: Column) -> DataFrame:
    """Carrier, origin and route summaries stacked as (regime, entity_type, entity). Rows are first reduced to one per
    (regime, carrier, origin, destination), so only that small table is stacked."""
    fine = with_outcomes(df).withColumn("regime", regime).groupBy("regime", "carrier", "origin", "destination").agg(*_totals())
    kinds = F.explode(F.array(
        F.struct(F.lit("carrier").alias("entity_type"), F.col("carrier").alias("entity")),
        F.struct(F.lit("origin").alias("entity_type"), F.col("origin").alias("entity")),
        F.struct(F.lit("route").alias("entity_type"), F.concat_ws("-", "origin", "destination").alias("entity"))))
    stacked = fine.select("regime", kinds.alias("k"), *COUNTS, "delay_sum")
    return rates(stacked.groupBy("regime", "k.entity_type", "k.entity").agg(*_totals()))


def top_entities(summary: DataFrame, minimum: int, top: int = 20) -> DataFrame:
    """Highest severe rate per (regime, type) among entities with enough flights; ties by name."""
    order = Window.partitionBy("regime", "entity_type").orderBy(F.desc("severe_pct"), "entity")
    supported = summary.where((F.col("scheduled") >= minimum) & F.col("severe_pct").isNotNull())
    return supported.withColumn("severe_rank", F.row_number().over(order)).where(F.col("severe_rank") <= top)


def airport_roles(df: DataFrame, regime: Column) -> DataFrame:
    """Per year, airport and role. Routes are reduced first, then counted once for each end."""
    fine = with_outcomes(df).groupBy(F.year("flight_date").alias("year"), regime.alias("regime"), "origin", "destination").agg(*_totals())
    ends = F.explode(F.array(F.struct(F.lit("origin").alias("role"), F.col("origin").alias("airport")),
                             F.struct(F.lit("destination").alias("role"), F.col("destination").alias("airport"))))
    stacked = fine.select("year", "regime", ends.alias("e"), *COUNTS, "delay_sum")
    return rates(stacked.groupBy("year", "regime", "e.airport", "e.role").agg(*_totals()))


def routes_by_period(df: DataFrame, period: str) -> DataFrame:
    """Route outcomes per period with null-safe rates, self-loops and blank ends excluded."""
    valid = df.where(F.col("origin").isNotNull() & F.col("destination").isNotNull() & (F.col("origin") != F.col("destination")) & F.col(period).isNotNull())
    grouped = valid.groupBy(period, "origin", "destination").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return grouped.select("*", ratio(F.col("cancelled_flights"), F.col("scheduled")).alias("cancellation_rate"),
                          ratio(F.col("diverted_flights"), F.col("scheduled")).alias("diversion_rate"),
                          ratio(F.col("severe"), F.col("completed")).alias("severe_rate"))


def route_audit(df: DataFrame, period: str) -> DataFrame:
    """What the route counts leave out: self-loops, blank ends and rows without a period."""
    o, d = normalise_code(F.col("origin")), normalise_code(F.col("destination"))
    blank = o.isNull() | d.isNull()
    return df.agg(F.count("*").alias("rows"), F.sum((~blank & (o == d)).cast("long")).alias("self_loops"), F.sum(blank.cast("long")).alias("blank_ends"),
                  F.sum(F.col(period).isNull().cast("long")).alias("without_period"))


def top_routes(df: DataFrame, regime: Column, top: int = 20) -> DataFrame:
    """Busiest routes per regime with their share; ties by name."""
    counts = df.groupBy(regime.alias("regime"), F.concat_ws("-", "origin", "destination").alias("route")).agg(F.count("*").alias("route_flights"))
    part = Window.partitionBy("regime")
    ranked = counts.withColumns({"regime_flights": F.sum("route_flights").over(part),
                                 "rank": F.row_number().over(part.orderBy(F.desc("route_flights"), "route"))})
    return ranked.where(F.col("rank") <= top).withColumn("route_share_pct", ratio(F.col("route_flights"), F.col("regime_flights")) * 100)


def lagged_pairs(df: DataFrame, entity: str, month: str, min_scheduled: int, min_completed: int) -> DataFrame:
    """Each entity-month next to the same entity one month earlier (equality on month - 1, so gaps are not bridged)."""
    base = df.where(F.col(month).isNotNull() & F.col(entity).isNotNull()).groupBy(entity, month).agg(
        F.sum("scheduled").alias("scheduled"), F.sum("completed").alias("completed"),
        ratio(F.sum("severe"), F.sum("completed")).alias("severe_rate"), ratio(F.sum("cancelled_flights"), F.sum("scheduled")).alias("cancellation_rate"))
    kept = base.where((F.col("scheduled") >= min_scheduled) & (F.col("completed") >= min_completed))
    before = kept.select(entity, (F.col(month) + 1).alias(month), *[F.col(c).alias(f"previous_{c}") for c in kept.columns if c not in (entity, month)])
    return kept.join(before, [entity, month])


def lag_association(pairs: DataFrame, entity: str) -> DataFrame:
    """Pooled and within-entity (demeaned) Pearson correlation, one row per outcome."""
    stacked = pairs.select(entity, F.explode(F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.col(f"previous_{o}_rate").alias("x"), F.col(f"{o}_rate").alias("y")) for o in ("severe", "cancellation")])).alias("p"))
    rows = stacked.select(entity, "p.outcome", "p.x", "p.y")
    part = Window.partitionBy("outcome", entity)
    demeaned = rows.withColumns({"dx": F.col("x") - F.avg("x").over(part), "dy": F.col("y") - F.avg("y").over(part)})
    return demeaned.groupBy("outcome").agg(F.count("*").alias("pairs"), F.countDistinct(entity).alias("entities"),
                                           F.corr("x", "y").alias("pooled_correlation"), F.corr("dx", "dy").alias("within_correlation"))


def regime_shift(months: DataFrame, regime: Column, reference: str, metrics: list[str], permutations: int) -> DataFrame:
    """Monthly means of each regime against the reference: Cohen's d, relative change and a permutation p-value.

    A group holds one value per month, so its values fit a short array; permutations are rows exploded from a
    sequence, each ordering the pooled months by a mixed integer. No join is needed.
    """
    values = months.select(regime.alias("regime"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("v"), F.col("month").alias("month")) for m in metrics])).alias("p"))
    values = values.select("regime", "p.metric", "p.v", "p.month").where(F.col("v").isNotNull())
    stats = values.groupBy("metric", "regime").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("var"),
        F.array_sort(F.collect_list(F.struct("month", "v"))).alias("series"))
    base = stats.where(F.col("regime") == reference).select("metric", F.col("n").alias("n0"), F.col("mean").alias("mean0"),
                                                             F.col("var").alias("var0"), F.col("series").alias("series0"))
    joined = stats.where(F.col("regime") != reference).join(base, "metric")
    pooled_var = ((F.col("n0") - 1) * F.col("var0") + (F.col("n") - 1) * F.col("var")) / (F.col("n0") + F.col("n") - 2)
    joined = joined.select(
        "metric", "regime", "n0", "n", "mean0", "mean", (F.col("mean") - F.col("mean0")).alias("difference"),
        (ratio(F.col("mean") - F.col("mean0"), F.abs("mean0")) * 100).alias("relative_change_pct"),
        F.when(pooled_var > 0, (F.col("mean") - F.col("mean0")) / F.sqrt(pooled_var)).alias("cohens_d"),
        F.transform(F.concat("series0", "series"), lambda s: s["v"]).alias("pooled"))
    replicate = joined.select("metric", "regime", "n0", "n", "difference", "pooled", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("b"))
    keyed = F.array_sort(F.transform("pooled", lambda v, i: F.struct(mixed(F.col("b").cast("long"), i.cast("long")).alias("h"), i.alias("i"), v.alias("v"))))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x["v"])

    replicate = replicate.withColumn("_order", keyed)
    gap = F.abs(total(F.slice("_order", F.col("n0").cast("int") + 1, F.col("n").cast("int"))) / F.col("n")
                - total(F.slice("_order", F.lit(1), F.col("n0").cast("int"))) / F.col("n0"))
    extreme = replicate.groupBy("metric", "regime").agg(F.sum((gap >= F.abs("difference") - 1e-12).cast("long")).alias("extreme"))
    return joined.drop("pooled").join(extreme, ["metric", "regime"]).withColumn(
        "permutation_p", (F.col("extreme") + 1) / F.lit(permutations + 1.0))
