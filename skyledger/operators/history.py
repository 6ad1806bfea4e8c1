"""Past-only features: prior-month counts and route-graph degrees, their check, and fitted encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import clocks as C
from skyledger.functions.values import ratio
from skyledger.operators.attach import attach_row
from skyledger.operators.ordering import exact_quantiles, keyed_rank
from skyledger.session import stage

UNKNOWN_CODE = 0


def entity_months(df: DataFrame, entity: str, month: str = "departure_month") -> DataFrame:
    """Scheduled rows per entity and month number."""
    return df.groupBy(F.coalesce(F.col(entity), F.lit("MISSING")).alias(entity), month).agg(F.count("*").alias("n"))


def _lookup(df: DataFrame, table: DataFrame, entity: str, month: str, values: dict[str, str]) -> DataFrame:
    """Left-join (entity, month) totals; months without rows give 0. The table has one row per entity and month and is
    staged, so Spark broadcasts it or not by its measured size and a small one moves no row of ``df``."""
    keyed = table.select(F.col(entity).alias("_entity"), F.col(month).alias("_month"), *[F.col(v).alias(o) for o, v in values.items()])
    joined = df.join(keyed, (F.coalesce(df[entity], F.lit("MISSING")) == keyed["_entity"]) & (df["_history_month"] == keyed["_month"]), "left")
    return joined.drop("_entity", "_month").withColumns({o: F.coalesce(F.col(o), F.lit(0)).cast("long") for o in values})


def prior_month_counts(df: DataFrame, entities: dict[str, str]) -> DataFrame:
    """Scheduled rows of each entity in the UTC month before the prediction month; ``{output: entity column}``.

    Counts are by departure month, lookups by prediction month minus one, so nothing later than the prediction is read.
    """
    base = df.withColumn("departure_month", C.month_number(F.col("departure_utc")))
    out = df.withColumn("_history_month", C.month_number(F.col("prediction_utc")) - 1)
    for name, entity in entities.items():
        out = _lookup(out, stage(entity_months(base, entity)), entity, "departure_month", {name: "n"})
    return out.withColumnRenamed("_history_month", "history_month")


def monthly_edges(df: DataFrame) -> DataFrame:
    """Directed edges per departure month: scheduled rows per (month, origin, destination), self-loops left out."""
    valid = df.where(F.col("origin").isNotNull() & F.col("destination").isNotNull() & (F.col("origin") != F.col("destination")))
    return valid.groupBy(C.month_number(F.col("departure_utc")).alias("departure_month"), "origin", "destination").agg(F.count("*").alias("weight"))


def prior_month_degrees(df: DataFrame) -> DataFrame:
    """Out-degree and weight of the origin, in-degree and weight of the destination, in the previous month's graph."""
    edges = stage(monthly_edges(df))
    leaving = stage(edges.groupBy("departure_month", "origin").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight")))
    entering = stage(edges.groupBy("departure_month", "destination").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight")))
    out = df.withColumn("_history_month", C.month_number(F.col("prediction_utc")) - 1)
    out = _lookup(out, leaving, "origin", "departure_month", {"prior_out_degree": "degree", "prior_weighted_out": "weight"})
    out = _lookup(out, entering, "destination", "departure_month", {"prior_in_degree": "degree", "prior_weighted_in": "weight"})
    return out.withColumnRenamed("_history_month", "history_month")


def mask_history(df: DataFrame, columns: list[str], available_from: Column) -> DataFrame:
    """Null the history columns of rows before history exists (a count of 0 there means unknown, not none)."""
    early = F.col("departure_utc") < available_from
    return df.withColumns({c: F.when(~early, F.col(c)) for c in columns})


def verify_prior_month(df: DataFrame, checks: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Recompute prior-month features by departure month and compare: ``{stored: (entity, counted column or None)}``.

    Rows of the first month have no history and are reported apart. The stored feature uses the prediction month, so
    rows within the lead of a month edge may differ.
    """
    work = df.withColumn("_m", C.month_number(F.col("departure_utc")))
    first = work.agg(F.min("_m").alias("_first"))
    work = attach_row(work, first)
    out = None
    for stored, (entity, counted) in checks.items():
        source = work if counted is None else work.where(F.col("origin") != F.col("destination"))
        totals = source.groupBy(F.col(entity).alias("_e"), (F.col("_m") + 1).alias("_next")).agg(
            (F.count("*") if counted is None else F.countDistinct(counted)).alias("_n"))
        joined = work.join(totals, (work[entity] == totals["_e"]) & (work["_m"] == totals["_next"]), "left")
        comparable = F.col("_m") > F.col("_first")
        same = F.col(stored) == F.coalesce("_n", F.lit(0))
        row = joined.agg(
            F.lit(stored).alias("feature"), F.sum(comparable.cast("long")).alias("comparable_rows"),
            F.sum((comparable & same).cast("long")).alias("matches"), F.sum((comparable & ~same).cast("long")).alias("mismatches"),
            F.sum((~comparable).cast("long")).alias("first_month_rows"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("mismatch_rate", ratio(F.col("mismatches"), F.col("comparable_rows")))


def vocabulary(fit: DataFrame, columns: list[str], minimum: int) -> DataFrame:
    """Codes 1.. per column for levels with enough fit rows, most frequent first, ties by name.

    Levels are ranked in ranges, so a column may have any number of them.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in columns]))
    counts = fit.select(pairs.alias("p")).groupBy("p.column_name", "p.level").agg(F.count("*").alias("rows"))
    kept = counts.where(F.col("level").isNotNull() & (F.col("rows") >= minimum))
    return keyed_rank(kept, ["column_name"], [("rows", True), "level"], "code").drop("code_size").withColumn("code", F.col("code").cast("int"))


def encode(df: DataFrame, vocab: DataFrame, columns: list[str]) -> DataFrame:
    """Integer code per categorical column; a level outside the vocabulary gets 0."""
    for c in columns:
        codes = vocab.where(F.col("column_name") == c).select(F.col("level").alias(c), F.col("code").alias(f"{c}_code"))
        df = df.join(codes, c, "left").withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(UNKNOWN_CODE)))
    return df


def unknown_report(encoded: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Share of rows with the unknown code per column and role."""
    wide = encoded.groupBy(by).agg(F.count("*").alias("rows"), *[F.sum((F.col(f"{c}_code") == UNKNOWN_CODE).cast("long")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("unknown")) for c in columns]))
    return wide.select(by, "rows", pairs.alias("p")).select(by, "rows", "p.column_name", F.col("p.unknown").alias("unknown_rows"),
                                                            ratio(F.col("p.unknown"), F.col("rows")).alias("unknown_share"))


def numeric_spec(fit: DataFrame, medians: list[str], logged: list[str]) -> DataFrame:
    """One row of medians, and mean and population deviation of log1p after median filling, from fit rows only."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in medians]))
    found = exact_quantiles(fit.select(pairs.alias("p")).select("p.name", "p.value"), ["name"], "value", {"median": 0.5})
    middle = found.agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(f"{c}_median") for c in medians])
    filled = attach_row(fit, middle)
    logs = {c: F.log1p(F.coalesce(F.col(c), F.col(f"{c}_median"))) for c in logged}
    spread = filled.agg(*[x for c, v in logs.items() for x in (
        F.avg(v).alias(f"{c}_log_mean"), F.greatest(F.stddev_pop(v), F.lit(1e-6)).alias(f"{c}_log_std"))])
    return attach_row(middle, spread)


def static_numbers(df: DataFrame, spec: DataFrame) -> DataFrame:
    """Cyclic calendar and clock numbers and standardised log distance and duration, missing ones filled by medians."""
    work = attach_row(df, spec)
    value = {c: F.coalesce(F.col(c), F.col(f"{c}_median")) for c in
             ("departure_month", "departure_day_of_week", "dep_hour", "dep_minute", "arr_hour", "arr_minute", "distance", "sched_elapsed")}
    cycles = {
        "month": C.cyclic(value["departure_month"] - 1.0, 12.0), "weekday": C.cyclic(value["departure_day_of_week"], 7.0),
        "dep": C.cyclic(value["dep_hour"] + value["dep_minute"] / 60.0, 24.0), "arr": C.cyclic(value["arr_hour"] + value["arr_minute"] / 60.0, 24.0)}
    scaled = {f"{c}_z": (F.log1p(value[c]) - F.col(f"{c}_log_mean")) / F.col(f"{c}_log_std") for c in ("distance", "sched_elapsed")}
    return work.select(*df.columns, *[p.alias(f"{n}_{s}") for n, pair in cycles.items() for s, p in zip(("sin", "cos"), pair)],
                       *[v.alias(n) for n, v in scaled.items()])
