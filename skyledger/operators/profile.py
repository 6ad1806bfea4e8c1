"""Audits of a raw table: missing values, categories, numbers, dates, coverage, null rates, unseen levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.values import ratio
from skyledger.operators.ordering import exact_quantiles


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null or blank rows per column, in one pass over the table."""
    blank = [F.sum((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("long")).alias(c) for c in columns]
    row = df.agg(F.count("*").alias("_rows"), *blank)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns]))
    return row.select("_rows", pairs.alias("p")).select(
        "p.column_name", F.col("_rows").alias("rows"), F.col("p.missing").alias("missing_rows"),
        (ratio(F.col("p.missing"), F.col("_rows")) * 100).alias("missing_pct"))


def categorical(df: DataFrame, columns: list[str], top: int) -> DataFrame:
    """Distinct levels, missing rows and the ``top`` levels per column. Columns are stacked, then counted once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in columns]))
    counts = df.select(pairs.alias("p")).groupBy("p.column_name", "p.level").agg(F.count("*").alias("rows"))
    summary = counts.groupBy("column_name").agg(
        F.count("level").alias("distinct_levels"), F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("rows"))), F.lit(0)).alias("missing_rows"))
    order = Window.partitionBy("column_name").orderBy(F.desc("rows"), "level")
    ranked = counts.where(F.col("level").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(summary, "column_name").select("column_name", "rank", "level", "rows", "distinct_levels", "missing_rows")


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, range, mean and exact median per column. Medians come from value counts in order, so no task holds a column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(pairs.alias("p")).select("p.column_name", "p.value")
    row = long.groupBy("column_name").agg(F.count("value").alias("non_missing"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"))
    return row.join(exact_quantiles(long, ["column_name"], "value", {"median_value": 0.5}), "column_name", "left")


def date_coverage(df: DataFrame, day: str) -> DataFrame:
    """Per year: rows, distinct days, first and last day, and missing days inside the span."""
    return df.groupBy(F.year(day).alias("year")).agg(
        F.count("*").alias("rows"), F.countDistinct(day).alias("days"), F.min(day).alias("_a"), F.max(day).alias("_b"),
    ).select("year", "rows", "days", F.col("_a").cast("string").alias("first_day"), F.col("_b").cast("string").alias("last_day"),
             (F.datediff("_b", "_a") + 1 - F.col("days")).alias("missing_days"))


def airport_coverage(df: DataFrame) -> DataFrame:
    """Origin and destination rows per airport, total, and the city of the smallest id."""
    roles = F.explode(F.array(
        F.struct(F.lit(1).alias("o"), F.lit(0).alias("d"), F.col("origin").alias("airport"), F.col("origin_city").alias("city")),
        F.struct(F.lit(0).alias("o"), F.lit(1).alias("d"), F.col("destination").alias("airport"), F.col("destination_city").alias("city"))))
    return df.select("flight_id", roles.alias("r")).groupBy("r.airport").agg(
        F.sum("r.o").alias("origin_rows"), F.sum("r.d").alias("destination_rows"), F.count("*").alias("total_rows"),
        F.min_by("r.city", "flight_id").alias("first_city"))


def code_mapping(df: DataFrame, left: str, right: str) -> DataFrame:
    """Observed pairs of two code systems and whether the mapping is one to one."""
    pairs = df.groupBy(left, right).agg(F.count("*").alias("rows"))
    rights = pairs.groupBy(left).agg(F.count("*").alias("rights_per_left"))
    lefts = pairs.groupBy(right).agg(F.count("*").alias("lefts_per_right"))
    status = (
        F.when((F.col("rights_per_left") == 1) & (F.col("lefts_per_right") == 1), "one_to_one")
        .when(F.col("lefts_per_right") > 1, "several_left_codes").when(F.col("rights_per_left") > 1, "several_right_codes").otherwise("review"))
    return pairs.join(rights, left).join(lefts, right).select(left, right, "rows", "rights_per_left", "lefts_per_right", status.alias("mapping_status"))


def entity_coverage(df: DataFrame) -> DataFrame:
    """Per regime and role: distinct entities and appearances, for carriers, airports by role and routes."""
    roles = F.explode(F.array(*[F.struct(F.lit(n).alias("role"), F.col(c).alias("entity")) for n, c in
                                (("carrier", "carrier"), ("origin", "origin"), ("destination", "destination"), ("route", "route"))]))
    counts = df.select("regime", roles.alias("r")).groupBy("regime", "r.role", "r.entity").agg(F.count("*").alias("n"))
    return counts.groupBy("regime", "role").agg(F.count("*").alias("entities"), F.sum("n").alias("appearances"))


def null_rates(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Null rows and rate per feature and split, from one grouped pass."""
    counts = df.groupBy(by).agg(F.count("*").alias("rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("nulls")) for c in columns]))
    return counts.select(by, "rows", pairs.alias("p")).select(
        by, "p.feature", "rows", F.col("p.nulls").alias("null_rows"), ratio(F.col("p.nulls"), F.col("rows")).alias("null_rate"))


def unseen_levels(fit: DataFrame, other: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Per feature and split: levels and rows whose level never occurs in the fit rows."""
    def stacked(df: DataFrame, *extra: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in columns]))
        return df.select(*extra, pairs.alias("p")).select(*extra, "p.feature", "p.level")

    known = stacked(fit).distinct().withColumn("_known", F.lit(1))
    counts = stacked(other, by).groupBy(by, "feature", "level").agg(F.count("*").alias("n"))
    marked = counts.join(known, ["feature", "level"], "left")
    unseen = F.col("_known").isNull()
    return marked.groupBy(by, "feature").agg(
        F.sum("n").alias("rows"), F.sum(unseen.cast("long")).alias("unseen_levels"), F.coalesce(F.sum(F.when(unseen, F.col("n"))), F.lit(0)).alias("unseen_rows"))


def value_histogram(df: DataFrame, keys: list[str], value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bucket; 0 and bins + 1 hold values outside the range."""
    return df.select(*keys, F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bucket")).groupBy(*keys, "bucket").agg(F.count("*").alias("rows"))


def universe(df: DataFrame, columns: list[str], day: str) -> DataFrame:
    """Distinct values over several columns with the first and last day they occur."""
    return df.select(day, F.explode(F.array(*columns)).alias("entity")).groupBy("entity").agg(
        F.count("*").alias("appearances"), F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"))
