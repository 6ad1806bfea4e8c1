"""CSV and Parquet reading with explicit schemas, and checked publishing of result tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.values import normalise_code
from skyledger.operators.schema import require_columns

# Roles of a typed column and the tolerant conversion from text.
CONVERSIONS: dict[str, Callable[[Column], Column]] = {
    "text": lambda c: F.when(F.trim(c) != "", c),
    "code": normalise_code,
    "category": lambda c: F.when(F.trim(c) != "", F.trim(c)),
    "int": lambda c: c.try_cast("long"),
    "double": lambda c: c.try_cast("double"),
    "float": lambda c: c.try_cast("float"),
    "date": lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"),
    "utc": lambda c: F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX")), F.try_to_timestamp(c)),
}


def read_csv_text(spark: SparkSession, path: str, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Every column as text, pruned to ``keep``; casts are done explicitly by the caller."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*(keep or columns))


# The columns of the raw flight file and the names and roles that they get.
RAW_FLIGHT_COLUMNS = {
    "FL_DATE": ("flight_date_local", "date"),
    "AIRLINE": ("airline_name", "category"),
    "AIRLINE_DOT": ("airline_dot_name", "category"),
    "AIRLINE_CODE": ("reporting_airline_code", "code"),
    "DOT_CODE": ("reporting_airline_dot_id", "int"),
    "FL_NUMBER": ("flight_number", "int"),
    "ORIGIN": ("origin_airport", "code"),
    "ORIGIN_CITY": ("origin_city", "category"),
    "DEST": ("destination_airport", "code"),
    "DEST_CITY": ("destination_city", "category"),
    "CRS_DEP_TIME": ("scheduled_departure_time_local_hhmm", "double"),
    "DEP_TIME": ("actual_departure_time_local_hhmm", "double"),
    "DEP_DELAY": ("departure_delay_minutes", "double"),
    "TAXI_OUT": ("taxi_out_minutes", "double"),
    "WHEELS_OFF": ("wheels_off_time_local_hhmm", "double"),
    "WHEELS_ON": ("wheels_on_time_local_hhmm", "double"),
    "TAXI_IN": ("taxi_in_minutes", "double"),
    "CRS_ARR_TIME": ("scheduled_arrival_time_local_hhmm", "double"),
    "ARR_TIME": ("actual_arrival_time_local_hhmm", "double"),
    "ARR_DELAY": ("arrival_delay_minutes", "double"),
    "CANCELLED": ("cancelled_indicator", "double"),
    "CANCELLATION_CODE": ("cancellation_reason_code", "code"),
    "DIVERTED": ("diverted_indicator", "double"),
    "CRS_ELAPSED_TIME": ("scheduled_elapsed_minutes", "double"),
    "ELAPSED_TIME": ("actual_elapsed_minutes", "double"),
    "AIR_TIME": ("air_time_minutes", "double"),
    "DISTANCE": ("distance_miles", "double"),
    "DELAY_DUE_CARRIER": ("delay_due_carrier_minutes", "double"),
    "DELAY_DUE_WEATHER": ("delay_due_weather_minutes", "double"),
    "DELAY_DUE_NAS": ("delay_due_national_air_system_minutes", "double"),
    "DELAY_DUE_SECURITY": ("delay_due_security_minutes", "double"),
    "DELAY_DUE_LATE_AIRCRAFT": ("delay_due_late_aircraft_minutes", "double"),
}


def canonical_flights(raw: DataFrame) -> DataFrame:
    """The raw flight file, all text, under its canonical names and types; a missing column is an error."""
    require_columns(raw, RAW_FLIGHT_COLUMNS, "raw flight file")
    return raw.select(*[CONVERSIONS[role](F.col(c)).alias(name) for c, (name, role) in RAW_FLIGHT_COLUMNS.items()])


def read_csv_typed(spark: SparkSession, path: str, columns: list[str], types: dict[str, str]) -> DataFrame:
    """Columns named in ``types`` (name to role), converted in one projection; unusable values become null."""
    unknown = sorted(set(types.values()) - set(CONVERSIONS))
    if unknown:
        raise ValueError(f"unknown column roles: {unknown}")
    df = read_csv_text(spark, path, columns, list(types))
    return df.select(*[CONVERSIONS[role](F.col(c)).alias(c) for c, role in types.items()])


def read_parquet(spark: SparkSession, path: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """Pruned and filtered scan; both reach the Parquet reader."""
    df = spark.read.parquet(path)
    return (df if where is None else df.where(where)).select(*columns)


def load_dimension(df: DataFrame, key: str, value: str, allowed: dict[str, set[str]] | None = None) -> DataFrame:
    """A small lookup table with normalised unique keys and no missing value, else an error."""
    require_columns(df, [key, value, *(allowed or {})], "dimension")
    for column, values in (allowed or {}).items():
        df = df.where(F.col(column).isin(*sorted(values)))
    clean = df.select(normalise_code(F.col(key)).alias(key), F.when(F.trim(value) != "", F.trim(value)).alias(value))
    bad = clean.agg(F.count("*").alias("n"), F.countDistinct(key).alias("k"), F.count(value).alias("v"), F.count(key).alias("kk")).first()
    if bad["n"] != bad["k"] or bad["v"] != bad["n"] or bad["kk"] != bad["n"]:
        raise ValueError(f"dimension {key} has duplicate or missing entries: {bad.asDict()}")
    return clean


def attach_dimension(df: DataFrame, dimension: DataFrame, key: str, value: str, columns: dict[str, str], fixed_rows: int | None = None) -> DataFrame:
    """Left-join one lookup under several keys, ``{fact column: new column}``, checked many-to-one by the loader.

    ``fixed_rows`` states a known upper bound; within it the lookup is broadcast, otherwise Spark chooses the join.
    """
    small = F.broadcast if fixed_rows is not None and fixed_rows <= 10000 else (lambda x: x)
    for column, out in columns.items():
        renamed = small(dimension.select(F.col(key).alias(column), F.col(value).alias(out)))
        df = df.join(renamed, column, "left")
    return df


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").option("header", True).csv(path)


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Write to a staging folder next to ``path``, check what was written, then rename it into place.

    Readers of ``path`` never see a partly written table, and a failed check leaves the old table untouched.
    """
    spark = df.sparkSession
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    write_parquet(df, staging)
    if check is not None:
        check(spark.read.parquet(staging))
    jvm = spark._jvm
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staging)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    previous = jvm.org.apache.hadoop.fs.Path(f"{path}.previous-{uuid.uuid4().hex}")
    if system.exists(target) and not system.rename(target, previous):
        raise OSError(f"could not move the old table at {path}")
    if not system.rename(source, target):
        raise OSError(f"could not publish {path}")
    if system.exists(previous):
        system.delete(previous, True)
    return spark.read.parquet(path)
