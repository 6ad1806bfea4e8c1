"""Views that turn the given star-schema tables into schedule-and-outcome data.

``flights`` and ``scored`` come from lineitem, orders, supplier and customer; ``movements`` from events. The
column rules are plain SQL expressions valid in Spark and in ANSI engines, so tests can state the same view.
Dimension joins are left joins that are added only when a selected column needs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONES = ("America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Phoenix", "America/Anchorage",
         "Pacific/Honolulu", "America/Puerto_Rico", "America/Detroit", "America/Boise", "Australia/Sydney")
STANDARD_OFFSET_HOURS = (-5, -6, -7, -8, -7, -9, -10, -4, -5, -7, 10)

_M = "((l_partkey * 37 + l_linenumber * 53) % 1441)"
_SCHED = "(45 + (l_suppkey * 13 + l_partkey) % 300)"
_SHIFT = "(l_suppkey % 11 - 5)"
_FLOWN = f"({_SCHED} + {_SHIFT} + CASE WHEN l_suppkey % 50 = 0 THEN 7 ELSE 0 END)"
_CANCELLED = "(l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity <= 12)"
_DIVERTED = "(l_partkey % 401 = 0)"
_NOISE = "((l_partkey * 7919 + l_suppkey * 104729) % 10007)"


def _pick(values, key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values))
    return f"(CASE {key} % {len(values)} {cases} END)"


def _hhmm(minutes: str) -> str:
    return f"CAST(floor(({minutes}) / 60) * 100 + ({minutes}) % 60 AS DOUBLE)"


def flight_columns(days_between) -> dict[str, tuple[str, str]]:
    """``name -> (needed tables, expression)``; ``days_between(later, earlier)`` is the engine's date difference."""
    offsets = f"({_pick(STANDARD_OFFSET_HOURS, 'c_nationkey')} - {_pick(STANDARD_OFFSET_HOURS, 's_nationkey')})"
    planned = f"(({_M} + {_SCHED} + {offsets} * 60 + 2880) % 1440)"
    days = days_between("CAST(l_shipdate AS DATE)", "CAST(o_orderdate AS DATE)")
    tail = f"CAST((({days} % 997) + 997) % 997 AS BIGINT)"
    shock = "CASE WHEN year(o_orderdate) = 1996 THEN 40 ELSE 0 END"
    raw_delay = f"(floor({tail} * {tail} * {tail} * {tail} / 4000000000.0E0) - 60 + l_suppkey % 18 * 3 + floor({_M} / 72) - {shock})"
    delay = f"CASE WHEN {_CANCELLED} OR {_DIVERTED} OR l_partkey % 883 = 0 THEN NULL ELSE CAST({raw_delay} AS DOUBLE) END"
    flown_from = f"CAST({raw_delay} AS BIGINT)"
    reported = f"(({_M} + {flown_from} - {_SHIFT} + {_FLOWN} + {offsets} * 60 + 14400) % 1440)"
    severe = f"(CASE WHEN {raw_delay} >= 120 THEN 1 ELSE 0 END)"
    return {
        "flight_id": ("", "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)"
                          " || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS BIGINT) AS STRING)"),
        "flight_date": ("o", "CAST(o_orderdate AS DATE)"),
        "carrier": ("", "'C' || lpad(CAST(l_suppkey % 18 AS STRING), 2, '0')"),
        "carrier_code": ("", "' c' || CAST(l_suppkey % 20 AS STRING) || ' '"),
        "origin": ("s", "'N' || lpad(CAST(s_nationkey AS STRING), 2, '0')"),
        "destination": ("oc", "'N' || lpad(CAST(c_nationkey AS STRING), 2, '0')"),
        "origin_zone": ("s", _pick(ZONES, "s_nationkey")),
        "destination_zone": ("oc", _pick(ZONES, "c_nationkey")),
        "origin_city": ("s", "'City ' || CAST(s_nationkey AS STRING)"),
        "destination_city": ("oc", "'City ' || CAST(c_nationkey AS STRING)"),
        "dep_hhmm": ("", f"CASE WHEN l_partkey % 997 = 0 THEN NULL ELSE {_hhmm(_M)} END"),
        "arr_hhmm": ("soc", f"CASE WHEN l_partkey % 499 = 0 THEN NULL WHEN {planned} = 0 AND l_linenumber % 2 = 0 THEN 2400.0 "
                            f"WHEN l_partkey % 211 = 0 THEN {_hhmm('(' + planned + ' + 90) % 1440')} ELSE {_hhmm(planned)} END"),
        "sched_elapsed": ("", f"CASE WHEN l_partkey % 787 = 0 THEN NULL ELSE CAST({_SCHED} AS DOUBLE) END"),
        "distance": ("soc", "CAST(100 + (s_nationkey * 97 + c_nationkey * 31) % 2400 AS DOUBLE)"),
        "flight_number": ("", "l_partkey % 9000"),
        "cancelled": ("", f"CASE WHEN {_CANCELLED} THEN 1.0E0 ELSE 0.0E0 END"),
        "diverted": ("", f"CASE WHEN {_DIVERTED} THEN 1.0E0 ELSE 0.0E0 END"),
        "arr_delay": ("o", delay),
        "dep_delay": ("o", f"CASE WHEN {_CANCELLED} OR {_DIVERTED} THEN NULL ELSE CAST({raw_delay} AS DOUBLE) - {_SHIFT} END"),
        "elapsed": ("", f"CASE WHEN {_CANCELLED} OR {_DIVERTED} THEN NULL ELSE CAST({_FLOWN} AS DOUBLE) END"),
        "reported_arr_hhmm": ("soc", f"CASE WHEN {_CANCELLED} OR {_DIVERTED} OR l_partkey % 499 = 0 THEN NULL ELSE {_hhmm(reported)} END"),
        "score": ("o", f"CAST(({_NOISE} + {severe} * (l_linenumber % 2) * 2500 + 500) AS DOUBLE) / 15000.0E0"),
        "score_alt": ("o", f"CAST((({_NOISE} * 31) % 10007 + {severe} * 1200 + 500) AS DOUBLE) / 15000.0E0"),
        "score_coarse": ("", "CAST(1 + l_suppkey % 18 AS DOUBLE) / 60.0E0"),
    }


def _spark_days(later: str, earlier: str) -> str:
    return f"datediff({later}, {earlier})"


FLIGHT_COLUMNS = flight_columns(_spark_days)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores when a source has fewer splits than cores (one small file); larger sources are left alone.

    Hashing on near-unique keys avoids the sort a round-robin repartition needs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def flights(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The flight view, restricted to ``columns`` (all of them when none are named)."""
    names = columns or tuple(FLIGHT_COLUMNS)
    needed = "".join(FLIGHT_COLUMNS[n][0] for n in names)
    df = spread(table(spark, folder, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber")
    if "o" in needed:
        orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        if "c" in needed:  # the customers meet the orders first, so the lines are shuffled once
            customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
            orders = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
        df = df.join(orders, df.l_orderkey == orders.o_orderkey, "left")
    if "s" in needed:
        supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
        df = df.join(supplier, df.l_suppkey == supplier.s_suppkey, "left")
    return df.select(*[F.expr(FLIGHT_COLUMNS[n][1]).alias(n) for n in names])


MOVEMENT_COLUMNS = {
    "movement_id": "event_id",
    "airport": "'A' || lpad(CAST(user_id % 12 AS STRING), 2, '0')",
    "destination": "'A' || lpad(CAST((user_id * 7 + event_id) % 12 AS STRING), 2, '0')",
    "carrier": "event_type",
    "elapsed": "CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 2000.0E0 ELSE 30.0E0 + floor(value) END",
}


def movements(spark: SparkSession, folder: str) -> DataFrame:
    """Departures with an exact UTC second, from the events table."""
    df = spread(table(spark, folder, "events"), "event_id")
    picked = [F.expr(e).alias(n) for n, e in MOVEMENT_COLUMNS.items()]
    return df.select(*picked, F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("dep_seconds"))


def scored(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Completed flights with a binary label, three scores and their day, month and period."""
    base = ("flight_id", "flight_date", "cancelled", "diverted", "arr_delay", "score", "score_alt", "score_coarse")
    df = flights(spark, folder, *base, *[e for e in extra if e not in base])
    df = df.where((F.col("cancelled") == 0) & (F.col("diverted") == 0) & F.col("arr_delay").isNotNull())
    year = F.year("flight_date")
    return df.select(
        "flight_id", "flight_date", "arr_delay", "score", "score_alt", "score_coarse", *[e for e in extra if e not in base],
        (F.col("arr_delay") >= 120).cast("int").alias("label"),
        F.unix_date("flight_date").alias("day"),
        (year * 12 + F.month("flight_date")).alias("month"),
        F.when(year <= 1999, "development").when(year == 2000, "validation").otherwise("final_test").alias("period"),
    )


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """Airport to region, 25 fixed rows from the nation table."""
    return table(spark, folder, "nation").select(
        F.expr("'N' || lpad(CAST(n_nationkey AS STRING), 2, '0')").alias("airport"),
        F.expr("'R' || CAST(n_regionkey AS STRING)").alias("region"),
    )
