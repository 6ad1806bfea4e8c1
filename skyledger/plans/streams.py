"""Streaming queries: run over everything available, then read the table they produced."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.plans.oracle_views import MOVEMENTS
from skyledger.sources.adapters import MOVEMENT_COLUMNS
from skyledger.session import scratch_folder
from skyledger.streaming import airport as A
from skyledger.streaming import ingest as I


def stream_ingest_counts(spark, folder):
    """Stream the line items through the cleaning steps into a table, and count what arrived."""
    scratch = scratch_folder(spark)
    stream = I.file_stream(spark, f"{folder}/lineitem*.parquet")
    cleaned = I.clean_stream(stream.withColumn("returned", F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "A", "0").otherwise("n/a")),
                             ["l_returnflag", "l_linestatus"], ["returned"])
    I.run_to_table(cleaned.select("l_returnflag", "l_linestatus", "returned", "l_quantity"), f"{scratch}/table", f"{scratch}/progress")
    return spark.read.parquet(f"{scratch}/table").groupBy("l_returnflag", "l_linestatus", "returned").agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity"))


def stream_airport_bins(spark, folder):
    """Three-hour airport activity of the whole stream, windows that are still open included."""
    scratch = scratch_folder(spark)
    stream = I.file_stream(spark, f"{folder}/events*.parquet")
    moves = stream.select(*[F.expr(e).alias(n) for n, e in MOVEMENT_COLUMNS.items()], F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("dep_seconds"))
    I.run_to_table(A.windowed_counts(A.activity(moves)), f"{scratch}/table", f"{scratch}/progress", "update")
    return A.bin_table(A.latest_counts(spark.read.parquet(f"{scratch}/table")))


QUERIES = {f.__name__: f for f in (stream_ingest_counts, stream_airport_bins)}

SQL = {
    "stream_ingest_counts": """SELECT upper(trim(l_returnflag)) AS l_returnflag, upper(trim(l_linestatus)) AS l_linestatus, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS returned,
count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL""",
    "stream_airport_bins": f"""WITH {MOVEMENTS}, a AS (SELECT dep_seconds AS s, airport, destination AS other, 'departure' AS role FROM movements
UNION ALL SELECT dep_seconds + CAST(round_even(elapsed * 60, 0) AS BIGINT), destination, '', 'arrival' FROM movements WHERE elapsed > 0 AND elapsed <= 1440),
b AS (SELECT CAST(floor(s / 10800.0) AS BIGINT) * 10800 AS bin_start, airport, other, role FROM a)
SELECT bin_start, airport, count(*) FILTER (role = 'departure') AS departures, count(*) FILTER (role = 'arrival') AS arrivals, count(DISTINCT other) FILTER (role = 'departure') AS distinct_destinations FROM b GROUP BY 1, 2""",
}
