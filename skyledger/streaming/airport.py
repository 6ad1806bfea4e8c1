"""Tumbling airport activity over a stream of departures, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.bins import MAX_ELAPSED, placeable


def activity(df: DataFrame) -> DataFrame:
    """One row per departure and per placeable arrival: ``(event_time, airport, other, role)``.

    Input: ``airport``, ``destination``, ``dep_seconds`` and ``elapsed``.
    """
    arrival = F.col("dep_seconds") + F.rint(F.col("elapsed") * 60).cast("long")
    rows = F.explode(F.array_compact(F.array(
        F.struct(F.lit("departure").alias("role"), F.col("airport").alias("airport"), F.col("destination").alias("other"), F.col("dep_seconds").alias("s")),
        F.when(placeable(F.col("elapsed")), F.struct(F.lit("arrival").alias("role"), F.col("destination").alias("airport"), F.lit("").alias("other"), arrival.alias("s"))))))
    return df.select(rows.alias("r")).select(F.timestamp_seconds("r.s").alias("event_time"), "r.airport", "r.other", "r.role")


def windowed_counts(events: DataFrame, width: str = "3 hours", lateness_hours: int = 1) -> DataFrame:
    """Rows per (window, airport, other, role), sent again whenever they change (update mode).

    An arrival lies up to the longest flight after its departure, so it may push the largest event time that far ahead
    of the departures that are still to come. The watermark therefore trails by the longest flight and the lateness
    allowed: a departure no later than that behind the latest one is never dropped, whatever the batches are. Keeping
    the other end in the key makes the later distinct count exact."""
    delay = f"{lateness_hours * 60 + int(MAX_ELAPSED)} minutes"
    return (events.withWatermark("event_time", delay).groupBy(F.window("event_time", width), "airport", "other", "role")
            .agg(F.count("*").alias("n")).select(F.unix_timestamp(F.col("window.start")).alias("bin_start"), "airport", "other", "role", "n"))


def latest_counts(updates: DataFrame) -> DataFrame:
    """The last state of every key in a table of updates, open windows included; counts only grow."""
    return updates.groupBy("bin_start", "airport", "other", "role").agg(F.max("n").alias("n"))


def bin_table(counts: DataFrame) -> DataFrame:
    """Departures, arrivals and distinct destinations per (bin start, airport) from the latest counts."""
    departure = F.col("role") == "departure"
    return counts.groupBy("bin_start", "airport").agg(
        F.sum(F.when(departure, F.col("n")).otherwise(0)).alias("departures"), F.sum(F.when(~departure, F.col("n")).otherwise(0)).alias("arrivals"),
        F.sum(departure.cast("long")).alias("distinct_destinations"))
