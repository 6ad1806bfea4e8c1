"""Queries that look back in time: weather observations as of the prediction time, outcomes known before a day."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import asof as A
from skyledger.operators import outcomes as W
from skyledger.plans.oracle_views import FLIGHTS, MOVEMENTS, div
from skyledger.sources.adapters import flights, movements, table

TOLERANCE = 3 * 3600
_STATION = "'A' || lpad(CAST((user_id * 5 + event_id) % 12 AS STRING), 2, '0')"


def weather_match(spark, folder):
    """The latest observation at a departure's airport two hours before it; one event of three is an observation."""
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    observed = table(spark, folder, "events").where("event_id % 3 = 0").select(F.expr(_STATION).alias("airport"), second.alias("asked_at"), F.col("event_id").alias("tie"), F.col("value").alias("reading"))
    asking = movements(spark, folder).select("movement_id", "airport", (F.col("dep_seconds") - 7200).alias("asked_at"))
    return A.asof_match(asking, observed, "airport", "asked_at", "tie", ["reading"], TOLERANCE)


LEVELS = {"global": [], "carrier": ["carrier"], "origin_airport": ["origin"], "destination_airport": ["destination"]}
_COMPLETED = "cancelled = 0 AND diverted = 0 AND arr_delay IS NOT NULL"


def outcome_history(spark, folder):
    """Outcomes of the 7, 30 and 90 days before; a flight's outcome is known on the day it lands, reckoned from noon, so a late one enters later."""
    df = flights(spark, folder, "flight_date", "carrier", "origin", "destination", "cancelled", "diverted", "arr_delay").withColumn("day", F.unix_date("flight_date"))
    late = F.when(F.expr(_COMPLETED), F.floor((F.greatest(F.col("arr_delay"), F.lit(0.0)) + 720) / 1440)).otherwise(0).cast("int")
    completed = F.when(F.expr(_COMPLETED), 1).otherwise(0)
    outcomes = df.select(
        "carrier", "origin", "destination", "day", (F.col("day") + late).alias("known_day"), F.lit(1).alias("flights"), completed.alias("completed"),
        F.when(completed == 1, (F.col("arr_delay") >= 120).cast("int")).otherwise(0).alias("severe"), F.coalesce(F.col("cancelled").cast("int"), F.lit(0)).alias("cancelled"),
        F.when(completed == 1, F.col("arr_delay").cast("long")).otherwise(0).alias("delay_minutes"))
    rows = W.by_level(outcomes, LEVELS)
    out = W.outcome_windows(rows, rows)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if "rate" in c or c.startswith("mean")})


QUERIES = {f.__name__: f for f in (weather_match, outcome_history)}


def _windowed() -> str:
    out = []
    for w in W.WIDTHS:
        inside = f"FILTER (known_day >= t.day - {w})"
        n = {c: f"coalesce(sum({c}) {inside}, 0)" for c in W.COUNTS}
        out += [f"CAST({n['flights']} AS BIGINT) AS flights_{w}d", f"CAST({n['completed']} AS BIGINT) AS completed_{w}d", f"round({div(n['severe'], n['completed'])}, 9) AS severe_rate_{w}d",
                f"round({div(n['cancelled'], n['flights'])}, 9) AS cancellation_rate_{w}d", f"round({div(n['delay_minutes'], n['completed'])}, 9) AS mean_delay_{w}d", f"{n['flights']} > 0 AS has_history_{w}d"]
    return ", ".join(out)


SQL = {
    "weather_match": f"""WITH {MOVEMENTS}, o AS (SELECT {_STATION} AS airport, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS observed_at, arg_max(value, event_id) AS reading FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2),
p AS (SELECT movement_id, airport, dep_seconds - 7200 AS asked_at FROM movements),
j AS (SELECT p.*, o.observed_at AS seen_at, o.reading AS seen, p.asked_at - o.observed_at AS age FROM p ASOF LEFT JOIN o ON p.airport = o.airport AND p.asked_at >= o.observed_at)
SELECT movement_id, airport, asked_at, CASE WHEN age <= {TOLERANCE} THEN seen_at END AS observed_at, CASE WHEN age <= {TOLERANCE} THEN seen END AS reading, age,
  CASE WHEN seen_at IS NULL THEN 'no_earlier_observation' WHEN age > {TOLERANCE} THEN 'too_old' ELSE 'matched' END AS match_reason FROM j""",
    "outcome_history": f"""WITH {FLIGHTS}, f AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', flight_date) AS INT) AS day, coalesce({_COMPLETED}, false) AS done FROM flights),
r AS (SELECT unnest(['global', 'carrier', 'origin_airport', 'destination_airport']) AS level, unnest(['all', carrier, origin, destination]) AS entity, day,
  day + CASE WHEN done THEN CAST(floor((greatest(arr_delay, 0) + 720) / 1440) AS INT) ELSE 0 END AS known_day, done, arr_delay, cancelled FROM f),
x AS (SELECT level, entity, known_day, count(*) AS flights, count(*) FILTER (done) AS completed, count(*) FILTER (done AND arr_delay >= 120) AS severe, sum(coalesce(CAST(cancelled AS INT), 0)) AS cancelled,
  sum(CASE WHEN done THEN CAST(arr_delay AS BIGINT) ELSE 0 END) AS delay_minutes FROM r WHERE entity IS NOT NULL GROUP BY ALL),
t AS (SELECT DISTINCT level, entity, day FROM r WHERE entity IS NOT NULL AND day IS NOT NULL)
SELECT t.level, t.entity, t.day, {_windowed()} FROM t LEFT JOIN x ON x.level = t.level AND x.entity = t.entity AND x.known_day BETWEEN t.day - {max(W.WIDTHS)} AND t.day - 1 GROUP BY ALL""",
}
