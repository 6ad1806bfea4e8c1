"""Queries over the legs of one aircraft and over rolling route graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import rolling as G
from skyledger.operators import rotations as R
from skyledger.plans.oracle_views import FLIGHTS, div
from skyledger.sources.adapters import flights, spread, table

#: Turnarounds from 20 minutes to three days.
LEAST, MOST = 1200, 3 * 86400
#: Legs from the events: a third of them have one tail, some have none; delays, cancellations and diversions by id.
_DELAY = "CAST(CASE WHEN event_id % 31 = 0 OR event_id % 41 = 0 THEN NULL ELSE event_id * 7919 % 211 - 40 + CASE WHEN event_id % 13 = 0 THEN 150 ELSE 0 END END AS DOUBLE)"
_ELAPSED = "CASE WHEN event_id % 97 = 0 THEN NULL ELSE 30 + event_id * 31 % 240 END"
LEG_RULES = {
    "leg_id": "event_id",
    "tail": "CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN ' ' WHEN user_id % 3 = 0 THEN ' n000 ' ELSE 'N' || lpad(CAST(user_id % 200 AS STRING), 3, '0') END",
    "carrier": "event_type",
    "origin": "CASE WHEN event_id % 71 = 0 THEN NULL ELSE 'A' || CAST(user_id % 2 AS STRING) END",
    "destination": "'A' || CAST((user_id + event_id) % 2 AS STRING)",
    "arr_delay": _DELAY,
    "cancelled": "event_id % 31 = 0",
    "diverted": "event_id % 41 = 0",
    "elapsed": _ELAPSED,
}


def legs(spark, folder):
    """Legs with UTC seconds; a prediction is made two hours before departure."""
    df = spread(table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts"), "event_id")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    df = df.select(*[F.expr(e).alias(n) for n, e in LEG_RULES.items()], second.alias("departure_at"))
    planned = F.col("departure_at") + F.col("elapsed") * 60
    return df.withColumns({"asked_at": F.col("departure_at") - 7200, "planned_arrival_at": planned, "arrived_at": planned + F.col("arr_delay").cast("long") * 60})


def rotation_links(spark, folder):
    return R.rotation_links(legs(spark, folder), LEAST, MOST)


def rotation_coverage(spark, folder):
    """Links of each carrier by status; ids are unique in the events."""
    df = legs(spark, folder)
    links = R.rotation_links(df, LEAST, MOST).join(df.select(F.col("leg_id").alias("of"), "carrier"), F.col("leg_id") == F.col("of"))
    out = R.link_coverage(links, ["carrier"])
    return out.withColumns({c: F.round(c, 9) for c in ("eligible_share", "known_share")})


def rolling_graph(spark, folder):
    """Every airport on every day on which it has a flight, by the 7, 30 and 90 days before."""
    df = flights(spark, folder, "flight_date", "origin", "destination").select("origin", "destination", F.unix_date("flight_date").alias("day"))
    nodes = df.select(F.explode(F.array("origin", "destination")).alias("node"), "day")
    out = G.rolling_graph(df, nodes)
    return out.withColumns({c: F.round(c, 9) for c in ("out_hhi", "in_hhi")})


QUERIES = {f.__name__: f for f in (rotation_links, rotation_coverage, rolling_graph)}

_LINKS = f"""e AS (SELECT {', '.join(f'{x} AS {n}' for n, x in LEG_RULES.items())}, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS departure_at FROM events),
l AS (SELECT * REPLACE (nullif(upper(trim(tail)), '') AS tail), departure_at - 7200 AS asked_at, departure_at + elapsed * 60 AS planned, departure_at + elapsed * 60 + CAST(arr_delay AS BIGINT) * 60 AS arrived_at FROM e),
o AS (SELECT *, coalesce(arrived_at, planned) AS ordered_at FROM l),
p AS (SELECT *, lag(leg_id) OVER w AS p_id, lag(destination) OVER w AS p_destination, lag(arrived_at) OVER w AS p_arrived, lag(arr_delay) OVER w AS p_delay, lag(cancelled) OVER w AS p_cancelled, lag(diverted) OVER w AS p_diverted
  FROM o WHERE tail IS NOT NULL AND ordered_at IS NOT NULL WINDOW w AS (PARTITION BY tail ORDER BY ordered_at, leg_id)),
s AS (SELECT *, departure_at - p_arrived AS turn, CASE WHEN p_id IS NULL THEN 'first_leg' WHEN p_cancelled THEN 'prior_cancelled' WHEN p_diverted THEN 'prior_diverted' WHEN p_arrived IS NULL THEN 'prior_no_arrival'
  WHEN departure_at IS NULL THEN 'no_departure' WHEN p_destination IS NULL OR origin IS NULL THEN 'airport_unknown' WHEN p_destination <> origin THEN 'airport_mismatch' WHEN departure_at < p_arrived THEN 'turnaround_negative'
  WHEN departure_at - p_arrived < {LEAST} THEN 'turnaround_short' WHEN departure_at - p_arrived > {MOST} THEN 'turnaround_long' ELSE 'eligible' END AS link_status FROM p),
c AS (SELECT *, link_status = 'eligible' AS ok, coalesce(arr_delay >= {R.SEVERE}, false) AS severe, sum(CASE WHEN link_status = 'eligible' THEN 0 ELSE 1 END) OVER w AS chain,
  sum(CASE WHEN link_status = 'eligible' AND coalesce(arr_delay >= {R.SEVERE}, false) THEN 0 ELSE 1 END) OVER w AS calm FROM s WINDOW w AS (PARTITION BY tail ORDER BY ordered_at, leg_id)),
links AS (SELECT leg_id, tail, carrier, link_status, CASE WHEN ok THEN p_id END AS prior_leg_id, CASE WHEN ok THEN turn END AS turnaround, ok AND p_arrived <= asked_at AS prior_known,
  CASE WHEN ok AND p_arrived <= asked_at THEN p_delay END AS prior_delay, CASE WHEN ok AND p_arrived <= asked_at THEN p_delay >= {R.SEVERE} END AS prior_severe, CASE WHEN ok AND p_arrived <= asked_at THEN arr_delay - p_delay END AS delay_growth,
  count(*) OVER (PARTITION BY tail, chain ORDER BY ordered_at, leg_id) AS chain_leg, sum(greatest(coalesce(arr_delay, 0), 0)) OVER (PARTITION BY tail, chain ORDER BY ordered_at, leg_id) AS chain_delay,
  sum(CASE WHEN severe THEN 1 ELSE 0 END) OVER (PARTITION BY tail, calm ORDER BY ordered_at, leg_id) AS cascade_depth FROM c
UNION ALL SELECT leg_id, tail, carrier, CASE WHEN tail IS NULL THEN 'no_tail' ELSE 'no_time' END, NULL, NULL, false, NULL, NULL, NULL, NULL, NULL, NULL FROM o WHERE tail IS NULL OR ordered_at IS NULL)"""

_SIDES = ", ".join(
    f"count(DISTINCT other) FILTER (side = '{s}') AS {s}_degree, CAST(coalesce(sum(n) FILTER (side = '{s}'), 0) AS BIGINT) AS {s}_flights, round({div(f'''sum(n * n) FILTER (side = '{s}')''', f'''CAST(sum(n) FILTER (side = '{s}') AS DOUBLE) * sum(n) FILTER (side = '{s}')''')}, 9) AS {s}_hhi"
    for s in ("out", "in"))

SQL = {
    "rotation_links": f"WITH {_LINKS} SELECT * EXCLUDE (carrier) REPLACE (CAST(chain_leg AS BIGINT) AS chain_leg, CAST(cascade_depth AS BIGINT) AS cascade_depth) FROM links",
    "rotation_coverage": f"""WITH {_LINKS} SELECT carrier, count(*) AS legs, count(*) FILTER (link_status NOT IN ('no_tail', 'no_time', 'first_leg')) AS candidate_links, count(*) FILTER (link_status = 'eligible') AS eligible_links,
  count(*) FILTER (prior_known) AS known_links, {', '.join(f"count(*) FILTER (link_status = '{r}') AS {r}" for r in R.REASONS)},
  round({div("count(*) FILTER (link_status = 'eligible')", "count(*)")}, 9) AS eligible_share, round({div("count(*) FILTER (prior_known)", "count(*) FILTER (link_status = 'eligible')")}, 9) AS known_share FROM links GROUP BY carrier""",
    "rolling_graph": f"""WITH {FLIGHTS}, f AS (SELECT origin, destination, CAST(date_diff('day', DATE '1970-01-01', flight_date) AS INT) AS day FROM flights),
x AS (SELECT origin, destination, day, count(*) AS n FROM f WHERE origin IS NOT NULL AND destination IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
s AS (SELECT 'out' AS side, origin AS node, destination AS other, day, n FROM x UNION ALL SELECT 'in', destination, origin, day, n FROM x),
t AS (SELECT DISTINCT unnest([origin, destination]) AS node, day FROM f),
a AS (SELECT t.node, t.day, w.width, s.side, s.other, sum(s.n) AS n FROM t CROSS JOIN (SELECT unnest({list(G.WIDTHS)}) AS width) w
  LEFT JOIN s ON s.node = t.node AND s.day BETWEEN t.day - {max(G.WIDTHS)} AND t.day - 1 AND s.day >= t.day - w.width WHERE t.node IS NOT NULL AND t.day IS NOT NULL GROUP BY ALL)
SELECT node, day, CAST(width AS INT) AS width, {_SIDES}, coalesce(sum(n), 0) > 0 AS has_history FROM a GROUP BY node, day, width""",
}
