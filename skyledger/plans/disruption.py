"""Disruption summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import clocks as C
from skyledger.functions.draws import mixed_sql
from skyledger.operators import disruption as D
from skyledger.operators import labels as L
from skyledger.operators import profile as P
from skyledger.plans.cohorts import _COHORT, _REGIME, cohort_frame
from skyledger.plans.oracle_views import FLIGHTS, div
from skyledger.sources.adapters import flights

OUTCOME = ("flight_date", "cancelled", "diverted", "arr_delay")
PERMUTATIONS = 20_000
METRICS = ["cancellation_pct", "severe_pct", "mean_delay"]


def _regime():
    return L.regime(F.col("flight_date"))


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


RATES = ("cancellation_pct", "diversion_pct", "severe_pct", "mean_delay")


def monthly_disruption(spark, folder):
    df = D.monthly(flights(spark, folder, *OUTCOME))
    return _rounded(df.withColumns({"month": F.date_format("month", "yyyy-MM"), "regime": L.regime(F.col("month"))}), *RATES)


def regime_disruption(spark, folder):
    df = D.regimes(D.monthly(flights(spark, folder, *OUTCOME)), L.regime(F.col("month")))
    df = df.withColumns({c: F.date_format(c, "yyyy-MM") for c in ("first_month", "last_month")})
    return _rounded(df, *RATES, "delay_std")


def hour_disruption(spark, folder):
    return _rounded(D.hours(flights(spark, folder, *OUTCOME, "dep_hhmm"), L.regime(F.col("flight_date"), L.THREE_REGIMES)), *RATES)


def _entities(spark, folder):
    return D.entities(flights(spark, folder, *OUTCOME, "carrier", "origin", "destination"), _regime())


def entity_disruption(spark, folder):
    return _rounded(_entities(spark, folder), *RATES)


def top_entities(spark, folder):
    return D.top_entities(_rounded(_entities(spark, folder), *RATES), 20).select("regime", "entity_type", "entity", "severe_rank", "scheduled", "severe_pct")


def airport_role_disruption(spark, folder):
    return _rounded(D.airport_roles(flights(spark, folder, *OUTCOME, "origin", "destination"), _regime()), *RATES)


def utc_outcomes(spark, folder, *extra):
    """Cohort rows with 0/1 outcomes and the UTC year and month of departure."""
    df = cohort_frame(spark, folder, "origin", "destination", *extra)
    departure = F.col("prediction_utc") + 7200
    return df.select(
        *[c for c in df.columns if c not in ("completed",)], departure.alias("departure_utc"),
        F.year(F.timestamp_seconds(departure)).alias("utc_year"), C.month_number(departure).alias("utc_month"),
        F.lit(1).cast("long").alias("scheduled"), F.col("cancelled_source").cast("long").alias("cancelled_flights"),
        F.col("diverted_source").cast("long").alias("diverted_flights"), F.col("completed").cast("long").alias("completed"),
        F.coalesce("severe_120", F.lit(0)).cast("long").alias("severe"))


def route_disruption(spark, folder):
    return _rounded(D.routes_by_period(utc_outcomes(spark, folder), "utc_year"), "cancellation_rate", "diversion_rate", "severe_rate", digits=9)


def route_audit(spark, folder):
    return D.route_audit(utc_outcomes(spark, folder), "utc_year")


def top_routes(spark, folder):
    return _rounded(D.top_routes(flights(spark, folder, "flight_date", "origin", "destination"), _regime()), "route_share_pct")


def _pairs(spark, folder):
    df = utc_outcomes(spark, folder).withColumn("prediction_month", C.month_number(F.col("prediction_utc")))
    return D.lagged_pairs(df, "origin", "prediction_month", 10, 8)


def lagged_pairs(spark, folder):
    df = _pairs(spark, folder)
    return _rounded(df, "severe_rate", "cancellation_rate", "previous_severe_rate", "previous_cancellation_rate", digits=9)


def lagged_association(spark, folder):
    return _rounded(D.lag_association(_pairs(spark, folder), "origin"), "pooled_correlation", "within_correlation", digits=7)


def regime_shift(spark, folder):
    months = D.monthly(flights(spark, folder, *OUTCOME))
    shift = D.regime_shift(months, L.regime(F.col("month")), "reference", METRICS, PERMUTATIONS)
    return _rounded(shift, "mean0", "mean", "difference", "relative_change_pct", "cohens_d", "permutation_p")


def delay_histogram(spark, folder):
    """Exact-size seeded sample per regime, then equal-width delay counts over it and over all rows."""
    from skyledger.operators.ordering import keyed_rank

    df = flights(spark, folder, *OUTCOME, "flight_id").where((F.col("cancelled") == 0) & (F.col("diverted") == 0) & F.col("arr_delay").isNotNull())
    df = df.select("flight_id", "arr_delay", _regime().alias("regime"))
    sample = keyed_rank(df.withColumn("_o", L.seeded_order(F.col("flight_id"), 42)), ["regime"], ["_o", "flight_id"], "r").where(F.col("r") <= 1000)
    parts = [P.value_histogram(d, ["regime"], F.col("arr_delay"), -60, 240, 12).withColumn("source", F.lit(n)) for n, d in (("all", df), ("sample", sample))]
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (
    monthly_disruption, regime_disruption, hour_disruption, entity_disruption, top_entities, airport_role_disruption, route_disruption,
    route_audit, top_routes, lagged_pairs, lagged_association, regime_shift, delay_histogram)}

_DONE = "(cancelled = 0 AND diverted = 0 AND arr_delay IS NOT NULL)"
_SUMS = (f"count(*) AS scheduled, count(*) FILTER (cancelled = 1) AS cancelled_flights, count(*) FILTER (diverted = 1) AS diverted_flights, "
         f"count(*) FILTER {_DONE} AS completed, count(*) FILTER ({_DONE} AND arr_delay >= 120) AS severe, coalesce(sum(arr_delay) FILTER {_DONE}, 0) AS delay_sum")
_RATES = (f"round({div('cancelled_flights', 'scheduled')} * 100, 6) AS cancellation_pct, round({div('diverted_flights', 'scheduled')} * 100, 6) AS diversion_pct, "
          f"round({div('severe', 'completed')} * 100, 6) AS severe_pct, round({div('delay_sum', 'completed')}, 6) AS mean_delay")
_SQ = f"coalesce(sum(arr_delay * arr_delay) FILTER {_DONE}, 0) AS delay_sq"
_REG3 = f"replace({_REGIME}, 'partial_final', 'recovery')"
_ENT = f"{FLIGHTS}, f AS (SELECT *, {_REGIME} AS regime FROM flights), e AS (" + " UNION ALL ".join(
    f"SELECT regime, '{n}' AS entity_type, {x} AS entity, {_SUMS} FROM f GROUP BY 1, 3"
    for n, x in (("carrier", "carrier"), ("origin", "origin"), ("route", "origin || '-' || destination"))) + f"), er AS (SELECT *, {_RATES} FROM e)"
_UTC = _COHORT + """, u AS (SELECT *, year(make_timestamp(departure_utc * 1000000)) AS utc_year, CAST(year(make_timestamp(departure_utc * 1000000)) * 12 + month(make_timestamp(departure_utc * 1000000)) AS BIGINT) AS utc_month,
  CAST(year(make_timestamp(prediction_utc * 1000000)) * 12 + month(make_timestamp(prediction_utc * 1000000)) AS BIGINT) AS prediction_month FROM cohort)"""
_UTC_SUMS = ("count(*) AS scheduled, count(*) FILTER (cancelled = 1) AS cancelled_flights, count(*) FILTER (diverted = 1) AS diverted_flights, "
             "count(*) FILTER (completed) AS completed, count(*) FILTER (severe_120 = 1) AS severe")
_PAIRS = _UTC + f""", b AS (SELECT origin, prediction_month, {_UTC_SUMS} FROM u WHERE prediction_month IS NOT NULL GROUP BY 1, 2),
k AS (SELECT origin, prediction_month, scheduled, completed, {div('severe', 'completed')} AS severe_rate, {div('cancelled_flights', 'scheduled')} AS cancellation_rate FROM b WHERE scheduled >= 10 AND completed >= 8),
p AS (SELECT c.*, q.scheduled AS previous_scheduled, q.completed AS previous_completed, q.severe_rate AS previous_severe_rate, q.cancellation_rate AS previous_cancellation_rate
  FROM k c JOIN k q ON c.origin = q.origin AND q.prediction_month = c.prediction_month - 1)"""
_SHIFT = f"""{FLIGHTS}, m0 AS (SELECT date_trunc('month', flight_date) AS month, {_SUMS} FROM flights GROUP BY 1),
m AS (SELECT month, {_REGIME.replace('flight_date', 'month')} AS regime, {div('cancelled_flights', 'scheduled')} * 100 AS cancellation_pct, {div('severe', 'completed')} * 100 AS severe_pct, {div('delay_sum', 'completed')} AS mean_delay FROM m0),
v AS (""" + " UNION ALL ".join(f"SELECT '{x}' AS metric, regime, month, {x} AS v FROM m WHERE {x} IS NOT NULL" for x in METRICS) + f"""),
st AS (SELECT metric, regime, count(*) AS n, avg(v) AS mean, coalesce(var_samp(v), 0) AS var FROM v GROUP BY 1, 2),
j AS (SELECT s.metric, s.regime, r.n AS n0, s.n, r.mean AS mean0, s.mean, s.mean - r.mean AS difference, (s.mean - r.mean) / abs(r.mean) * 100 AS relative_change_pct,
  (s.mean - r.mean) / sqrt(((r.n - 1) * r.var + (s.n - 1) * s.var) / (r.n + s.n - 2)) AS cohens_d FROM st s JOIN st r ON s.metric = r.metric AND r.regime = 'reference' WHERE s.regime <> 'reference'),
po AS (SELECT j.metric, j.regime, n0, j.n, difference, v.v, row_number() OVER (PARTITION BY j.metric, j.regime ORDER BY v.regime <> 'reference', v.month) - 1 AS i
  FROM j JOIN v ON v.metric = j.metric AND v.regime IN ('reference', j.regime)),
pm AS (SELECT po.*, b, row_number() OVER (PARTITION BY metric, regime, b ORDER BY {mixed_sql('b', 'i')}, i) AS rk FROM po, range(0, {PERMUTATIONS}) t(b)),
pg AS (SELECT metric, regime, b, abs(sum(v) FILTER (rk > n0) / any_value(n) - sum(v) FILTER (rk <= n0) / any_value(n0)) >= abs(any_value(difference)) - 1e-12 AS hit FROM pm GROUP BY 1, 2, 3),
ex AS (SELECT metric, regime, count(*) FILTER (hit) AS extreme FROM pg GROUP BY 1, 2)"""
_HIST = "CASE WHEN arr_delay < -60 THEN 0 WHEN arr_delay >= 240 THEN 13 ELSE CAST(floor((arr_delay + 60) / 25) + 1 AS BIGINT) END"

SQL = {
    "monthly_disruption": f"""WITH {FLIGHTS}, m AS (SELECT date_trunc('month', flight_date) AS d, {_SUMS}, {_SQ} FROM flights GROUP BY 1)
SELECT strftime(d, '%Y-%m') AS month, {_REGIME.replace('flight_date', 'd')} AS regime, * EXCLUDE (d), {_RATES} FROM m""",
    "regime_disruption": f"""WITH {FLIGHTS}, m AS (SELECT {_REGIME} AS regime, strftime(min(flight_date), '%Y-%m') AS first_month, strftime(max(flight_date), '%Y-%m') AS last_month, {_SUMS}, {_SQ} FROM flights GROUP BY 1)
SELECT *, {_RATES}, round(sqrt((delay_sq - delay_sum * delay_sum / completed) / (completed - 1)), 6) AS delay_std FROM m""",
    "hour_disruption": f"""WITH {FLIGHTS}, h AS (SELECT {_REG3} AS regime, CAST(CASE WHEN dep_hhmm = 2400 THEN 0 ELSE floor(dep_hhmm / 100) END AS INT) AS hour, {_SUMS} FROM flights WHERE dep_hhmm IS NOT NULL GROUP BY 1, 2)
SELECT *, {_RATES} FROM h""",
    "entity_disruption": f"WITH {_ENT} SELECT * FROM er",
    "top_entities": f"""WITH {_ENT} SELECT regime, entity_type, entity, CAST(row_number() OVER (PARTITION BY regime, entity_type ORDER BY severe_pct DESC, entity) AS INT) AS severe_rank, scheduled, severe_pct
FROM er WHERE scheduled >= 20 AND severe_pct IS NOT NULL QUALIFY severe_rank <= 20""",
    "airport_role_disruption": f"""WITH {FLIGHTS}, a AS (SELECT *, unnest(['origin', 'destination']) AS role, unnest([origin, destination]) AS airport FROM flights),
g AS (SELECT year(flight_date) AS year, {_REGIME} AS regime, airport, role, {_SUMS} FROM a GROUP BY 1, 2, 3, 4) SELECT *, {_RATES} FROM g""",
    "route_disruption": f"""WITH {_UTC}, g AS (SELECT utc_year, origin, destination, {_UTC_SUMS} FROM u WHERE origin <> destination AND utc_year IS NOT NULL GROUP BY 1, 2, 3)
SELECT *, round({div('cancelled_flights', 'scheduled')}, 9) AS cancellation_rate, round({div('diverted_flights', 'scheduled')}, 9) AS diversion_rate, round({div('severe', 'completed')}, 9) AS severe_rate FROM g""",
    "route_audit": f"WITH {_UTC} SELECT count(*) AS rows, count(*) FILTER (origin = destination) AS self_loops, count(*) FILTER (origin IS NULL OR destination IS NULL) AS blank_ends, count(*) FILTER (utc_year IS NULL) AS without_period FROM u",
    "top_routes": f"""WITH {FLIGHTS}, c AS (SELECT {_REGIME} AS regime, origin || '-' || destination AS route, count(*) AS route_flights FROM flights GROUP BY 1, 2)
SELECT regime, route, route_flights, CAST(sum(route_flights) OVER (PARTITION BY regime) AS BIGINT) AS regime_flights, CAST(row_number() OVER (PARTITION BY regime ORDER BY route_flights DESC, route) AS INT) AS rank,
round(route_flights::DOUBLE / sum(route_flights) OVER (PARTITION BY regime) * 100, 6) AS route_share_pct FROM c QUALIFY rank <= 20""",
    "lagged_pairs": f"""WITH {_PAIRS} SELECT origin, prediction_month, scheduled, completed, round(severe_rate, 9) AS severe_rate, round(cancellation_rate, 9) AS cancellation_rate, previous_scheduled, previous_completed,
round(previous_severe_rate, 9) AS previous_severe_rate, round(previous_cancellation_rate, 9) AS previous_cancellation_rate FROM p""",
    "lagged_association": f"WITH {_PAIRS} " + " UNION ALL ".join(f"""SELECT '{o}' AS outcome, count(*) AS pairs, count(DISTINCT origin) AS entities, round(corr(x, y), 7) AS pooled_correlation, round(corr(dx, dy), 7) AS within_correlation
FROM (SELECT origin, x, y, x - avg(x) OVER (PARTITION BY origin) AS dx, y - avg(y) OVER (PARTITION BY origin) AS dy FROM (SELECT origin, previous_{o}_rate AS x, {o}_rate AS y FROM p))""" for o in ("severe", "cancellation")),
    "regime_shift": f"""WITH {_SHIFT} SELECT metric, regime, n0, n, round(mean0, 6) AS mean0, round(mean, 6) AS mean, round(difference, 6) AS difference, round(relative_change_pct, 6) AS relative_change_pct,
round(cohens_d, 6) AS cohens_d, extreme, round((extreme + 1) / {PERMUTATIONS + 1}.0::DOUBLE, 6) AS permutation_p FROM j JOIN ex USING (metric, regime)""",
    "delay_histogram": f"""WITH {FLIGHTS}, d AS (SELECT flight_id, arr_delay, {_REGIME} AS regime FROM flights WHERE {_DONE}),
s AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY regime ORDER BY md5('42|' || flight_id), flight_id) <= 1000)
SELECT regime, {_HIST} AS bucket, count(*) AS rows, 'all' AS source FROM d GROUP BY 1, 2 UNION ALL SELECT regime, {_HIST}, count(*), 'sample' FROM s GROUP BY 1, 2""",
}
