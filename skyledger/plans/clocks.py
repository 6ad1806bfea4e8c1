"""Clock, schedule and event-time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import clocks as C
from skyledger.operators import schedule as S
from skyledger.plans.oracle_views import FLIGHTS
from skyledger.sources.adapters import ZONES, flights

LOCKED_FROM = "2001-01-01"
TIMING = ("flight_id", "flight_date", "origin", "origin_zone", "destination_zone", "dep_hhmm", "arr_hhmm", "sched_elapsed")
OUTCOME = TIMING + ("cancelled", "diverted", "arr_delay", "dep_delay", "elapsed", "reported_arr_hhmm")


def clock_parse(spark, folder):
    df = flights(spark, folder, "flight_id", "dep_hhmm", "arr_hhmm")
    df = df.withColumns({"dep": C.clock_minutes(F.col("dep_hhmm")), "arr": C.clock_minutes(F.col("arr_hhmm"))})
    parts = [c.alias(f"{n}_{part}") for n in ("dep", "arr") for part, c in C.clock_parts(F.col(n)).items()]
    return df.select("flight_id", *parts, *[C.clock_status(F.col(f"{n}_hhmm"), F.col(n)).alias(f"{n}_status") for n in ("dep", "arr")])


def clock_quality(spark, folder):
    return S.clock_quality(flights(spark, folder, "dep_hhmm", "arr_hhmm", "reported_arr_hhmm"),
                           ["dep_hhmm", "arr_hhmm", "reported_arr_hhmm"])


def schedule_consistency(spark, folder):
    return S.schedule_consistency(flights(spark, folder, "dep_hhmm", "arr_hhmm", "sched_elapsed"))


def local_to_utc(spark, folder):
    df = S.reconcile_departures(flights(spark, folder, "flight_id", "flight_date", "dep_hhmm", "origin_zone"), zones=ZONES)
    return df.select("flight_id", "departure_status", "departure_utc", "departure_day_offset", "prediction_utc")


def arrival_reconcile(spark, folder):
    df = S.reconcile_arrivals(S.reconcile_departures(flights(spark, folder, *TIMING), zones=ZONES), tolerance_minutes=30.0, zones=ZONES)
    return df.select("flight_id", "arrival_status", "arrival_utc", "arrival_day_offset", "duration_utc_minutes",
                     "duration_difference_minutes")


def schedule_normalisation(spark, folder):
    df = S.normalise_schedule(flights(spark, folder, *TIMING), zones=ZONES)
    return df.groupBy("departure_status", "arrival_status").agg(
        F.count("*").alias("rows"), F.count("arrival_utc").alias("resolved"), F.max("arrival_day_offset").alias("max_day_offset"))


def prediction_times(spark, folder):
    df = S.prediction_times(flights(spark, folder, *TIMING), zones=ZONES)
    return df.select("flight_id", C.iso_local(F.col("departure_local")).alias("departure_local"),
                     C.iso_utc(F.col("departure_utc")).alias("departure_utc"),
                     C.iso_utc(F.col("prediction_utc")).alias("prediction_utc"),
                     "clock_value_2400", "dst_ambiguous", "dst_nonexistent", "conversion_status")


def _outcomes(spark, folder):
    return S.outcome_times(S.prediction_times(flights(spark, folder, *OUTCOME), zones=ZONES), LOCKED_FROM)


def outcome_times(spark, folder):
    return _outcomes(spark, folder).select("flight_id", "outcome_status", "candidate_arrival_utc")


def arrival_clock_check(spark, folder):
    return S.arrival_clock_check(_outcomes(spark, folder), zones=ZONES).select("flight_id", "clock_status", "validated_arrival_utc")


def calendar_parts(spark, folder):
    df = flights(spark, folder, "flight_id", "flight_date", "dep_hhmm")
    df = df.withColumn("minutes_of_day", C.clock_minutes(F.col("dep_hhmm")))
    hour = C.clock_parts(F.col("minutes_of_day"))["hour"]
    sine, cosine = C.cyclic(hour, 24)
    return df.select("flight_id", *[c.alias(n) for n, c in C.calendar_parts(F.col("flight_date")).items()],
                     C.hour_band(hour).alias("hour_band"), "minutes_of_day",
                     C.month_number(F.unix_date("flight_date") * C.DAY).alias("month_number"),
                     F.date_format("flight_date", "yyyy-MM").alias("month_label"),
                     F.round(sine, 9).alias("hour_sin"), F.round(cosine, 9).alias("hour_cos"))


def date_formats(spark, folder):
    """Order dates written in several text forms, parsed back: rows and range per form."""
    raw = flights(spark, folder, "flight_date", "flight_number")
    text = (F.when(F.col("flight_number") % 5 == 0, F.date_format("flight_date", "dd/MM/yyyy"))
            .when(F.col("flight_number") % 5 == 1, F.date_format("flight_date", "yyyyMMdd"))
            .when(F.col("flight_number") % 50 == 2, F.lit("n/a")).when(F.col("flight_number") % 50 == 3, F.lit(None))
            .otherwise(F.date_format("flight_date", "yyyy-MM-dd")))
    parsed = S.parse_dates(raw.select(text.alias("raw_date")), "raw_date")
    return parsed.groupBy("date_format").agg(
        F.count("*").alias("rows"), F.min("parsed_date").cast("string").alias("first_date"),
        F.max("parsed_date").cast("string").alias("last_date"))


def status_counts(spark, folder):
    df = S.prediction_times(flights(spark, folder, *TIMING), zones=ZONES)
    return S.status_counts(df, "conversion_status", "origin")


QUERIES = {f.__name__: f for f in (
    clock_parse, clock_quality, schedule_consistency, local_to_utc, arrival_reconcile, schedule_normalisation,
    prediction_times, outcome_times, arrival_clock_check, calendar_parts, date_formats, status_counts)}


def _clock(c: str, part: str) -> str:
    plain = f"({c} >= 0 AND {c} = floor({c}) AND floor({c} / 100) <= 23 AND {c} % 100 <= 59)"
    return {
        "hour": f"CAST(CASE WHEN {plain} THEN floor({c} / 100) WHEN {c} = 2400 THEN 0 END AS INT)",
        "minute": f"CAST(CASE WHEN {plain} THEN {c} % 100 WHEN {c} = 2400 THEN 0 END AS INT)",
        "rollover": f"CASE WHEN {c} = 2400 THEN 1 ELSE 0 END",
        "status": f"CASE WHEN {c} IS NULL THEN 'missing_time' WHEN {plain} OR {c} = 2400 THEN 'valid' ELSE 'invalid_time' END",
    }[part]


def _category(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 'missing' WHEN {c} = 2400 THEN 'end_of_day_2400' "
            f"WHEN {c} >= 0 AND floor({c} / 100) <= 23 AND {c} % 100 <= 59 THEN 'valid_hhmm' ELSE 'invalid_hhmm' END")


def _local(c: str, extra: int = 0) -> str:
    return (f"(CAST(flight_date AS TIMESTAMP) + to_minutes(CAST({_clock(c, 'hour')} * 60 + {_clock(c, 'minute')} "
            f"+ ({_clock(c, 'rollover')} + {extra}) * 1440 AS BIGINT)))")


def _dst(t: str, z: str) -> str:
    return (f"CASE WHEN timezone({z}, timezone({z}, {t})) <> {t} THEN 'nonexistent' "
            f"WHEN timezone({z}, timezone({z}, {t}) - INTERVAL 1 HOUR) = {t} THEN 'ambiguous' ELSE 'unique' END")


def _epoch(t: str) -> str:
    return f"CAST(epoch({t}) AS BIGINT)"


_DEP = FLIGHTS + f""", dep0 AS (SELECT *, {_local('dep_hhmm')} AS dep_local FROM flights),
dep1 AS (SELECT *, {_dst('dep_local', 'origin_zone')} AS dep_class FROM dep0),
dep AS (SELECT *, CASE WHEN dep_hhmm IS NOT NULL AND dep_class = 'unique' THEN {_epoch('timezone(origin_zone, dep_local)')} END AS departure_utc FROM dep1)"""

_CANDIDATES = ", ".join(
    f"{_local('arr_hhmm', k)} AS l{k}" for k in range(3))
_ARR = _DEP + f""", arr0 AS (SELECT *, {_CANDIDATES} FROM dep),
arr1 AS (SELECT *, {_dst('l0', 'destination_zone')} AS base_class FROM arr0),
cand AS (SELECT flight_id, k, l, destination_zone, departure_utc, sched_elapsed, {_clock('arr_hhmm', 'rollover')} + k AS off
  FROM (SELECT *, unnest([0, 1, 2]) AS k, unnest([l0, l1, l2]) AS l FROM arr1
        WHERE departure_utc IS NOT NULL AND arr_hhmm IS NOT NULL AND sched_elapsed IS NOT NULL AND base_class = 'unique')),
cand2 AS (SELECT *, ({_epoch('timezone(destination_zone, l)')} - departure_utc) / 60.0 AS dur FROM cand WHERE {_dst('l', 'destination_zone')} = 'unique'),
best AS (SELECT flight_id, off, {_epoch('timezone(destination_zone, l)')} AS arrival_utc, CAST(dur AS DOUBLE) AS dur, CAST(abs(dur - sched_elapsed) AS DOUBLE) AS diff
  FROM cand2 WHERE dur >= 0 QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY abs(dur - sched_elapsed), off) = 1),
arr AS (SELECT a.*, b.arrival_utc, b.off, b.dur, b.diff FROM arr1 a LEFT JOIN best b USING (flight_id))"""


def _arrival_status(tolerance: int) -> str:
    return f"""CASE WHEN departure_utc IS NULL THEN 'missing_or_invalid_departure_utc' WHEN arr_hhmm IS NULL THEN 'missing_arrival_time'
  WHEN sched_elapsed IS NULL THEN 'missing_scheduled_elapsed_time' WHEN base_class = 'ambiguous' THEN 'ambiguous_arrival_local_time'
  WHEN base_class = 'nonexistent' THEN 'nonexistent_arrival_local_time' WHEN arrival_utc IS NULL THEN 'no_valid_arrival_candidate'
  WHEN diff <= {tolerance} THEN 'reconciled' ELSE 'duration_difference_exceeds_tolerance' END"""


_DEP_STATUS = """CASE WHEN dep_hhmm IS NULL THEN 'invalid_departure_time' WHEN dep_class = 'nonexistent' THEN 'nonexistent_departure_local_time'
  WHEN dep_class = 'ambiguous' THEN 'ambiguous_departure_local_time' ELSE 'reconciled' END"""
_CONVERSION = """CASE WHEN dep_hhmm IS NULL THEN 'invalid_clock_time' WHEN dep_class = 'nonexistent' THEN 'dst_nonexistent'
  WHEN dep_class = 'ambiguous' THEN 'dst_ambiguous' ELSE 'ok' END"""
_ISO = "'%Y-%m-%dT%H:%M:%SZ'"

_OUT = _DEP + f""", outc AS (SELECT *, CASE WHEN flight_date >= DATE '{LOCKED_FROM}' THEN 'final_test_locked'
  WHEN cancelled = 1 THEN 'cancelled_no_arrival' WHEN diverted = 1 THEN 'diverted_excluded'
  WHEN arr_delay IS NULL OR dep_delay IS NULL OR elapsed IS NULL OR sched_elapsed IS NULL OR elapsed <= 0 OR elapsed > 1440 THEN 'invalid_or_missing_timing'
  WHEN departure_utc IS NULL THEN 'unresolved_scheduled_timestamp'
  WHEN abs(arr_delay - (dep_delay + elapsed - sched_elapsed)) > 1 THEN 'inconsistent_timing_fields' ELSE 'usable_candidate' END AS outcome_status FROM dep),
outcome AS (SELECT *, CASE WHEN outcome_status = 'usable_candidate' THEN departure_utc + CAST((dep_delay + elapsed) * 60 AS BIGINT) END AS candidate_arrival_utc FROM outc)"""

SQL = {
    "clock_parse": f"WITH {FLIGHTS} SELECT flight_id, " + ", ".join(
        f"{_clock(c, p)} AS {n}_{p}" for n, c in (("dep", "dep_hhmm"), ("arr", "arr_hhmm")) for p in ("hour", "minute", "rollover", "status"))
        + " FROM flights",
    "clock_quality": f"WITH {FLIGHTS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {_category(c)} AS category, count(*) AS rows FROM flights GROUP BY 2"
        for c in ("dep_hhmm", "arr_hhmm", "reported_arr_hhmm")),
    "schedule_consistency": f"""WITH {FLIGHTS}, m AS (SELECT floor(dep_hhmm / 100) * 60 + dep_hhmm % 100 AS d, floor(arr_hhmm / 100) * 60 + arr_hhmm % 100 AS a, sched_elapsed AS e FROM flights),
g AS (SELECT *, abs(CASE WHEN a < d THEN a - d + 1440 ELSE a - d END - e) AS gap FROM m)
SELECT count(*) AS rows, count(gap) AS comparable_rows, count(*) FILTER (gap IS NOT NULL AND a < d) AS overnight_rows,
count(*) FILTER (gap = 0) AS exact_rows, quantile_cont(gap, 0.5) AS median_abs_difference, quantile_cont(gap, 0.95) AS p95_abs_difference, max(gap) AS max_abs_difference FROM g""",
    "local_to_utc": f"""WITH {_DEP} SELECT flight_id, {_DEP_STATUS} AS departure_status, departure_utc,
CASE WHEN departure_utc IS NOT NULL THEN {_clock('dep_hhmm', 'rollover')} END AS departure_day_offset, departure_utc - 7200 AS prediction_utc FROM dep""",
    "arrival_reconcile": f"""WITH {_ARR} SELECT flight_id, {_arrival_status(30)} AS arrival_status, arrival_utc, off AS arrival_day_offset,
dur AS duration_utc_minutes, diff AS duration_difference_minutes FROM arr""",
    "schedule_normalisation": f"""WITH {_ARR} SELECT {_DEP_STATUS} AS departure_status, {_arrival_status(60)} AS arrival_status, count(*) AS rows,
count(arrival_utc) AS resolved, max(off) AS max_day_offset FROM arr GROUP BY 1, 2""",
    "prediction_times": f"""WITH {_DEP} SELECT flight_id, strftime(dep_local, '%Y-%m-%dT%H:%M:%S') AS departure_local,
strftime(make_timestamp(departure_utc * 1000000), {_ISO}) AS departure_utc, strftime(make_timestamp((departure_utc - 7200) * 1000000), {_ISO}) AS prediction_utc,
coalesce(dep_hhmm = 2400, false) AS clock_value_2400, coalesce(dep_hhmm IS NOT NULL AND dep_class = 'ambiguous', false) AS dst_ambiguous,
coalesce(dep_hhmm IS NOT NULL AND dep_class = 'nonexistent', false) AS dst_nonexistent, {_CONVERSION} AS conversion_status FROM dep""",
    "outcome_times": f"WITH {_OUT} SELECT flight_id, outcome_status, candidate_arrival_utc FROM outcome",
    "arrival_clock_check": f"""WITH {_OUT}, w AS (SELECT *, timezone(destination_zone, to_timestamp(candidate_arrival_utc)) AS lt FROM outcome),
x AS (SELECT *, abs(hour(lt) * 60 + minute(lt) - (floor(reported_arr_hhmm / 100) * 60 + reported_arr_hhmm % 100)) AS gap FROM w),
y AS (SELECT *, CASE WHEN outcome_status <> 'usable_candidate' THEN outcome_status WHEN reported_arr_hhmm IS NULL THEN 'invalid_reported_arrival_clock'
WHEN least(gap, 1440 - gap) <= 1 THEN 'validated_event_time' ELSE 'arrival_clock_mismatch' END AS clock_status FROM x)
SELECT flight_id, clock_status, CASE WHEN clock_status = 'validated_event_time' THEN candidate_arrival_utc END AS validated_arrival_utc FROM y""",
    "calendar_parts": f"""WITH {FLIGHTS} SELECT flight_id, year(flight_date) AS year, month(flight_date) AS month, quarter(flight_date) AS quarter,
day(flight_date) AS day_of_month, isodow(flight_date) - 1 AS day_of_week, week(flight_date) AS week_of_year,
CASE WHEN isodow(flight_date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
CASE WHEN dep_hhmm IS NULL THEN NULL WHEN dep_hhmm = 2400 OR dep_hhmm < 600 THEN '00-05' WHEN dep_hhmm < 1000 THEN '06-09' WHEN dep_hhmm < 1400 THEN '10-13'
WHEN dep_hhmm < 1800 THEN '14-17' ELSE '18-23' END AS hour_band, CAST(floor(dep_hhmm / 100) * 60 + dep_hhmm % 100 AS INT) AS minutes_of_day,
CAST(year(flight_date) * 12 + month(flight_date) AS BIGINT) AS month_number, strftime(flight_date, '%Y-%m') AS month_label,
round(sin(2 * pi() * {_clock('dep_hhmm', 'hour')} / 24), 9) AS hour_sin, round(cos(2 * pi() * {_clock('dep_hhmm', 'hour')} / 24), 9) AS hour_cos FROM flights""",
    "date_formats": f"""WITH {FLIGHTS}, f AS (SELECT flight_date, CASE WHEN flight_number % 5 = 0 THEN 'dd/MM/yyyy' WHEN flight_number % 5 = 1 THEN 'yyyyMMdd'
WHEN flight_number % 50 = 2 THEN 'unparsed' WHEN flight_number % 50 = 3 THEN 'missing' ELSE 'yyyy-MM-dd' END AS date_format FROM flights)
SELECT date_format, count(*) AS rows, CAST(min(CASE WHEN date_format NOT IN ('unparsed', 'missing') THEN flight_date END) AS STRING) AS first_date,
CAST(max(CASE WHEN date_format NOT IN ('unparsed', 'missing') THEN flight_date END) AS STRING) AS last_date FROM f GROUP BY 1""",
    "status_counts": f"WITH {_DEP} SELECT origin, {_CONVERSION} AS conversion_status, count(*) AS rows FROM dep GROUP BY 1, 2",
}
