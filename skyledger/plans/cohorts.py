"""Label, split, role and cohort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import labels as L
from skyledger.operators.schedule import prediction_times
from skyledger.plans.clocks import _DEP
from skyledger.plans.oracle_views import FLIGHTS, div
from skyledger.session import stage
from skyledger.sources.adapters import ZONES, flights

COHORT_COLUMNS = ("flight_id", "flight_date", "prediction_utc", "completed", "cancelled_source", "diverted_source", "severe_120", "delay_minutes",
                  "original_split", "split", "regime", "embargoed", "eligible_cancellation", "eligible_severe", "eligible_regression")
SHOCK_YEAR = 1996
SEED = 42


def labelled(spark, folder, *extra):
    need = ("flight_id", "flight_date", "cancelled", "diverted", "arr_delay")
    return L.outcome_labels(flights(spark, folder, *need, *extra))


def cohort_frame(spark, folder, *extra, derive=None):
    """The cohort as a materialised stage. Clock conversion is a long expression chain; a filter pushed through it
    would repeat the chain in every predicate, so the cohort is written once, by split, and filtered afterwards.
    ``derive`` adds columns row by row before it is written."""
    timing = ("dep_hhmm", "origin_zone")
    timed = prediction_times(labelled(spark, folder, *timing, *[e for e in extra if e not in timing]), zones=ZONES)
    selected = L.cohort(timed).select(*COHORT_COLUMNS, *extra)
    return stage(derive(selected) if derive else selected, "split")


def labels(spark, folder):
    df = labelled(spark, folder)
    return df.select("flight_id", "cancelled_source", "diverted_source", "completed", "delay_minutes",
                     *[f"severe_{t}" for t in L.SEVERE_THRESHOLDS], "exclusion_reason")


def base_features(spark, folder):
    df = L.base_features(flights(spark, folder, "flight_id", "flight_date", "dep_hhmm", "arr_hhmm", "sched_elapsed", "distance",
                                 "origin", "destination", "carrier"))
    return df.withColumn("flight_date", F.col("flight_date").cast("string"))


def split_manifest(spark, folder):
    df = flights(spark, folder, "flight_id", "flight_date")
    return df.select("flight_id", L.date_split(F.col("flight_date")).alias("split"), L.regime(F.col("flight_date")).alias("regime"),
                     L.regime(F.col("flight_date"), L.THREE_REGIMES).alias("regime_three_way"))


def utc_embargo(spark, folder):
    return cohort_frame(spark, folder).select("flight_id", "original_split", "split", "embargoed", "eligible_cancellation",
                                              "eligible_severe", "eligible_regression")


def chronology(spark, folder):
    df = cohort_frame(spark, folder)
    before = L.chronology(df, "original_split", "prediction_utc").withColumn("stage", F.lit("before_embargo"))
    return before.unionByName(L.chronology(df, "split", "prediction_utc").withColumn("stage", F.lit("after_embargo")))


def cohort_summary(spark, folder):
    return L.cohort_summary(cohort_frame(spark, folder))


def split_crosstab(spark, folder):
    return L.split_crosstab(cohort_frame(spark, folder))


def _development(spark, folder):
    return cohort_frame(spark, folder).where((F.col("split") == L.DEVELOPMENT) & F.col("eligible_severe"))


def roles(spark, folder):
    kept = cohort_frame(spark, folder).where(~F.col("embargoed") & F.col("eligible_severe"))
    staged = L.require_chronology(L.role_spans(L.roles(kept))).withColumn("protocol", F.lit("early_stop"))
    return staged.unionByName(L.role_spans(L.roles(kept, early_stop=False)).withColumn("protocol", F.lit("all_development")))


def expanding_windows(spark, folder):
    kept = cohort_frame(spark, folder).where((F.col("split") != L.FINAL_TEST) & ~F.col("embargoed") & F.col("eligible_severe"))
    windows = L.expanding_windows(kept.select("prediction_utc", "severe_120"), [1998, 1999, 2000])
    return windows.groupBy("eval_year", "role").agg(F.count("*").alias("rows"), F.sum(F.col("severe_120").cast("long")).alias("events"),
                                                    F.min("prediction_utc").alias("first_utc"), F.max("prediction_utc").alias("last_utc"))


def tuning_halves(spark, folder):
    kept = cohort_frame(spark, folder).where((F.col("split") == L.VALIDATION) & F.col("eligible_severe"))
    return kept.groupBy(L.half(F.col("prediction_utc")).alias("half")).agg(
        F.count("*").alias("rows"), F.sum(F.col("severe_120").cast("long")).alias("events"))


def fit_composition(spark, folder):
    fit = L.roles(_development(spark, folder)).where(F.col("role") == L.FIT)
    return L.fit_composition(fit, "severe_120")


def fit_variants(spark, folder):
    fit = L.roles(_development(spark, folder)).where(F.col("role") == L.FIT).select("flight_id", "prediction_utc", "severe_120")
    return L.fit_composition(L.fit_variants(fit, SHOCK_YEAR, SEED), "severe_120", "variant")


def exact_subsample(spark, folder):
    fit = _development(spark, folder).select("flight_id", "prediction_utc")
    return L.exact_sample(fit, 2000, SEED)


def predictor_label_tables(spark, folder):
    df = cohort_frame(spark, folder, "origin", "destination", "carrier").withColumn("usable", ~F.col("embargoed") & F.col("prediction_utc").isNotNull())
    predictors, outcome = L.separate_labels(df, ["prediction_utc", "origin", "destination", "carrier"], ["cancelled_source", "severe_120"], "usable")
    joined = predictors.join(outcome, "flight_id")
    return joined.groupBy("carrier").agg(F.count("*").alias("rows"), F.sum(F.col("cancelled_source").cast("long")).alias("cancelled_events"),
                                         F.sum(F.col("severe_120").cast("long")).alias("severe_events"))


QUERIES = {f.__name__: f for f in (
    labels, base_features, split_manifest, utc_embargo, chronology, cohort_summary, split_crosstab, roles, expanding_windows,
    tuning_halves, fit_composition, fit_variants, exact_subsample, predictor_label_tables)}

_DONE = "(cancelled = 0 AND diverted = 0 AND arr_delay IS NOT NULL)"
_REASON = """CASE WHEN cancelled = 1 THEN 'cancelled_flight' WHEN diverted = 1 THEN 'diverted_flight'
  WHEN arr_delay IS NULL THEN 'missing_or_invalid_arrival_delay' ELSE 'eligible_completed_flight' END"""
_SPLIT = "CASE WHEN year(flight_date) < 2000 THEN 'development' WHEN year(flight_date) = 2000 THEN 'validation' ELSE 'final_test_locked' END"
_REGIME = "CASE year(flight_date) WHEN 1995 THEN 'reference' WHEN 1996 THEN 'shock' WHEN 2001 THEN 'partial_final' ELSE 'recovery' END"
_V, _F, _E = 946684800, 978307200, 930787200  # 2000-01-01, 2001-01-01, 1999-07-01 UTC
_COHORT = _DEP + f""", c0 AS (SELECT *, departure_utc - 7200 AS prediction_utc, {_DONE} AS completed, CAST(cancelled AS INT) AS cancelled_source,
  CASE WHEN {_DONE} THEN CAST(arr_delay >= 120 AS INT) END AS severe_120, {_SPLIT} AS original_split, {_REGIME} AS regime FROM dep),
cohort AS (SELECT *, CASE WHEN original_split = 'development' AND prediction_utc < {_V} THEN 'development'
  WHEN original_split = 'validation' AND prediction_utc >= {_V} AND prediction_utc < {_F} THEN 'validation'
  WHEN original_split = 'final_test_locked' AND prediction_utc >= {_F} THEN 'final_test_locked' ELSE 'embargoed_boundary' END AS split FROM c0)"""


def _chron(column: str, stage: str) -> str:
    return f"""SELECT '{stage}' AS stage, split, rows, min_utc, max_utc, coalesce(max_utc < lead(min_utc) OVER (ORDER BY split = 'final_test_locked', split), true) AS ends_before_next_starts
FROM (SELECT {column} AS split, count(*) AS rows, min(prediction_utc) AS min_utc, max(prediction_utc) AS max_utc FROM cohort WHERE {column} <> 'embargoed_boundary' GROUP BY 1)"""


def _role_sql(protocol: str, development: str) -> str:
    return f"""SELECT *, coalesce(last_utc < lead(first_utc) OVER (ORDER BY list_position(['fit', 'early_stop', 'validation', 'final_test'], role)), true) AS ends_before_next FROM (SELECT '{protocol}' AS protocol, CASE WHEN split = 'validation' THEN 'validation' WHEN split = 'final_test_locked' THEN 'final_test' {development} END AS role,
count(*) AS rows, min(prediction_utc) AS first_utc, max(prediction_utc) AS last_utc FROM cohort WHERE split <> 'embargoed_boundary' AND completed GROUP BY 2)"""


def _window_sql(year: int) -> str:
    start, stop, end = (f"epoch(DATE '{d}')" for d in (f"{year}-01-01", f"{year - 1}-07-01", f"{year + 1}-01-01"))
    return f"""SELECT {year} AS eval_year, CASE WHEN prediction_utc < {stop} THEN 'fit' WHEN prediction_utc < {start} THEN 'early_stop' WHEN prediction_utc < {end} THEN 'eval' ELSE 'unused' END AS role,
count(*) AS rows, CAST(sum(severe_120) AS BIGINT) AS events, min(prediction_utc) AS first_utc, max(prediction_utc) AS last_utc
FROM cohort WHERE split IN ('development', 'validation') AND completed GROUP BY 2"""


_FITROWS = f"{_COHORT}, fit AS (SELECT *, year(make_timestamp(prediction_utc * 1000000)) AS y FROM cohort WHERE split = 'development' AND completed AND prediction_utc < {_E})"
_COMPOSITION = (f"count(*) AS rows, CAST(sum(severe_120) AS BIGINT) AS events, {div('sum(severe_120)', 'count(*)')} AS event_rate, "
                f"{div('count(*)', 'sum(count(*)) OVER (PARTITION BY v)')} AS share_of_fit_rows")

SQL = {
    "labels": f"""WITH {FLIGHTS} SELECT flight_id, CAST(cancelled AS INT) AS cancelled_source, CAST(diverted AS INT) AS diverted_source, {_DONE} AS completed,
CASE WHEN {_DONE} THEN arr_delay END AS delay_minutes, """ + ", ".join(
        f"CASE WHEN {_DONE} THEN CAST(arr_delay >= {t} AS INT) END AS severe_{t}" for t in L.SEVERE_THRESHOLDS) + f", {_REASON} AS exclusion_reason FROM flights",
    "base_features": f"""WITH {FLIGHTS} SELECT flight_id, CAST(flight_date AS STRING) AS flight_date, year(flight_date) AS departure_year, month(flight_date) AS departure_month,
quarter(flight_date) AS departure_quarter, day(flight_date) AS departure_day_of_month, isodow(flight_date) - 1 AS departure_day_of_week, week(flight_date) AS departure_week_of_year,
CAST(isodow(flight_date) >= 6 AS INT) AS departure_is_weekend, CASE WHEN dep_hhmm < 2400 THEN CAST(floor(dep_hhmm / 100) AS INT) END AS dep_hour,
CASE WHEN dep_hhmm < 2400 THEN CAST(dep_hhmm % 100 AS INT) END AS dep_minute, CASE WHEN arr_hhmm < 2400 THEN CAST(floor(arr_hhmm / 100) AS INT) END AS arr_hour,
CASE WHEN arr_hhmm < 2400 THEN CAST(arr_hhmm % 100 AS INT) END AS arr_minute, sched_elapsed, distance, origin, destination, origin || '-' || destination AS route,
'ID_' || carrier AS carrier_id, coalesce(dep_hhmm < 2400, false) AS dep_time_valid, coalesce(arr_hhmm < 2400, false) AS arr_time_valid, true AS date_valid FROM flights""",
    "split_manifest": f"WITH {FLIGHTS} SELECT flight_id, {_SPLIT} AS split, {_REGIME} AS regime, replace({_REGIME}, 'partial_final', 'recovery') AS regime_three_way FROM flights",
    "utc_embargo": f"""WITH {_COHORT} SELECT flight_id, original_split, split, split = 'embargoed_boundary' AS embargoed, true AS eligible_cancellation,
completed AS eligible_severe, completed AS eligible_regression FROM cohort""",
    "chronology": f"WITH {_COHORT} {_chron('original_split', 'before_embargo')} UNION ALL {_chron('split', 'after_embargo')}",
    "cohort_summary": f"""WITH {_COHORT} SELECT split, regime, count(*) AS rows, count(*) FILTER (completed) AS completed_flights, CAST(sum(cancelled_source) AS BIGINT) AS cancelled_events,
CAST(coalesce(sum(severe_120), 0) AS BIGINT) AS severe_events, {div('sum(cancelled_source)', 'count(*)')} AS cancellation_rate,
{div('sum(severe_120)', 'count(*) FILTER (completed)')} AS severe_rate_completed FROM cohort GROUP BY 1, 2""",
    "split_crosstab": f"""WITH {_COHORT} SELECT original_split, """ + ", ".join(
        f"count(*) FILTER (split = '{s}') AS {s}" for s in (*L.SPLITS, L.EMBARGOED)) + " FROM cohort GROUP BY 1",
    "roles": f"WITH {_COHORT} " + _role_sql("early_stop", f"WHEN prediction_utc >= {_E} THEN 'early_stop' ELSE 'fit'") + " UNION ALL " + _role_sql("all_development", "ELSE 'fit'"),
    "expanding_windows": f"WITH {_COHORT} " + " UNION ALL ".join(_window_sql(y) for y in (1998, 1999, 2000)),
    "tuning_halves": f"""WITH {_COHORT} SELECT CASE WHEN prediction_utc < epoch(DATE '2000-07-01') THEN 'selection' ELSE 'confirmation' END AS half, count(*) AS rows,
CAST(sum(severe_120) AS BIGINT) AS events FROM cohort WHERE split = 'validation' AND completed GROUP BY 1""",
    "fit_composition": f"WITH {_FITROWS} SELECT y AS year, {_COMPOSITION.replace('PARTITION BY v', '')} FROM fit GROUP BY 1",
    "fit_variants": f"""WITH {_FITROWS}, kept AS (SELECT count(*) AS n FROM fit WHERE y <> {SHOCK_YEAR}),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || flight_id), flight_id) AS rn FROM fit),
u AS (SELECT 'full' AS v, y, severe_120 FROM fit UNION ALL SELECT 'without_shock', y, severe_120 FROM fit WHERE y <> {SHOCK_YEAR}
  UNION ALL SELECT 'matched', y, severe_120 FROM ranked, kept WHERE rn <= n)
SELECT v AS variant, y AS year, {_COMPOSITION} FROM u GROUP BY v, y""",
    "exact_subsample": f"""WITH {_COHORT} SELECT flight_id, prediction_utc FROM cohort WHERE split = 'development' AND completed
ORDER BY md5('{SEED}|' || flight_id), flight_id LIMIT 2000""",
    "predictor_label_tables": f"""WITH {_COHORT} SELECT carrier, count(*) AS rows, CAST(sum(cancelled_source) AS BIGINT) AS cancelled_events, CAST(sum(severe_120) AS BIGINT) AS severe_events
FROM cohort WHERE split <> 'embargoed_boundary' GROUP BY 1""",
}
