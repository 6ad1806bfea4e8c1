"""Prior-month, degree and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import history as H
from skyledger.operators import labels as L
from skyledger.plans.cohorts import _COHORT, _E, cohort_frame
from skyledger.plans.disruption import _UTC
from skyledger.plans.oracle_views import FLIGHTS, div
from skyledger.sources.adapters import flights
from skyledger.session import cut_lineage

ENTITIES = {"prior_carrier": "carrier", "prior_origin": "origin", "prior_route": "route"}
COUNTS = list(ENTITIES)
DEGREES = ["prior_out_degree", "prior_weighted_out", "prior_in_degree", "prior_weighted_in"]


def timed(spark, folder):
    df = cohort_frame(spark, folder, "origin", "destination", "carrier").where(F.col("prediction_utc").isNotNull())
    return df.select("flight_id", "split", "prediction_utc", (F.col("prediction_utc") + 7200).alias("departure_utc"), "origin", "destination",
                     "carrier", F.concat_ws("-", "origin", "destination").alias("route"))


def prior_month_counts(spark, folder):
    return H.prior_month_counts(timed(spark, folder), ENTITIES).select("flight_id", "history_month", *COUNTS)


def prior_month_degrees(spark, folder):
    return H.prior_month_degrees(timed(spark, folder)).select("flight_id", "history_month", *DEGREES)


def masked_history(spark, folder):
    df = H.prior_month_counts(timed(spark, folder), ENTITIES)
    masked = H.mask_history(df, COUNTS, L.seconds_of("1995-02-01"))
    return masked.groupBy("split").agg(F.count("*").alias("rows"), *[F.count(c).alias(f"{c}_known") for c in COUNTS], *[F.sum(c).alias(c) for c in COUNTS])


def prior_month_verify(spark, folder):
    counts = H.prior_month_counts(timed(spark, folder), ENTITIES).drop("history_month")
    stored = cut_lineage(H.prior_month_degrees(counts))
    return H.verify_prior_month(stored, {"prior_carrier": ("carrier", None), "prior_origin": ("origin", None), "prior_route": ("route", None),
                                         "prior_out_degree": ("origin", "destination"), "prior_in_degree": ("destination", "origin")})


def _features(spark, folder):
    df = L.base_features(flights(spark, folder, "flight_id", "flight_date", "dep_hhmm", "arr_hhmm", "sched_elapsed", "distance", "origin", "destination", "carrier"))
    return df.withColumn("split", L.date_split(F.col("flight_date")))


CATEGORIES = ["origin", "destination", "route", "carrier_id"]
MEDIANS = ["departure_month", "departure_day_of_week", "dep_hour", "dep_minute", "arr_hour", "arr_minute", "distance", "sched_elapsed"]


def vocabulary(spark, folder):
    df = _features(spark, folder)
    return H.vocabulary(df.where(F.col("split") == L.DEVELOPMENT), CATEGORIES, 60)


def vocabulary_encode(spark, folder):
    df = _features(spark, folder)
    vocab = H.vocabulary(df.where(F.col("split") == L.DEVELOPMENT), CATEGORIES, 60)
    return H.encode(df.select("flight_id", *CATEGORIES), vocab, CATEGORIES).select("flight_id", *[f"{c}_code" for c in CATEGORIES])


def unseen_report(spark, folder):
    df = _features(spark, folder)
    vocab = H.vocabulary(df.where(F.col("split") == L.DEVELOPMENT), CATEGORIES, 60)
    return H.unknown_report(H.encode(df, vocab, CATEGORIES), CATEGORIES, "split")


def static_numbers(spark, folder):
    df = _features(spark, folder)
    spec = H.numeric_spec(df.where(F.col("split") == L.DEVELOPMENT), MEDIANS, ["distance", "sched_elapsed"])
    out = H.static_numbers(df.select("flight_id", *MEDIANS), spec)
    numbers = [c for c in out.columns if c not in ("flight_id", *MEDIANS)]
    return out.select("flight_id", *[F.round(c, 7).alias(c) for c in numbers])


QUERIES = {f.__name__: f for f in (
    prior_month_counts, prior_month_degrees, masked_history, prior_month_verify, vocabulary, vocabulary_encode, unseen_report, static_numbers)}

_T = _UTC + ", t AS (SELECT *, origin || '-' || destination AS route, prediction_month - 1 AS hm FROM u WHERE prediction_utc IS NOT NULL)"
_COUNTED = _T + ", " + ", ".join(f"n_{e} AS (SELECT {e}, utc_month, count(*) AS n FROM t GROUP BY 1, 2)" for e in ENTITIES.values()) + """,
pc AS (SELECT t.*, coalesce(a.n, 0) AS prior_carrier, coalesce(b.n, 0) AS prior_origin, coalesce(c.n, 0) AS prior_route FROM t
  LEFT JOIN n_carrier a ON a.carrier = t.carrier AND a.utc_month = hm LEFT JOIN n_origin b ON b.origin = t.origin AND b.utc_month = hm
  LEFT JOIN n_route c ON c.route = t.route AND c.utc_month = hm)"""
_DEGREE = _COUNTED + """, ed AS (SELECT utc_month, origin, destination, count(*) AS w FROM t WHERE origin <> destination GROUP BY 1, 2, 3),
o AS (SELECT utc_month, origin, count(*) AS d, CAST(sum(w) AS BIGINT) AS w FROM ed GROUP BY 1, 2), i AS (SELECT utc_month, destination, count(*) AS d, CAST(sum(w) AS BIGINT) AS w FROM ed GROUP BY 1, 2),
pd AS (SELECT pc.*, coalesce(o.d, 0) AS prior_out_degree, coalesce(o.w, 0) AS prior_weighted_out, coalesce(i.d, 0) AS prior_in_degree, coalesce(i.w, 0) AS prior_weighted_in
  FROM pc LEFT JOIN o ON o.origin = pc.origin AND o.utc_month = hm LEFT JOIN i ON i.destination = pc.destination AND i.utc_month = hm)"""


def _verify(stored: str, entity: str, counted: str | None) -> str:
    totals = (f"SELECT {entity} AS e, utc_month + 1 AS nx, count(*) AS n FROM t GROUP BY 1, 2" if counted is None else
              f"SELECT {entity} AS e, utc_month + 1 AS nx, count(DISTINCT {counted}) AS n FROM t WHERE origin <> destination GROUP BY 1, 2")
    return f"""SELECT '{stored}' AS feature, count(*) FILTER (utc_month > fm) AS comparable_rows, count(*) FILTER (utc_month > fm AND {stored} = coalesce(n, 0)) AS matches,
count(*) FILTER (utc_month > fm AND {stored} <> coalesce(n, 0)) AS mismatches, count(*) FILTER (utc_month = fm) AS first_month_rows,
{div(f'count(*) FILTER (utc_month > fm AND {stored} <> coalesce(n, 0))', 'count(*) FILTER (utc_month > fm)')} AS mismatch_rate
FROM pd CROSS JOIN (SELECT min(utc_month) AS fm FROM t) LEFT JOIN ({totals}) ON e = {entity} AND nx = utc_month"""


_FEAT = f"""{FLIGHTS}, f AS (SELECT flight_id, origin, destination, origin || '-' || destination AS route, 'ID_' || carrier AS carrier_id,
  CASE WHEN year(flight_date) < 2000 THEN 'development' WHEN year(flight_date) = 2000 THEN 'validation' ELSE 'final_test_locked' END AS split,
  month(flight_date) AS departure_month, isodow(flight_date) - 1 AS departure_day_of_week, CASE WHEN dep_hhmm < 2400 THEN floor(dep_hhmm / 100) END AS dep_hour,
  CASE WHEN dep_hhmm < 2400 THEN dep_hhmm % 100 END AS dep_minute, CASE WHEN arr_hhmm < 2400 THEN floor(arr_hhmm / 100) END AS arr_hour,
  CASE WHEN arr_hhmm < 2400 THEN arr_hhmm % 100 END AS arr_minute, distance, sched_elapsed FROM flights)"""
_VOCAB = _FEAT + ", vc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS level, count(*) AS rows FROM f WHERE split = 'development' GROUP BY 2" for c in CATEGORIES
) + "), vocab AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY rows DESC, level) AS INT) AS code FROM vc WHERE rows >= 60)"
_ENC = _VOCAB + ", enc AS (SELECT f.flight_id, f.split, " + ", ".join(f"coalesce(v{i}.code, 0) AS {c}_code" for i, c in enumerate(CATEGORIES)) + " FROM f " + " ".join(
    f"LEFT JOIN vocab v{i} ON v{i}.column_name = '{c}' AND v{i}.level = f.{c}" for i, c in enumerate(CATEGORIES)) + ")"
_SPEC = _FEAT + ", med AS (SELECT " + ", ".join(f"median({c}) AS {c}_median" for c in MEDIANS) + """ FROM f WHERE split = 'development'),
sp AS (SELECT avg(ln(1 + coalesce(distance, distance_median))) AS dm, stddev_pop(ln(1 + coalesce(distance, distance_median))) AS ds,
  avg(ln(1 + coalesce(sched_elapsed, sched_elapsed_median))) AS em, stddev_pop(ln(1 + coalesce(sched_elapsed, sched_elapsed_median))) AS es FROM f, med WHERE split = 'development')"""


def _cycle(name: str, value: str, period: str) -> str:
    return f"round(sin(2 * pi() * ({value}) / {period}), 7) AS {name}_sin, round(cos(2 * pi() * ({value}) / {period}), 7) AS {name}_cos"


def _filled(c: str) -> str:
    return f"coalesce({c}, {c}_median)"


SQL = {
    "prior_month_counts": f"WITH {_COUNTED} SELECT flight_id, hm AS history_month, prior_carrier, prior_origin, prior_route FROM pc",
    "prior_month_degrees": f"WITH {_DEGREE} SELECT flight_id, hm AS history_month, prior_out_degree, prior_weighted_out, prior_in_degree, prior_weighted_in FROM pd",
    "masked_history": f"WITH {_COUNTED} SELECT split, count(*) AS rows, " + ", ".join(
        f"count(*) FILTER (departure_utc >= epoch(DATE '1995-02-01')) AS {c}_known, CAST(sum({c}) FILTER (departure_utc >= epoch(DATE '1995-02-01')) AS BIGINT) AS {c}" for c in COUNTS)
        + " FROM pc GROUP BY 1",
    "prior_month_verify": f"WITH {_DEGREE} " + " UNION ALL ".join((
        _verify("prior_carrier", "carrier", None), _verify("prior_origin", "origin", None), _verify("prior_route", "route", None),
        _verify("prior_out_degree", "origin", "destination"), _verify("prior_in_degree", "destination", "origin"))),
    "vocabulary": f"WITH {_VOCAB} SELECT * FROM vocab",
    "vocabulary_encode": f"WITH {_ENC} SELECT * EXCLUDE (split) FROM enc",
    "unseen_report": f"WITH {_ENC} " + " UNION ALL ".join(
        f"SELECT split, count(*) AS rows, '{c}' AS column_name, count(*) FILTER ({c}_code = 0) AS unknown_rows, {div(f'count(*) FILTER ({c}_code = 0)', 'count(*)')} AS unknown_share FROM enc GROUP BY 1" for c in CATEGORIES),
    "static_numbers": f"WITH {_SPEC} SELECT flight_id, " + ", ".join((
        _cycle("month", _filled("departure_month") + " - 1", "12"), _cycle("weekday", _filled("departure_day_of_week"), "7"),
        _cycle("dep", f"{_filled('dep_hour')} + {_filled('dep_minute')} / 60", "24"), _cycle("arr", f"{_filled('arr_hour')} + {_filled('arr_minute')} / 60", "24"),
        f"round((ln(1 + {_filled('distance')}) - dm) / ds, 7) AS distance_z", f"round((ln(1 + {_filled('sched_elapsed')}) - em) / es, 7) AS sched_elapsed_z")) + " FROM f, med, sp",
}
