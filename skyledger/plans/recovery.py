"""Episode and recovery queries, with regions as entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import recovery as R
from skyledger.plans.oracle_views import FLIGHTS, REGIONS
from skyledger.sources.adapters import flights, regions
from skyledger.session import cut_lineage

LOCKED = "2001-01-01"
# Regional days are smaller than airport days of a national schedule, so the demonstration rules are wider.
RULES = R.Rules("primary", 3, 0.30, 0.10, 2)
SCENARIOS = R.sensitivity_rules(RULES, (2, 5), 0.40, 0.20)


def _days(spark, folder):
    """Region-days: airport-days first, then the 25 fixed airport-to-region rows."""
    df = flights(spark, folder, "flight_date", "origin", "cancelled", "diverted", "arr_delay")
    days = R.entity_days(df, "origin", F.lit(LOCKED).cast("date"))
    joined = days.join(F.broadcast(regions(spark, folder)), days["entity"] == F.col("airport"))
    totals = joined.groupBy(F.col("region").alias("entity"), "day").agg(F.sum("completed").alias("completed"), F.sum("severe").alias("severe"))
    return totals.withColumn("severe_rate", F.when(F.col("completed") > 0, F.col("severe") / F.col("completed")))


def entity_days(spark, folder):
    return _days(spark, folder).withColumn("severe_rate", F.round("severe_rate", 9))


def _episodes(spark, folder):
    return cut_lineage(R.episodes(_days(spark, folder), [RULES]))


def episodes(spark, folder):
    return _episodes(spark, folder).withColumn("start_rate", F.round("start_rate", 9))


def episode_checks(spark, folder):
    """The episode audit on a copy with spoiled rows: wrong and negative durations, flags, reasons and repeated starts."""
    start = F.col("start_day")
    spoiled = _episodes(spark, folder).withColumns({
        "duration_days": F.when(start % 11 == 0, F.col("duration_days") + 1).when(start % 13 == 0, -F.col("duration_days")).otherwise(F.col("duration_days")),
        "recovered": F.when(start % 17 == 0, 2).otherwise(F.col("recovered")), "end_reason": F.when(start % 19 == 0, "spoiled").otherwise(F.col("end_reason"))})
    return R.episode_checks(spoiled.unionByName(spoiled.where(start % 7 == 0)))


def episode_sensitivity(spark, folder):
    return R.sensitivity(cut_lineage(_days(spark, folder)), SCENARIOS)


def _cohorts(spark, folder):
    table = _episodes(spark, folder)
    return table.withColumn("cohort", F.when(F.year(F.date_from_unix_date("start_day")) == 1995, "1995").when(
        F.year(F.date_from_unix_date("start_day")) == 1996, "1996").otherwise("1997-2000"))


def km_curve(spark, folder):
    curve = R.km_intervals(R.km_curve(_cohorts(spark, folder), ["cohort"], "duration_days", "recovered"))
    return curve.withColumns({c: F.round(c, 8) for c in ("survival", "log_variance", "survival_low", "survival_high")})


def km_summary(spark, folder):
    out = R.km_summary(_cohorts(spark, folder), ["cohort"], "duration_days", "recovered", "end_reason")
    return out.withColumns({c: F.round(c, 8) for c in ("censoring_fraction", "recovered_by_7", "recovered_by_14")})


QUERIES = {f.__name__: f for f in (entity_days, episodes, episode_checks, episode_sensitivity, km_curve, km_summary)}

_DONE = "(cancelled = 0 AND diverted = 0 AND arr_delay IS NOT NULL)"
_DAYS = f"""{FLIGHTS}, {REGIONS}, days AS (SELECT region AS entity, CAST(date_diff('day', DATE '1970-01-01', flight_date) AS INT) AS day, count(*) FILTER {_DONE} AS completed, count(*) FILTER ({_DONE} AND arr_delay >= 120) AS severe,
  (count(*) FILTER ({_DONE} AND arr_delay >= 120))::DOUBLE / nullif(count(*) FILTER {_DONE}, 0) AS severe_rate FROM flights JOIN regions ON origin = airport WHERE flight_date < DATE '{LOCKED}' GROUP BY 1, 2)"""
_SCEN = "sc AS (" + " UNION ALL ".join(
    f"SELECT '{r.name}' AS scenario, {r.minimum} AS minimum, {r.start_rate}::DOUBLE AS sl, {r.normal_rate}::DOUBLE AS nl, {r.normal_days} AS need" for r in SCENARIOS) + ")"
# One recursion step handles the k-th qualifying day of every (scenario, entity): op = open start, orr = its rate, calm = normal streak.
_WALK = f"""{_DAYS}, {_SCEN}, q AS (SELECT sc.*, days.*, row_number() OVER (PARTITION BY scenario, entity ORDER BY day) AS k, count(*) OVER (PARTITION BY scenario, entity) AS total FROM days, sc WHERE completed >= minimum),
wk(scenario, entity, k, day, op, orr, calm, e_start, e_end, e_rate, e_reason) AS (
  SELECT scenario, entity, CAST(0 AS BIGINT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS DOUBLE), 0, CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT scenario, entity FROM q)
  UNION ALL
  SELECT scenario, entity, k, day, CASE WHEN done THEN NULL WHEN op2 IS NULL AND severe_rate >= sl THEN day ELSE op2 END, CASE WHEN done THEN NULL WHEN op2 IS NULL AND severe_rate >= sl THEN severe_rate ELSE orr END,
    CASE WHEN done OR op2 IS NULL THEN 0 ELSE c2 END, CASE WHEN gap OR done THEN op END, CASE WHEN gap THEN pd WHEN done THEN day END, CASE WHEN gap OR done THEN orr END,
    CASE WHEN gap THEN '{R.GAP}' WHEN done THEN '{R.RECOVERED}' END
  FROM (SELECT *, op2 IS NOT NULL AND c2 >= need AS done FROM (SELECT *, CASE WHEN gap THEN NULL ELSE op END AS op2, CASE WHEN NOT gap AND op IS NOT NULL AND severe_rate <= nl THEN calm + 1 ELSE 0 END AS c2
    FROM (SELECT q.scenario, q.entity, q.k, q.day, q.severe_rate, q.sl, q.nl, q.need, w.op, w.orr, w.calm, w.day AS pd, coalesce(w.op IS NOT NULL AND q.day - w.day > 1, false) AS gap
      FROM wk w JOIN q ON q.scenario = w.scenario AND q.entity = w.entity AND q.k = w.k + 1)))),
ep AS (SELECT scenario, entity, e_start AS start_day, e_end AS end_day, e_rate AS start_rate, e_reason AS end_reason FROM wk WHERE e_reason IS NOT NULL
  UNION ALL SELECT wk.scenario, wk.entity, op, wk.day, orr, '{R.LAST_DAY}' FROM wk JOIN q ON q.scenario = wk.scenario AND q.entity = wk.entity AND q.k = wk.k AND q.k = q.total WHERE op IS NOT NULL),
epi AS (SELECT *, end_day - start_day + 1 AS duration_days, CAST(end_reason = '{R.RECOVERED}' AS INT) AS recovered FROM ep)"""
_PRIMARY = _WALK.replace(_SCEN, f"sc AS (SELECT 'primary' AS scenario, {RULES.minimum} AS minimum, {RULES.start_rate}::DOUBLE AS sl, {RULES.normal_rate}::DOUBLE AS nl, {RULES.normal_days} AS need)")
_KM = _PRIMARY + """, co AS (SELECT *, CASE year(DATE '1970-01-01' + start_day) WHEN 1995 THEN '1995' WHEN 1996 THEN '1996' ELSE '1997-2000' END AS cohort FROM epi),
ct AS (SELECT cohort, duration_days AS t, count(*) AS n, CAST(sum(recovered) AS BIGINT) AS d FROM co GROUP BY 1, 2),
rk AS (SELECT *, CAST(sum(n) OVER (PARTITION BY cohort ORDER BY t DESC) AS BIGINT) AS at_risk FROM ct),
km AS (SELECT *, CASE WHEN bool_or(d = at_risk) OVER w THEN 0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d::DOUBLE / at_risk) ELSE 0 END) OVER w) END::DOUBLE AS survival,
  sum(CASE WHEN at_risk > d THEN d / (at_risk * (at_risk - d)::DOUBLE) ELSE 0 END) OVER w AS log_variance FROM rk WINDOW w AS (PARTITION BY cohort ORDER BY t))"""
_THETA = "(1.959963984540054::DOUBLE * sqrt(log_variance) / ln(survival))"

SQL = {
    "entity_days": f"WITH {_DAYS} SELECT entity, day, completed, severe, round(severe_rate, 9) AS severe_rate FROM days",
    "episodes": f"WITH RECURSIVE {_PRIMARY} SELECT scenario, entity, start_day, end_day, duration_days, recovered, end_reason, round(start_rate, 9) AS start_rate FROM epi",
    "episode_checks": f"""WITH RECURSIVE {_PRIMARY}, s0 AS (SELECT * REPLACE (CASE WHEN start_day % 11 = 0 THEN duration_days + 1 WHEN start_day % 13 = 0 THEN -duration_days ELSE duration_days END AS duration_days,
  CASE WHEN start_day % 17 = 0 THEN 2 ELSE recovered END AS recovered, CASE WHEN start_day % 19 = 0 THEN 'spoiled' ELSE end_reason END AS end_reason) FROM epi),
s AS (SELECT * FROM s0 UNION ALL SELECT * FROM s0 WHERE start_day % 7 = 0)
SELECT count(*) AS episodes, count(*) FILTER (duration_days <> end_day - start_day + 1) AS wrong_duration, count(*) FILTER (duration_days < 1) AS non_positive, count(*) FILTER (recovered NOT IN (0, 1)) AS bad_flag,
count(*) FILTER (NOT CASE WHEN recovered = 1 THEN end_reason = '{R.RECOVERED}' ELSE end_reason IN ('{R.GAP}', '{R.LAST_DAY}') END) AS wrong_reason,
(SELECT count(*) FROM (SELECT 1 FROM s GROUP BY scenario, entity, start_day HAVING count(*) > 1)) AS repeated_starts FROM s""",
    "episode_sensitivity": f"""WITH RECURSIVE {_WALK}, a AS (SELECT scenario, count(*) AS qualifying_days, count(DISTINCT entity) AS entities FROM q GROUP BY 1),
b AS (SELECT scenario, count(*) AS episodes, CAST(sum(recovered) AS BIGINT) AS recoveries, median(duration_days) FILTER (recovered = 1) AS median_observed_days FROM epi GROUP BY 1)
SELECT scenario, qualifying_days, entities, episodes, recoveries, episodes - recoveries AS censored, median_observed_days FROM a LEFT JOIN b USING (scenario)""",
    "km_curve": f"""WITH RECURSIVE {_KM} SELECT cohort, t, at_risk, d AS events, n - d AS censored, round(survival, 8) AS survival, round(log_variance, 8) AS log_variance,
CASE WHEN survival > 0 AND survival < 1 THEN round(survival ** exp(-{_THETA}), 8) END AS survival_low, CASE WHEN survival > 0 AND survival < 1 THEN round(survival ** exp({_THETA}), 8) END AS survival_high FROM km""",
    "km_summary": f"""WITH RECURSIVE {_KM}, m AS (SELECT cohort, min(t) FILTER (survival <= 0.5)::DOUBLE AS median_days, 1 - coalesce(min(survival) FILTER (t <= 7), 1) AS b7, 1 - coalesce(min(survival) FILTER (t <= 14), 1) AS b14 FROM km GROUP BY 1),
c AS (SELECT cohort, count(*) AS episodes, CAST(sum(recovered) AS BIGINT) AS recoveries, count(*) FILTER (end_reason = '{R.GAP}') AS gap_censored, count(*) FILTER (duration_days >= 7) AS followed_to_7, count(*) FILTER (duration_days >= 14) AS followed_to_14 FROM co GROUP BY 1)
SELECT cohort, episodes, recoveries, episodes - recoveries AS censored, gap_censored, round(1 - recoveries::DOUBLE / episodes, 8) AS censoring_fraction, median_days, followed_to_7, followed_to_14,
CASE WHEN followed_to_7 > 0 THEN round(b7, 8) END AS recovered_by_7, CASE WHEN followed_to_14 > 0 THEN round(b14, 8) END AS recovered_by_14 FROM c JOIN m USING (cohort)""",
}
