"""Metric, review, bootstrap, error-analysis and baseline queries over the scored view."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions.draws import draw_sql
from skyledger.operators import baselines as BL
from skyledger.operators import explain as E
from skyledger.operators import metrics as M
from skyledger.operators import resampling as R
from skyledger.operators import review as V
from skyledger.operators.attach import attach_row
from skyledger.plans.oracle_views import FLIGHTS, SCORED, div
from skyledger.session import cut_lineage, stage
from skyledger.sources.adapters import flights, scored

SCORERS = {"model": "score", "alternative": "score_alt", "coarse": "score_coarse"}
FRACTIONS = [0.005, 0.01, 0.05, 0.10]
ALERTS = {"top1pct": 0.01, "top10pct": 0.10}
POINTS = {"capacity_0_5pct": 0.005, "capacity_1pct": 0.01, "capacity_5pct": 0.05, "capacity_10pct": 0.10}
SCHEMES = {"whole_period": [], "by_month": ["month"], "by_day": ["day"]}
EDGES = [120.0, 150.0, 180.0, 210.0]
RATIOS = [1.0, 5.0, 10.0, 50.0]
REPLICATES = 1000
BASE_DIMENSIONS = {"quarter": "quarter", "carrier": "carrier", "origin": "origin_group", "route_volume": "route_volume", "departure_hours": "departure_hours",
                   "weekday": "weekday", "completeness": "completeness", "score_decile": "score_decile"}
CONTEXT = ("carrier", "origin", "destination", "dep_hhmm", "arr_hhmm", "sched_elapsed", "distance")


def _round(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _validation(spark, folder, *extra):
    return scored(spark, folder, *extra).where(F.col("period") == "validation")


def binary_metrics(spark, folder):
    long = M.melt_scores(scored(spark, folder), SCORERS, "period", "label")
    return _round(M.binary_metrics(long, ["period", "scorer"]), "prevalence", "pr_auc", "lift", "roc_auc", "brier", "mean_score", digits=8)


def ranking_table(spark, folder):
    long = M.melt_scores(_validation(spark, folder), SCORERS, "label")
    return _round(M.ranking_table(long, ["scorer"], FRACTIONS), "events_captured", "false_alerts", "precision", "recall", "f1", "lift", digits=8)


def precision_at_k(spark, folder):
    return _round(M.precision_at(_validation(spark, folder), FRACTIONS), "precision", "recall")


def review_flags(spark, folder):
    ranked = V.review_ranks(_validation(spark, folder), ["day"])
    return ranked.select("flight_id", "review_rank", V.reviewed(0.05).alias("flag_5pct"), V.reviewed(0.10).alias("flag_10pct"))


def _capacity(spark, folder):
    return V.review_capacity(cut_lineage(_validation(spark, folder).select("flight_id", "score", "label", "month", "day")), SCHEMES)


def review_capacity(spark, folder):
    return _round(_capacity(spark, folder), "prevalence", "precision", "recall", "lift", "break_even_ratio")


def utility_table(spark, folder):
    return _round(V.utility(_capacity(spark, folder), RATIOS), "net_reduction", "random_reduction", "advantage_over_random", digits=6)


def bootstrap_review(spark, folder):
    ranked = V.review_ranks(_validation(spark, folder), ["day"])
    daily = V.capacity_sums(ranked, ["day"], V.CAPACITIES)
    return _round(R.review_bootstrap(daily, ["capacity"], "day", REPLICATES), "precision_low", "precision_high", "recall_low", "recall_high")


def bootstrap_brier(spark, folder):
    df = _validation(spark, folder)
    out = R.brier_bootstrap(df, "score", "score_alt", "day", REPLICATES)
    return _round(out, "brier_reference", "brier_challenger", "difference", "difference_low", "difference_high", "share_challenger_better")


def _bootstrap(long):
    draws = R.resampled_average_precision(long, "scorer", "day", REPLICATES)
    return R.bootstrap_summary(cut_lineage(draws), M.binary_metrics(long, ["scorer"]), "scorer", "alternative")


def _validation_scores(spark, folder):
    """Scores, label and day of the validation rows, read from the tables once; what uses them reads this table."""
    return M.melt_scores(stage(_validation(spark, folder).select(*SCORERS.values(), "label", "day")), SCORERS, "label", "day")


def bootstrap_ap(spark, folder):
    out = _bootstrap(_validation_scores(spark, folder))
    return _round(out, *[c for c in out.columns if c != "scorer"], digits=8)


def verdicts(spark, folder):
    out = _bootstrap(_validation_scores(spark, folder))
    gap = [F.col(c) for c in ("difference", "difference_low", "difference_high")]
    return out.where(F.col("difference").isNotNull()).select("scorer", M.verdict(*gap).alias("verdict"), M.material_verdict(*gap).alias("material_verdict"))


def pr_curve(spark, folder):
    long = M.melt_scores(_validation(spark, folder), SCORERS, "label")
    return _round(M.precision_recall_points(long, ["scorer"]), "score", "precision", "recall")


def reliability(spark, folder):
    df = scored(spark, folder).withColumn("probability", F.col("score"))
    return _round(M.reliability(df, ["period"]), "mean_predicted", "observed_rate")


def calibration_table(spark, folder):
    df = scored(spark, folder).withColumn("probability", F.col("score_alt"))
    return _round(M.calibration_table(df, ["period"]), "mean_predicted", "observed_rate")


def calibration_error(spark, folder):
    df = scored(spark, folder).withColumn("probability", F.col("score"))
    return _round(M.calibration_error(M.reliability(df, ["period"]), ["period"]), "ece")


def brier_skill(spark, folder):
    df = scored(spark, folder)
    rate = df.where(F.col("period") == "development").agg(F.avg("label").alias("fit_rate"))
    held = attach_row(df.withColumn("probability", F.col("score")), rate)
    return _round(M.probability_metrics(held, ["period"], F.col("fit_rate")), "brier", "brier_constant", "mean_predicted", "brier_skill", "predicted_to_observed")


def _labelled(spark, folder):
    df = scored(spark, folder, *CONTEXT)
    valid = E.dimensions(df.where(F.col("period") == "validation"), df.where(F.col("period") == "development"), 10)
    return valid.withColumn("probability", F.col("score") * 0.4)


def score_dimensions(spark, folder):
    return _labelled(spark, folder).select("flight_id", *BASE_DIMENSIONS.values())


def _groups(spark, folder):
    df = cut_lineage(_labelled(spark, folder))
    return M.group_metrics(df, BASE_DIMENSIONS, M.fraction_cutoffs(df, ALERTS), list(ALERTS))


def group_metrics(spark, folder):
    out = _groups(spark, folder)
    return _round(out, *[c for c, t in out.dtypes if t == "double"], digits=8)


def alert_concentration(spark, folder):
    out = M.alert_shares(_groups(spark, folder), "alert_rate_top10pct", 3, 50)
    return _round(out, "share_of_alerts", "share_of_rows", "share_of_events", "running_share", digits=8)


def severity_recall(spark, folder):
    df = _validation(spark, folder)
    out = M.severity_recall(df, M.fraction_cutoffs(df, ALERTS), list(ALERTS), EDGES)
    return _round(out, *[f"recall_{a}" for a in ALERTS], "share_of_events")


def operating_points(spark, folder):
    df = stage(scored(spark, folder).where(F.col("period") != "development").select("period", "score", "label"))
    points = M.learn_cutoffs(df.where(F.col("period") == "validation"), POINTS)
    out = M.confusion(df, points, ["period"])
    return _round(out, "cutoff_score", "alert_rate", "precision", "recall", "f1", "specificity")


def case_selection(spark, folder):
    return _round(E.select_cases(_validation(spark, folder)), "score")


def rank_corr(spark, folder):
    return _round(M.rank_correlation(_validation(spark, folder), "score", "score_coarse"), "spearman", "pearson", digits=8)


def _with_route(df):
    return df.withColumn("route", F.concat_ws("-", "origin", "destination"))


def _rates(spark, folder):
    df = _with_route(stage(scored(spark, folder, "carrier", "origin", "destination").select("flight_id", "period", "label", "carrier", "origin", "destination")))
    fit, apply = df.where(F.col("period") == "development"), df.where(F.col("period") != "development")
    return BL.rate_baselines(fit, apply)


BASELINES = ("prevalence", "carrier_rate", "origin_rate", "destination_rate", "route_rate")


def rate_baselines(spark, folder):
    return _round(_rates(spark, folder).select("flight_id", *BASELINES), *BASELINES, digits=8)


def constant_baselines(spark, folder):
    df = scored(spark, folder)
    fit = df.where(F.col("period") == "development")
    held = attach_row(df.where(F.col("period") == "validation"), BL.constant_baselines(fit, "label", "arr_delay"))
    out = held.groupBy("prevalence", "mean_delay", "median_delay").agg(
        F.count("*").alias("rows"), F.avg(F.abs(F.col("arr_delay") - F.col("mean_delay"))).alias("mae_mean"),
        F.avg(F.abs(F.col("arr_delay") - F.col("median_delay"))).alias("mae_median"), F.avg(F.pow(F.col("prevalence") - F.col("label"), F.lit(2))).alias("brier"))
    return _round(out, "prevalence", "mean_delay", "mae_mean", "mae_median", "brier")


def regression_metrics(spark, folder):
    """A carrier-mean delay prediction, scored per period."""
    df = stage(scored(spark, folder, "carrier").select("period", "carrier", "arr_delay"))
    means = df.where(F.col("period") == "development").groupBy("carrier").agg(F.avg("arr_delay").alias("predicted"))
    return _round(M.regression_metrics(df.join(means, "carrier"), ["period"], "arr_delay", "predicted", 120.0), "mae", "rmse", "bias", "severe_mae", "median_ae", digits=7)


def best_baseline(spark, folder):
    df = _rates(spark, folder)
    long = M.melt_scores(stage(df.select("period", "label", *BASELINES)), {b: b for b in BASELINES}, "period", "label")
    valid = M.binary_metrics(long.where(F.col("period") == "validation"), ["scorer"])
    best = BL.best_scorer(valid, list(BASELINES[1:]))
    final = attach_row(M.binary_metrics(long.where(F.col("period") == "final_test"), ["scorer"]), best).where(F.col("scorer") == F.col("best_baseline"))
    return _round(final.select("best_baseline", F.col("best_pr_auc").alias("validation_pr_auc"), F.col("pr_auc").alias("final_pr_auc"), "rows", "events"),
                  "validation_pr_auc", "final_pr_auc", digits=7)


def _targets(spark, folder):
    """Both targets in one long table: severe delay among completed flights, cancellation among all."""
    df = flights(spark, folder, "flight_id", "flight_date", "cancelled", "diverted", "arr_delay", "score", "score_coarse").where(F.year("flight_date") >= 2001)
    done = (F.col("cancelled") == 0) & (F.col("diverted") == 0) & F.col("arr_delay").isNotNull()
    targets = F.explode(F.array_compact(F.array(
        F.when(done, F.struct(F.lit("severe_delay").alias("target"), (F.col("arr_delay") >= 120).cast("int").alias("label"))),
        F.struct(F.lit("cancellation").alias("target"), F.col("cancelled").cast("int").alias("label")))))
    return df.select("flight_id", F.unix_date("flight_date").alias("day"), "score", "score_coarse", targets.alias("t")).select("flight_id", "day", "score", "score_coarse", "t.target", "t.label")


def final_report(spark, folder):
    """The three stated claims per target: skill over chance, better than the reference scorer, and by-day precision above the event rate."""
    df = cut_lineage(_targets(spark, folder))
    claims = None
    for target in ("severe_delay", "cancellation"):
        rows = df.where(F.col("target") == target)
        long = M.melt_scores(rows, {"model": "score", "reference": "score_coarse"}, "label", "day")
        draws = cut_lineage(R.resampled_average_precision(long, "scorer", "day", REPLICATES))
        summary = R.bootstrap_summary(draws, M.binary_metrics(long, ["scorer"]), "scorer", "reference").where(F.col("scorer") == "model")
        daily = V.capacity_sums(V.review_ranks(rows, ["day"]), ["day"], {"10%": 0.10})
        review = R.review_bootstrap(daily, ["capacity"], "day", REPLICATES).select("precision_low")
        joined = attach_row(attach_row(summary, review), rows.agg(F.avg("label").alias("event_rate")))
        stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("claim"), v.alias("lower_bound"), b.alias("must_exceed")) for n, v, b in (
            ("skill_over_chance", F.col("lift_low"), F.lit(1.0)), ("beats_reference", F.col("difference_low"), F.lit(0.0)),
            ("not_only_seasonal", F.col("precision_low"), F.col("event_rate")))]))
        part = joined.select(F.lit(target).alias("target"), stacked.alias("c")).select("target", "c.*", (F.col("c.lower_bound") > F.col("c.must_exceed")).alias("supported"))
        claims = part if claims is None else claims.unionByName(part)
    return _round(claims, "lower_bound", "must_exceed", digits=8)


QUERIES = {f.__name__: f for f in (
    binary_metrics, ranking_table, precision_at_k, review_flags, review_capacity, utility_table, bootstrap_review, bootstrap_brier, bootstrap_ap, verdicts,
    pr_curve, reliability, calibration_table, calibration_error, brier_skill, score_dimensions, group_metrics, alert_concentration, severity_recall,
    operating_points, case_selection, rank_corr, rate_baselines, constant_baselines, regression_metrics, best_baseline, final_report)}

_LONG = SCORED + ", lg AS (" + " UNION ALL ".join(f"SELECT flight_id, period, day, label, '{n}' AS scorer, {c} AS score FROM scored" for n, c in SCORERS.items()) + ")"


def _curve(source: str, keys: str, name: str = "cv") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""sg_{name} AS (SELECT {lead}score, count(*) AS n, sum(label) AS e FROM {source} GROUP BY ALL),
{name} AS (SELECT *, sum(n) OVER ({part} ORDER BY score DESC) AS cn, sum(e) OVER ({part} ORDER BY score DESC) AS ce, sum(n) OVER ({part}) AS tn, sum(e) OVER ({part}) AS te FROM sg_{name})"""


def _metrics(keys: str, name: str = "cv", digits: int = 8) -> str:
    return f"""SELECT {keys}, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(e) AS BIGINT) AS events, round(sum(e)::DOUBLE / sum(n), {digits}) AS prevalence,
round(sum(e::DOUBLE / te * ce / cn), {digits}) AS pr_auc, round(sum(e::DOUBLE / te * ce / cn) / (sum(e)::DOUBLE / sum(n)), {digits}) AS lift,
round(sum((n - e) * (ce - e / 2.0))::DOUBLE / (sum(e) * (sum(n) - sum(e))), {digits}) AS roc_auc,
round(sum(e * (score - 1) ** 2 + (n - e) * score ** 2) / sum(n), {digits}) AS brier, round(sum(n * score) / sum(n), {digits}) AS mean_score FROM {name} GROUP BY ALL"""


def _weights(source: str, name: str = "") -> str:
    return f"""dy{name} AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS nd FROM (SELECT DISTINCT day FROM {source})),
dw{name} AS (SELECT b, day, w FROM (SELECT b, {draw_sql('b', 'pos', 'nd')} AS pos, count(*) AS w FROM dy{name}, range(0, {REPLICATES}) r(b) GROUP BY 1, 2) JOIN dy{name} USING (pos))"""


def _ap_draws(source: str, name: str = "") -> str:
    return f"""{_weights(source, name)},
bs{name} AS (SELECT scorer, b, score, sum(w * n) AS n, sum(w * e) AS e FROM (SELECT scorer, score, day, count(*) AS n, sum(label) AS e FROM {source} GROUP BY ALL) JOIN dw{name} USING (day) GROUP BY ALL),
bc{name} AS (SELECT *, sum(n) OVER (PARTITION BY scorer, b ORDER BY score DESC) AS cn, sum(e) OVER (PARTITION BY scorer, b ORDER BY score DESC) AS ce, sum(n) OVER (PARTITION BY scorer, b) AS tn, sum(e) OVER (PARTITION BY scorer, b) AS te FROM bs{name}),
ap{name} AS (SELECT scorer, b, sum(e::DOUBLE / te * ce / cn) AS pr_auc, sum(e::DOUBLE / te * ce / cn) / (any_value(te)::DOUBLE / any_value(tn)) AS lift FROM bc{name} GROUP BY 1, 2)"""


def _ap_summary(reference: str, name: str = "", curve: str = "cv") -> str:
    return f"""pt{name} AS (SELECT scorer, sum(e::DOUBLE / te * ce / cn) AS pr_auc, sum(e::DOUBLE / te * ce / cn) / (sum(e)::DOUBLE / sum(n)) AS lift FROM {curve} GROUP BY 1),
pair{name} AS (SELECT a.*, a.pr_auc - r.pr_auc AS difference FROM ap{name} a JOIN ap{name} r ON a.b = r.b AND r.scorer = '{reference}'),
qs{name} AS (SELECT scorer, quantile_cont(pr_auc, 0.025) AS pr_auc_low, quantile_cont(pr_auc, 0.975) AS pr_auc_high, quantile_cont(lift, 0.025) AS lift_low, quantile_cont(lift, 0.975) AS lift_high,
  quantile_cont(difference, 0.025) AS difference_low, quantile_cont(difference, 0.975) AS difference_high, avg(CASE WHEN difference > 0 THEN 1.0 ELSE 0 END) AS share_better FROM pair{name} GROUP BY 1),
sm{name} AS (SELECT pt{name}.*, qs{name}.* EXCLUDE (scorer), pt{name}.pr_auc - (SELECT pr_auc FROM pt{name} WHERE scorer = '{reference}') AS difference FROM pt{name} JOIN qs{name} USING (scorer))"""


_VAL = SCORED + ", v AS (SELECT * FROM scored WHERE period = 'validation')"
_VLONG = _LONG + ", vl AS (SELECT * FROM lg WHERE period = 'validation')"
_K = "CAST(least(tn, greatest(1, round_even({f} * tn, 0))) AS BIGINT)"


def _ranking(f: float) -> str:
    k = _K.format(f=repr(f) + "::DOUBLE")
    return f"""SELECT scorer, {f}::DOUBLE AS fraction, {k} AS reviewed, (ce - e + e * ({k} - (cn - n))::DOUBLE / n) AS c, te, tn FROM cv WHERE cn - n < {k} AND {k} <= cn"""


def _review_count(f: float, n: str) -> str:
    return f"least({n}, greatest(1, CAST(ceil({f}::DOUBLE * {n} - 1e-9) AS BIGINT)))"


def _ranked(group: str) -> str:
    part = f"PARTITION BY {group}" if group else ""
    return f"(SELECT *, row_number() OVER ({part} ORDER BY score DESC, flight_id) AS rk, count(*) OVER ({part}) AS sz FROM v)"


_CAP = ", cap AS (" + " UNION ALL ".join(
    f"""SELECT '{s}' AS scheme, '{n}' AS capacity, {f}::DOUBLE AS fraction, count(*) AS flights, CAST(sum(label) AS BIGINT) AS events, count(*) FILTER (rk <= {_review_count(f, 'sz')}) AS reviewed,
CAST(coalesce(sum(label) FILTER (rk <= {_review_count(f, 'sz')}), 0) AS BIGINT) AS events_captured FROM {_ranked(g)}"""
    for s, g in (("whole_period", ""), ("by_month", "month"), ("by_day", "day")) for n, f in V.CAPACITIES.items()) + """),
capr AS (SELECT *, events::DOUBLE / flights AS prevalence, reviewed - events_captured AS false_alerts, events - events_captured AS events_missed, events_captured::DOUBLE / reviewed AS precision,
  events_captured::DOUBLE / events AS recall, events_captured::DOUBLE / reviewed / (events::DOUBLE / flights) AS lift,
  CASE WHEN events_captured > 0 THEN (reviewed - events_captured)::DOUBLE / events_captured ELSE 'Infinity'::DOUBLE END AS break_even_ratio FROM cap)"""


def _daily(source: str, capacities: dict[str, float]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS capacity, day, count(*) FILTER (rk <= {_review_count(f, 'sz')}) AS reviewed, coalesce(sum(label) FILTER (rk <= {_review_count(f, 'sz')}), 0) AS captured, sum(label) AS events
FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, flight_id) AS rk, count(*) OVER (PARTITION BY day) AS sz FROM {source}) GROUP BY day""" for n, f in capacities.items())


_BANDS = "CASE WHEN arr_delay < 120 THEN NULL WHEN arr_delay < 150 THEN '[120, 150)' WHEN arr_delay < 180 THEN '[150, 180)' WHEN arr_delay < 210 THEN '[180, 210)' ELSE '[210, inf)' END"


def _cutoff(f: float, name: str = "cv") -> str:
    k = _K.format(f=repr(f) + "::DOUBLE")
    return f"(SELECT max(score) FROM {name} WHERE cn - n < {k} AND {k} <= cn)"


_HOUR = "floor(dep_hhmm / 100)"
_DIM = _VAL + f""", dev AS (SELECT * FROM scored WHERE period = 'development'),
top AS (SELECT origin FROM v GROUP BY 1 ORDER BY count(*) DESC, origin LIMIT 10), vol AS (SELECT origin, destination, count(*) AS vn FROM dev GROUP BY 1, 2), seen AS (SELECT DISTINCT carrier FROM dev),
rk AS (SELECT v.*, vn, seen.carrier AS sc, top.origin AS tp, row_number() OVER (ORDER BY score, flight_id) AS r, count(*) OVER () AS c FROM v LEFT JOIN vol ON vol.origin = v.origin AND vol.destination = v.destination
  LEFT JOIN seen ON seen.carrier = v.carrier LEFT JOIN top ON top.origin = v.origin),
dm AS (SELECT *, CAST(greatest(1, ceil((r - 1) * 10 / greatest(c - 1, 1)::DOUBLE - 1e-9)) AS INT) AS dc, sc IS NULL OR vn IS NULL AS un, dep_hhmm IS NULL OR dep_hhmm = 2400 OR arr_hhmm IS NULL OR arr_hhmm = 2400 OR sched_elapsed IS NULL OR distance IS NULL AS ms FROM rk),
dim AS (SELECT flight_id, label, score, score * 0.4 AS probability, carrier, year(flight_date) || 'Q' || quarter(flight_date) AS quarter, coalesce(tp, 'all other airports') AS origin_group,
  CASE WHEN vn IS NULL THEN 'unseen route' WHEN vn < 100 THEN '1-99' WHEN vn < 1000 THEN '100-999' ELSE '1000 or more' END AS route_volume,
  CASE WHEN dep_hhmm IS NULL OR dep_hhmm = 2400 THEN 'unknown' WHEN {_HOUR} < 6 THEN '00-05' WHEN {_HOUR} < 10 THEN '06-09' WHEN {_HOUR} < 14 THEN '10-13' WHEN {_HOUR} < 18 THEN '14-17' ELSE '18-23' END AS departure_hours,
  CAST(isodow(flight_date) - 1 AS STRING) AS weekday, CASE WHEN un AND ms THEN 'unseen category and missing number' WHEN un THEN 'unseen category' WHEN ms THEN 'missing number' ELSE 'complete' END AS completeness,
  'decile ' || lpad(CAST(dc AS STRING), 2, '0') || CASE dc WHEN 1 THEN ' (lowest)' WHEN 10 THEN ' (highest)' ELSE '' END AS score_decile FROM dm)"""
_GROUPS = _DIM + ", " + _curve("v", "", "all_cv") + ", st AS (" + " UNION ALL ".join(
    f'SELECT \'{n}\' AS dimension, {c} AS "group", label, score, probability FROM dim' for n, c in BASE_DIMENSIONS.items()) + "), cut AS (SELECT " + ", ".join(
    f"{_cutoff(f, 'all_cv')} AS {a}" for a, f in ALERTS.items()) + """), gs AS (SELECT dimension, "group", score, count(*) AS n, sum(label) AS e, sum(probability) AS sp, sum((probability - label) ** 2) AS sq FROM st GROUP BY ALL),
gc AS (SELECT gs.*, cut.*, sum(n) OVER w AS cn, sum(e) OVER w AS ce, sum(e) OVER (PARTITION BY dimension, "group") AS te FROM gs, cut WINDOW w AS (PARTITION BY dimension, "group" ORDER BY score DESC)),
gt AS (SELECT dimension, "group", sum(n) AS rows, sum(e) AS events, sum(n * score) / sum(n) AS mean_score, sum(sp) / sum(n) AS mean_probability, sum(sq) / sum(n) AS brier_probability, sum(e::DOUBLE / nullif(te, 0) * ce / cn) AS ap, """ + ", ".join(
    f"coalesce(sum(n) FILTER (score >= {a}), 0) AS f_{a}, coalesce(sum(e) FILTER (score >= {a}), 0) AS t_{a}" for a in ALERTS) + " FROM gc GROUP BY ALL)"
_GROUP_SELECT = """SELECT dimension, "group", CAST(rows AS BIGINT) AS rows, round(rows::DOUBLE / (SELECT count(*) FROM v), 8) AS share_of_rows, CAST(events AS BIGINT) AS events, round(events::DOUBLE / rows, 8) AS prevalence,
round(mean_score, 8) AS mean_score, round(mean_probability, 8) AS mean_probability, round(mean_probability / nullif(events::DOUBLE / rows, 0), 8) AS probability_to_observed, round(brier_probability, 8) AS brier_probability, """ + ", ".join(
    f"round(f_{a}::DOUBLE / rows, 8) AS alert_rate_{a}, round(t_{a}::DOUBLE / nullif(f_{a}, 0), 8) AS precision_{a}, round(t_{a}::DOUBLE / nullif(events, 0), 8) AS recall_{a}" for a in ALERTS) + """,
CASE WHEN events >= 30 AND rows - events >= 30 THEN round(ap, 8) END AS pr_auc, CASE WHEN events >= 30 AND rows - events >= 30 THEN round(ap / (events::DOUBLE / rows), 8) END AS lift, NOT (events >= 30 AND rows - events >= 30) AS small_sample FROM gt"""

_RATES = SCORED + ", rt AS (SELECT *, origin || '-' || destination AS route FROM scored), fit AS (SELECT * FROM rt WHERE period = 'development'), ov AS (SELECT avg(label) AS p FROM fit), " + ", ".join(
    f"r_{k} AS (SELECT {k}, (sum(label) + 50 * any_value(p)) / (count(*) + 50) AS rate FROM fit, ov GROUP BY 1)" for k in BL.KEYS.values()) + """,
rb AS (SELECT flight_id, period, label, p AS prevalence, coalesce(a.rate, p) AS carrier_rate, coalesce(b.rate, p) AS origin_rate, coalesce(c.rate, p) AS destination_rate, coalesce(d.rate, b.rate, p) AS route_rate
  FROM rt CROSS JOIN ov LEFT JOIN r_carrier a USING (carrier) LEFT JOIN r_origin b USING (origin) LEFT JOIN r_destination c USING (destination) LEFT JOIN r_route d USING (route) WHERE period <> 'development')"""


def _binned(column: str, number: str) -> str:
    return f"""bn AS (SELECT period, label, {column} AS p, row_number() OVER (PARTITION BY period ORDER BY {column}, flight_id) AS r, count(*) OVER (PARTITION BY period) AS c,
  ntile(10) OVER (PARTITION BY period ORDER BY {column}, flight_id) AS nt FROM scored),
bt AS (SELECT period, CAST({number} AS INT) AS bin, count(*) AS rows, CAST(sum(label) AS BIGINT) AS events, avg(p) AS mean_predicted, avg(label) AS observed_rate FROM bn GROUP BY 1, 2)"""


_BIN_OUT = "SELECT period, bin, rows, events, round(mean_predicted, 9) AS mean_predicted, round(observed_rate, 9) AS observed_rate FROM bt"


def _claims(target: str, source: str) -> str:
    n = "_" + target[:3]
    return f"""s{n} AS ({source}), l{n} AS (SELECT label, day, 'model' AS scorer, score FROM s{n} UNION ALL SELECT label, day, 'reference', score_coarse FROM s{n}),
{_curve('l' + n, 'scorer', 'cv' + n)}, {_ap_draws('l' + n, n)}, {_ap_summary('reference', n, 'cv' + n)},
pq{n} AS (SELECT quantile_cont(pc, 0.025) AS low FROM (SELECT b, sum(captured * w)::DOUBLE / sum(reviewed * w) AS pc FROM ({_daily('s' + n, {'10%': 0.10})}) JOIN dw{n} USING (day) GROUP BY 1)),
cl{n} AS (SELECT '{target}' AS target, 'skill_over_chance' AS claim, lift_low AS lower_bound, 1.0::DOUBLE AS must_exceed FROM sm{n} WHERE scorer = 'model'
 UNION ALL SELECT '{target}', 'beats_reference', difference_low, 0.0 FROM sm{n} WHERE scorer = 'model' UNION ALL SELECT '{target}', 'not_only_seasonal', low, (SELECT avg(label) FROM s{n}) FROM pq{n})"""


SQL = {
    "binary_metrics": f"WITH {_LONG}, {_curve('lg', 'period, scorer')} {_metrics('period, scorer')}",
    "ranking_table": f"WITH {_VLONG}, {_curve('vl', 'scorer')}, rr AS (" + " UNION ALL ".join(_ranking(f) for f in FRACTIONS) + """)
SELECT scorer, fraction, reviewed, round(c, 8) AS events_captured, round(reviewed - c, 8) AS false_alerts, round(c / reviewed, 8) AS precision, round(c / te, 8) AS recall,
round(CASE WHEN c > 0 THEN 2 * (c / reviewed) * (c / te) / (c / reviewed + c / te) ELSE 0 END, 8) AS f1, round(c / reviewed / (te::DOUBLE / tn), 8) AS lift FROM rr""",
    "precision_at_k": f"WITH {_VAL}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, flight_id) AS rk, count(*) OVER () AS c FROM v) " + " UNION ALL ".join(
        f"""SELECT {f}::DOUBLE AS fraction, CAST(ceil({f}::DOUBLE * any_value(c)) AS BIGINT) AS reviewed, CAST(sum(label) FILTER (rk <= ceil({f}::DOUBLE * c)) AS BIGINT) AS captured,
round(sum(label) FILTER (rk <= ceil({f}::DOUBLE * c)) / ceil({f}::DOUBLE * any_value(c)), 9) AS precision, round(sum(label) FILTER (rk <= ceil({f}::DOUBLE * c))::DOUBLE / sum(label), 9) AS recall FROM r""" for f in FRACTIONS),
    "review_flags": f"WITH {_VAL} SELECT flight_id, rk AS review_rank, rk <= {_review_count(0.05, 'sz')} AS flag_5pct, rk <= {_review_count(0.10, 'sz')} AS flag_10pct FROM {_ranked('day')}",
    "review_capacity": f"""WITH {_VAL}{_CAP} SELECT scheme, capacity, fraction, flights, events, reviewed, events_captured, round(prevalence, 9) AS prevalence, false_alerts, events_missed, round(precision, 9) AS precision,
round(recall, 9) AS recall, round(lift, 9) AS lift, round(break_even_ratio, 9) AS break_even_ratio FROM capr""",
    "utility_table": f"""WITH {_VAL}{_CAP}, u AS (SELECT *, unnest([1.0, 5.0, 10.0, 50.0]::DOUBLE[]) AS miss_ratio, reviewed * prevalence AS ch FROM capr),
x AS (SELECT *, miss_ratio * events_captured - false_alerts AS net, miss_ratio * ch - (reviewed - ch) AS rnd FROM u)
SELECT scheme, capacity, miss_ratio, reviewed, events_captured, false_alerts, round(net, 6) AS net_reduction, round(rnd, 6) AS random_reduction, round(net - rnd, 6) AS advantage_over_random, net > 0 AS pays_off FROM x""",
    "bootstrap_review": f"""WITH {_VAL}, {_weights('v')}, dd AS ({_daily('v', V.CAPACITIES)}),
bb AS (SELECT capacity, b, sum(captured * w)::DOUBLE / sum(reviewed * w) AS pc, sum(captured * w)::DOUBLE / sum(events * w) AS rc FROM dd JOIN dw USING (day) GROUP BY 1, 2)
SELECT capacity, round(quantile_cont(pc, 0.025), 9) AS precision_low, round(quantile_cont(pc, 0.975), 9) AS precision_high, round(quantile_cont(rc, 0.025), 9) AS recall_low, round(quantile_cont(rc, 0.975), 9) AS recall_high FROM bb GROUP BY 1""",
    "bootstrap_brier": f"""WITH {_VAL}, {_weights('v')}, dd AS (SELECT day, count(*) AS n, sum((score - label) ** 2) AS a, sum((score_alt - label) ** 2) AS c FROM v GROUP BY 1),
bb AS (SELECT b, (sum(c * w) - sum(a * w)) / sum(n * w) AS d FROM dd JOIN dw USING (day) GROUP BY 1), p AS (SELECT sum(a) / sum(n) AS ra, sum(c) / sum(n) AS rc FROM dd)
SELECT round(any_value(ra), 9) AS brier_reference, round(any_value(rc), 9) AS brier_challenger, round(any_value(rc) - any_value(ra), 9) AS difference, round(quantile_cont(d, 0.025), 9) AS difference_low,
round(quantile_cont(d, 0.975), 9) AS difference_high, round(avg(CASE WHEN d < 0 THEN 1.0 ELSE 0 END), 9) AS share_challenger_better, count(*) AS replicates FROM bb, p""",
    "bootstrap_ap": f"""WITH {_VLONG}, {_curve('vl', 'scorer')}, {_ap_draws('vl')}, {_ap_summary('alternative')} SELECT scorer, """ + ", ".join(
        f"round({c}, 8) AS {c}" for c in ("pr_auc", "pr_auc_low", "pr_auc_high", "lift", "lift_low", "lift_high")) + ", " + ", ".join(
        f"CASE WHEN scorer <> 'alternative' THEN round({c}, 8) END AS {c}" for c in ("difference", "difference_low", "difference_high", "share_better")) + " FROM sm",
    "verdicts": f"""WITH {_VLONG}, {_curve('vl', 'scorer')}, {_ap_draws('vl')}, {_ap_summary('alternative')} SELECT scorer, CASE WHEN difference_low > 0 THEN 'better' WHEN difference_high < 0 THEN 'worse' ELSE 'no_clear_difference' END AS verdict,
CASE WHEN difference_high < 0 THEN CASE WHEN abs(difference) < 0.0005 THEN 'falls_but_tiny' ELSE 'falls' END WHEN difference_low > 0 THEN CASE WHEN abs(difference) < 0.0005 THEN 'rises_but_tiny' ELSE 'rises' END ELSE 'no_clear_change' END AS material_verdict
FROM sm WHERE scorer <> 'alternative'""",
    "pr_curve": f"""WITH {_VLONG}, {_curve('vl', 'scorer')} SELECT scorer, round(score, 9) AS score, CAST(cn AS BIGINT) AS flagged, CAST(ce AS BIGINT) AS captured, round(ce::DOUBLE / cn, 9) AS precision, round(ce::DOUBLE / te, 9) AS recall FROM cv""",
    "reliability": f"WITH {SCORED}, {_binned('score', 'nt')} {_BIN_OUT}",
    "calibration_table": f"WITH {SCORED}, {_binned('score_alt', 'greatest(1, ceil((r - 1) * 10 / greatest(c - 1, 1)::DOUBLE - 1e-9))')} {_BIN_OUT}",
    "calibration_error": f"WITH {SCORED}, {_binned('score', 'nt')} SELECT period, round(sum(rows * abs(mean_predicted - observed_rate)) / sum(rows), 9) AS ece FROM bt GROUP BY 1",
    "brier_skill": f"""WITH {SCORED}, q AS (SELECT avg(label) AS p FROM scored WHERE period = 'development'), m AS (SELECT period, count(*) AS rows, CAST(sum(label) AS BIGINT) AS events, avg((score - label) ** 2) AS brier, avg((p - label) ** 2) AS brier_constant, avg(score) AS mean_predicted FROM scored, q GROUP BY 1)
SELECT period, rows, events, round(brier, 9) AS brier, round(brier_constant, 9) AS brier_constant, round(mean_predicted, 9) AS mean_predicted, round(1 - brier / brier_constant, 9) AS brier_skill, round(mean_predicted / (events::DOUBLE / rows), 9) AS predicted_to_observed FROM m""",
    "score_dimensions": f"WITH {_DIM} SELECT flight_id, " + ", ".join(BASE_DIMENSIONS.values()) + " FROM dim",
    "group_metrics": f"WITH {_GROUPS} {_GROUP_SELECT}",
    "alert_concentration": f"""WITH {_GROUPS}, g AS ({_GROUP_SELECT}), a AS (SELECT *, round(rows * (SELECT f_top10pct::DOUBLE / rows FROM gt WHERE gt.dimension = g.dimension AND gt."group" = g."group"), 6) AS alerts FROM g WHERE rows >= 50),
s AS (SELECT *, alerts / sum(alerts) OVER d AS sa, rows::DOUBLE / sum(rows) OVER d AS sr, events::DOUBLE / sum(events) OVER d AS se FROM a WINDOW d AS (PARTITION BY dimension)),
o AS (SELECT *, row_number() OVER w AS rank, sum(sa) OVER (w ROWS UNBOUNDED PRECEDING) AS rs FROM s WINDOW w AS (PARTITION BY dimension ORDER BY alerts DESC, "group"))
SELECT dimension, CAST(rank AS INT) AS rank, "group", rows, alerts, round(sa, 8) AS share_of_alerts, round(sr, 8) AS share_of_rows, round(se, 8) AS share_of_events, round(rs, 8) AS running_share FROM o WHERE rank <= 3""",
    "severity_recall": f"""WITH {_VAL}, {_curve('v', '')}, b AS (SELECT score, {_BANDS} AS band FROM v WHERE label = 1)
SELECT band, count(*) AS events, """ + ", ".join(f"round(avg(CASE WHEN score >= {_cutoff(f)} THEN 1.0 ELSE 0 END), 9) AS recall_{a}" for a, f in ALERTS.items()) + """,
round(count(*)::DOUBLE / (SELECT count(*) FROM b), 9) AS share_of_events, count(*) < 30 AS small_sample FROM b GROUP BY 1""",
    "operating_points": f"""WITH {_VAL}, {_curve('v', '')}, pts AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS operating_point, {_cutoff(f)} AS cutoff_score" for n, f in POINTS.items()) + """
 UNION ALL (SELECT 'f1_optimal', score FROM cv ORDER BY 2.0 * ce / (cn + te) DESC, score LIMIT 1)),
c AS (SELECT period, operating_point, cutoff_score, count(*) AS flights, CAST(sum(label) AS BIGINT) AS events, count(*) FILTER (score >= cutoff_score) AS flagged, CAST(coalesce(sum(label) FILTER (score >= cutoff_score), 0) AS BIGINT) AS true_positives
  FROM scored, pts WHERE period <> 'development' GROUP BY 1, 2, 3)
SELECT period, operating_point, round(cutoff_score, 9) AS cutoff_score, flights, events, flagged, true_positives, flagged - true_positives AS false_positives, events - true_positives AS false_negatives,
flights - flagged - events + true_positives AS true_negatives, round(flagged::DOUBLE / flights, 9) AS alert_rate, round(true_positives::DOUBLE / flagged, 9) AS precision, round(true_positives::DOUBLE / events, 9) AS recall,
round(2.0 * true_positives::DOUBLE / (flagged + events), 9) AS f1, round((flights - flagged - events + true_positives)::DOUBLE / (flights - events), 9) AS specificity FROM c""",
    "case_selection": f"""WITH {_VAL}, r AS (SELECT flight_id, score, label, row_number() OVER (ORDER BY score DESC, flight_id) AS rank, count(*) OVER () AS n FROM v),
pl AS (SELECT *, CASE WHEN rank <= greatest(1, round_even(0.01 * n, 0)) THEN CASE label WHEN 1 THEN 'true_positive' ELSE 'false_positive' END
  WHEN rank > greatest(1, round_even(0.1 * n, 0)) AND label = 1 THEN 'false_negative' WHEN label = 0 AND rank > n / 2.0 THEN 'low_risk_correct' END AS pool FROM r),
ex AS (SELECT *, 'high_confidence_false_positive' AS category, 'highest_scoring_non_event' AS pick FROM (SELECT * FROM r WHERE label = 0 ORDER BY rank LIMIT 3)
  UNION ALL SELECT *, 'high_confidence_false_negative', 'lowest_scoring_event' FROM (SELECT * FROM r WHERE label = 1 ORDER BY rank DESC LIMIT 3)),
m AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY rank) AS place, count(*) OVER (PARTITION BY pool) AS size FROM pl WHERE pool IS NOT NULL),
fr AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY place) AS free FROM m WHERE flight_id NOT IN (SELECT flight_id FROM ex)),
wi AS (SELECT pool, i, round_even(i * 0.25 * (size - 1), 0) + 1 AS start FROM (SELECT DISTINCT pool, size FROM m), (SELECT unnest([1, 2, 3]) AS i)),
wb AS (SELECT wi.pool, i, count(*) FILTER (place < start) + 1 AS b FROM wi JOIN fr ON fr.pool = wi.pool GROUP BY 1, 2),
wp AS (SELECT pool, i, i + max(b - i) OVER (PARTITION BY pool ORDER BY i) AS free FROM wb)
SELECT flight_id, category, pick, rank, round(score, 9) AS score, label FROM ex UNION ALL
SELECT flight_id, pool, 'typical_q' || i * 25, rank, round(score, 9), label FROM fr JOIN wp USING (pool, free)""",
    "rank_corr": f"""WITH {_VAL}, r AS (SELECT score, score_coarse, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY score_coarse) + (count(*) OVER (PARTITION BY score_coarse) - 1) / 2.0 AS b FROM v)
SELECT count(*) AS rows, round(corr(a, b), 8) AS spearman, round(corr(score, score_coarse), 8) AS pearson FROM r""",
    "rate_baselines": f"WITH {_RATES} SELECT flight_id, " + ", ".join(f"round({b}, 8) AS {b}" for b in BASELINES) + " FROM rb",
    "constant_baselines": f"""WITH {SCORED}, f AS (SELECT avg(label) AS prevalence, avg(arr_delay) AS mean_delay, median(arr_delay) AS median_delay FROM scored WHERE period = 'development')
SELECT round(any_value(prevalence), 9) AS prevalence, round(any_value(mean_delay), 9) AS mean_delay, any_value(median_delay) AS median_delay, count(*) AS rows, round(avg(abs(arr_delay - mean_delay)), 9) AS mae_mean,
round(avg(abs(arr_delay - median_delay)), 9) AS mae_median, round(avg((prevalence - label) ** 2), 9) AS brier FROM scored, f WHERE period = 'validation'""",
    "regression_metrics": f"""WITH {SCORED}, m AS (SELECT carrier, avg(arr_delay) AS p FROM scored WHERE period = 'development' GROUP BY 1), x AS (SELECT period, arr_delay, p - arr_delay AS d FROM scored JOIN m USING (carrier))
SELECT period, count(*) AS rows, round(avg(abs(d)), 7) AS mae, round(sqrt(avg(d * d)), 7) AS rmse, round(avg(d), 7) AS bias, round(avg(abs(d)) FILTER (arr_delay >= 120), 7) AS severe_mae, round(median(abs(d)), 7) AS median_ae FROM x GROUP BY 1""",
    "best_baseline": f"""WITH {_RATES}, bl AS (""" + " UNION ALL ".join(f"SELECT period, label, '{b}' AS scorer, {b} AS score FROM rb" for b in BASELINES[1:]) + f"""), {_curve('bl', 'period, scorer')},
mm AS (SELECT period, scorer, sum(n) AS rows, sum(e) AS events, sum(e::DOUBLE / te * ce / cn) AS pr_auc FROM cv GROUP BY 1, 2), bb AS (SELECT scorer, pr_auc FROM mm WHERE period = 'validation' ORDER BY pr_auc DESC, scorer LIMIT 1)
SELECT bb.scorer AS best_baseline, round(bb.pr_auc, 7) AS validation_pr_auc, round(mm.pr_auc, 7) AS final_pr_auc, CAST(rows AS BIGINT) AS rows, CAST(events AS BIGINT) AS events FROM bb JOIN mm USING (scorer) WHERE period = 'final_test'""",
    "final_report": f"""WITH {FLIGHTS}, fx AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', flight_date) AS BIGINT) AS day FROM flights WHERE year(flight_date) >= 2001),
{_claims('severe_delay', "SELECT flight_id, day, score, score_coarse, CAST(arr_delay >= 120 AS INT) AS label FROM fx WHERE cancelled = 0 AND diverted = 0 AND arr_delay IS NOT NULL")},
{_claims('cancellation', "SELECT flight_id, day, score, score_coarse, CAST(cancelled AS INT) AS label FROM fx")}
SELECT target, claim, round(lower_bound, 8) AS lower_bound, round(must_exceed, 8) AS must_exceed, lower_bound > must_exceed AS supported FROM (SELECT * FROM cl_sev UNION ALL SELECT * FROM cl_can)""",
}
