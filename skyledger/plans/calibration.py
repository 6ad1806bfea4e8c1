"""Calibration queries over the scored view."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions.values import clip_probability, from_logit, to_logit
from skyledger.operators import calibration as K
from skyledger.operators import metrics as M
from skyledger.operators import resampling as R
from skyledger.operators.attach import attach_row
from skyledger.operators.labels import seconds_of
from skyledger.plans.evaluation import REPLICATES
from skyledger.plans.oracle_views import SCORED
from skyledger.session import cut_lineage, stage
from skyledger.sources.adapters import scored

FLOOR = 1e-6


def _frame(spark, folder):
    df = scored(spark, folder)
    return df.withColumns({"second": F.col("day").cast("long") * 86400, "half": F.when(F.month("flight_date") <= 6, "selection").otherwise("confirmation"),
                           "quarter": F.concat(F.lit("Q"), F.quarter("flight_date").cast("string"))})


def logit_transform(spark, folder):
    df = scored(spark, folder)
    z = to_logit(F.col("score_alt"))
    return df.select("flight_id", F.round(clip_probability(F.col("score_alt"), 0.05), 9).alias("clipped"), F.round(z, 9).alias("logit"), F.round(from_logit(z * 0.5), 9).alias("halved"))


def platt_fit(spark, folder):
    fit = K.fit_platt(_frame(spark, folder).where(F.col("period") == "development"))
    return spark.createDataFrame([(round(fit.intercept, 6), round(fit.slope, 6))], "intercept double, slope double")


def calibration_slope(spark, folder):
    df = cut_lineage(_frame(spark, folder).where(F.col("period") != "development").select("period", "score", "label"))
    rows = [(p, *(round(v, 6) for v in K.calibration_slope(df.where(F.col("period") == p), "score"))) for p in ("validation", "final_test")]
    return spark.createDataFrame(rows, "period string, slope double, in_the_large double")


def platt_scores(spark, folder):
    df = _frame(spark, folder)
    fit = K.fit_platt(df.where(F.col("period") == "development"))
    return df.where(F.col("period") == "validation").select("flight_id", F.round(K.apply_platt(fit, F.col("score")), 6).alias("probability"))


def isotonic_scores(spark, folder):
    """Monotone fit on the coarse score; the expected value is the max-min formula of the pooled means."""
    df = stage(_frame(spark, folder).where(F.col("period") != "final_test").select("flight_id", "period", "score_coarse", "label"))
    model = K.fit_isotonic(df.where(F.col("period") == "development"), "score_coarse")
    out = K.apply_isotonic(model, df.where(F.col("period") == "validation"), "score_coarse", "probability")
    return out.select("flight_id", F.round("probability", 8).alias("probability"))


def _calibrated(spark, folder):
    df = cut_lineage(_frame(spark, folder).select("flight_id", "second", "day", "score", "label", "half", "quarter", "period"))
    fit, later = df.where(F.col("period") == "development"), df.where(F.col("period") == "validation")
    return df, cut_lineage(K.calibrate(fit, later, "second", seconds_of("2001-01-01"))), fit.agg(F.avg("label")).first()[0]


def calibration_experiments(spark, folder):
    """Every method on halves, quarters and the whole validation year; and methods fitted on the first half, applied to the second."""
    df, held, rate = _calibrated(spark, folder)
    valid = df.where(F.col("period") == "validation")
    recent = K.calibrate(valid.where(F.col("half") == "selection"), valid.where(F.col("half") == "confirmation"), "second", seconds_of("2001-01-01"))

    def long(source, name, span):
        methods = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("probability")) for m in K.METHODS]))
        return source.select("flight_id", "label", F.lit(name).alias("experiment"), span.alias("span"), methods.alias("m")).select("flight_id", "label", "experiment", "span", "m.*")

    parts = [long(held, "older_rows", F.col("half")), long(held, "older_rows", F.col("quarter")), long(held, "older_rows", F.lit("full_year")), long(recent, "recent_rows", F.col("half"))]
    rows = stage(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    keys = ["experiment", "method", "span"]
    out = M.probability_metrics(rows, keys, F.lit(rate))
    for more in (M.binary_metrics(rows, keys, "probability").select(*keys, "prevalence", "pr_auc", "roc_auc"), M.calibration_error(M.reliability(rows, keys), keys),
                 rows.groupBy(*keys).agg(F.countDistinct("probability").alias("distinct_scores"))):
        out = out.join(more, keys)
    out = out.join(K.grouped_slopes(rows, keys, "probability"), keys, "left")
    return out.withColumns({c: F.round(c, 8) for c in ("brier", "brier_constant", "mean_predicted", "brier_skill", "predicted_to_observed", "prevalence", "pr_auc", "roc_auc", "ece")}).withColumns(
        {c: F.round(c, 6) for c in ("calibration_slope", "calibration_in_the_large")})


def calibration_choice(spark, folder):
    """The chosen method and fit source by the confirmation rules, from paired day intervals."""
    df, held, _ = _calibrated(spark, folder)
    selection, confirmation = held.where(F.col("half") == "selection"), held.where(F.col("half") == "confirmation")
    brier = selection.agg(*[F.avg(F.pow(F.col(m) - F.col("label"), F.lit(2))).alias(f"brier_{m}") for m in K.METHODS])

    def high(source, reference, challenger, name):
        return R.brier_bootstrap(source, reference, challenger, "day", REPLICATES).select(F.col("difference_high").alias(name))

    table = brier
    for row in (high(confirmation, "uncalibrated", "platt", "platt_high"), high(confirmation, "uncalibrated", "isotonic", "isotonic_high"),
                high(confirmation, "platt", "isotonic", "isotonic_over_platt_high")):
        table = attach_row(table, row)
    table = cut_lineage(table.withColumn("method", K.method_column()))
    chosen = table.first()["method"]
    recent = None
    if chosen != "uncalibrated":
        valid = df.where(F.col("period") == "validation")
        newer = K.calibrate(valid.where(F.col("half") == "selection"), valid.where(F.col("half") == "confirmation"), "second", seconds_of("2001-01-01"))
        both = confirmation.select("flight_id", "label", "day", F.col(chosen).alias("old")).join(newer.select("flight_id", F.col(chosen).alias("new")), "flight_id")
        recent = high(both, "old", "new", "recent_high")
    table = attach_row(table, recent) if recent is not None else table.withColumn("recent_high", F.lit(None).cast("double"))
    return table.select("method", K.fit_source_column("method").alias("fit_source"), *[f"brier_{m}" for m in K.METHODS])


QUERIES = {f.__name__: f for f in (
    logit_transform, platt_fit, calibration_slope, platt_scores, isotonic_scores, calibration_experiments, calibration_choice)}

_LOGIT = "ln(greatest(least({0}, 1 - 1e-6), 1e-6) / (1 - greatest(least({0}, 1 - 1e-6), 1e-6)))"


def _newton(name: str, period: str, slope: bool) -> str:
    """Newton steps of the logistic fit on score counts, as a recursion over (step, a, b)."""
    eta = "(a + b * z)"
    mu = f"(1 / (1 + exp(-{eta})))"
    start = "0.0::DOUBLE, 0.0::DOUBLE" if slope else f"(SELECT ln(sum(e) / (sum(n) - sum(e))) - sum(n * z) / sum(n) FROM g_{name}), 1.0::DOUBLE"
    move = ("a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)" if slope else "a + g0 / h00, b")
    return f"""g_{name} AS (SELECT {_LOGIT.format('score')} AS z, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS e FROM scored WHERE period = '{period}' GROUP BY score),
it_{name}(k, a, b) AS (SELECT 0, {start} UNION ALL SELECT k + 1, {move} FROM (
  SELECT k, a, b, sum(e - n * {mu}) AS g0, sum((e - n * {mu}) * z) AS g1, sum(n * {mu} * (1 - {mu})) AS h00, sum(n * {mu} * (1 - {mu}) * z) AS h01, sum(n * {mu} * (1 - {mu}) * z * z) AS h11
  FROM it_{name}, g_{name} WHERE k < 15 GROUP BY k, a, b)),
f_{name} AS (SELECT a, b FROM it_{name} ORDER BY k DESC LIMIT 1)"""


_ISO = f"""{SCORED}, g AS (SELECT score_coarse AS x, count(*)::DOUBLE AS w, sum(label)::DOUBLE AS s FROM scored WHERE period = 'development' GROUP BY 1),
c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs, w, s FROM g),
m AS (SELECT j.i AS lo, k.i AS hi, (k.cs - j.cs + j.s) / (k.cw - j.cw + j.w) AS v FROM c j JOIN c k ON k.i >= j.i),
f AS (SELECT x, max(inner_min) AS p FROM (SELECT c.x, m.lo, min(m.v) AS inner_min FROM c JOIN m ON m.lo <= c.i AND m.hi >= c.i GROUP BY 1, 2) GROUP BY 1)"""

SQL = {
    "logit_transform": f"""WITH {SCORED} SELECT flight_id, round(greatest(least(score_alt, 0.95), 0.05), 9) AS clipped, round({_LOGIT.format('score_alt')}, 9) AS logit, round(1 / (1 + exp(-0.5 * {_LOGIT.format('score_alt')})), 9) AS halved FROM scored""",
    "platt_fit": f"WITH RECURSIVE {SCORED}, {_newton('p', 'development', True)} SELECT round(a, 6) AS intercept, round(b, 6) AS slope FROM f_p",
    "calibration_slope": "WITH RECURSIVE " + ", ".join((SCORED, _newton("v1", "validation", True), _newton("v0", "validation", False), _newton("t1", "final_test", True), _newton("t0", "final_test", False)))
        + " SELECT 'validation' AS period, round(f_v1.b, 6) AS slope, round(f_v0.a, 6) AS in_the_large FROM f_v1, f_v0 UNION ALL SELECT 'final_test', round(f_t1.b, 6), round(f_t0.a, 6) FROM f_t1, f_t0",
    "platt_scores": f"WITH RECURSIVE {SCORED}, {_newton('p', 'development', True)} SELECT flight_id, round(1 / (1 + exp(-(a + b * {_LOGIT.format('score')}))), 6) AS probability FROM scored, f_p WHERE period = 'validation'",
    "isotonic_scores": f"WITH {_ISO} SELECT flight_id, round(greatest(least(p, 1 - 1e-6), 1e-6), 8) AS probability FROM scored JOIN f ON f.x = score_coarse WHERE period = 'validation'",
}
