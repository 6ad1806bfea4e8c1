"""Model queries: linear models, boosted trees, search, ladder, ablation, backtest, holdout and contributions.

Tree settings are small so that every query also finishes on one machine; the rows are always the whole tables.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from skyledger.operators import ablation as A
from skyledger.operators import baselines as BL
from skyledger.operators import calibration as K
from skyledger.operators import explain as E
from skyledger.operators import history as H
from skyledger.operators import labels as L
from skyledger.operators import learning as T
from skyledger.operators import metrics as M
from skyledger.operators import resampling as R
from skyledger.operators import schema as X
from skyledger.operators.attach import pair_rows
from skyledger.plans.cohorts import _COHORT, SHOCK_YEAR, cohort_frame
from skyledger.plans.evaluation import REPLICATES
from skyledger.session import cut_lineage, scratch_folder, stage
from skyledger.sources import files

NUMERIC = X.NUMERIC_BASE
LINEAR = T.Features(NUMERIC, ("origin", "destination", "carrier_id"))
TREES = T.Features(NUMERIC, LINEAR.categorical, ("route",))
SMALL = T.TreeSettings(iterations=5, depth=3, step=0.2, min_rows=50)
LABEL = "severe_120"


def model_frame(spark, folder, history=False):
    """Predictors paired with the cohort by id, with roles. Both come from one reading of the tables, written once."""
    predictors = [*NUMERIC, "departure_year", "carrier_id"]
    instant = F.col("prediction_utc")

    def derive(df):
        wide = L.roles(L.add_features(df, *predictors))
        return wide.withColumns({"departure_utc": instant + 7200, "route": F.concat_ws("-", "origin", "destination"), "day": F.floor(instant / 86400).cast("int")})

    whole = cohort_frame(spark, folder, "origin", "destination", "carrier", "dep_hhmm", "arr_hhmm", "sched_elapsed", "distance", derive=derive)
    cohort = whole.where(~F.col("embargoed"))
    if history:
        cohort = H.prior_month_counts(cohort, {"prior_carrier": "carrier", "prior_origin": "origin", "prior_route": "route"}).drop("history_month")
        cohort = H.mask_history(H.prior_month_degrees(cohort), [*X.HISTORY, *X.NETWORK], L.seconds_of(L.BOUNDARIES.history_start))
    keep = ["role", "split", "prediction_utc", "origin", "destination", "route", "completed", "cancelled_source", LABEL, "delay_minutes", "eligible_severe",
            *([*X.HISTORY, *X.NETWORK] if history else [])]
    joined = pair_rows(cohort, whole, [*keep, "day"], predictors)
    return stage(joined) if history else joined


def _parts(df):
    kept = df.where(F.col("eligible_severe"))
    return kept.where(F.col("role") == "fit"), kept.where(F.col("role") == "early_stop"), kept.where(F.col("role") == "validation")


def _metrics(df, label, name):
    return M.binary_metrics(df.select("score", F.col(label).alias("label")).withColumn("model", F.lit(name)), ["model"])


def _stack(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def logistic_scores(spark, folder):
    """Unweighted and balanced logistic models of both targets on validation rows."""
    df = model_frame(spark, folder)
    out = []
    for target, rows in ((LABEL, df.where(F.col("eligible_severe"))), ("cancelled_source", df)):
        fit, valid = rows.where(F.col("split") == L.DEVELOPMENT), rows.where(F.col("split") == L.VALIDATION)
        prepared = T.prepare_linear(fit, LINEAR, target)
        for balanced in (False, True):
            model = T.fit_logistic(prepared, LINEAR, target, balanced)
            out.append(_metrics(T.score_linear(model, valid, LINEAR), target, f"{target}_{'balanced' if balanced else 'unweighted'}"))
    return _stack(out)


def delay_regressions(spark, folder):
    """Mean, least squares, ridge and elastic net predictions of the delay on validation rows."""
    df = model_frame(spark, folder).where(F.col("delay_minutes").isNotNull())
    fit, valid = df.where(F.col("split") == L.DEVELOPMENT), df.where(F.col("split") == L.VALIDATION)
    mean = fit.agg(F.avg("delay_minutes")).first()[0]
    prepared = T.prepare_linear(fit, LINEAR, "delay_minutes")
    scored = {"mean": valid.withColumn("score", F.lit(mean))}
    for name, penalty, share, per_row in (("linear", 0.0, 0.0, False), ("ridge", 10.0, 0.0, False), ("elastic_net", 1.0, 0.5, True)):
        scored[name] = T.score_linear(T.fit_linear(prepared, LINEAR, "delay_minutes", penalty, share, per_row), valid, LINEAR)
    rows = _stack([d.select("delay_minutes", "score").withColumn("model", F.lit(n)) for n, d in scored.items()])
    return M.regression_metrics(rows, ["model"], "delay_minutes", "score", 120.0)


def _regression_scores(spark, folder, **penalty):
    df = model_frame(spark, folder).where(F.col("delay_minutes").isNotNull())
    model = T.fit_linear(df.where(F.col("split") == L.DEVELOPMENT), LINEAR, "delay_minutes", **penalty)
    return T.score_linear(model, df.where(F.col("split") == L.VALIDATION), LINEAR).select("flight_id", "delay_minutes", "score")


def ridge_scores(spark, folder):
    return _regression_scores(spark, folder, penalty=10.0)


def elastic_net_scores(spark, folder):
    return _regression_scores(spark, folder, penalty=1.0, l1_share=0.5, per_row_loss=True)


def gbt_scores(spark, folder):
    fit, stop, valid = _parts(model_frame(spark, folder))
    return T.score_trees(T.fit_trees(fit, stop, TREES, LABEL, SMALL), valid).select("flight_id", F.col(LABEL).alias("label"), "score")


def refit_check(spark, folder):
    """A refit against the stored scores of an earlier fit with the same rows, settings and seed."""
    fit, stop, valid = _parts(model_frame(spark, folder))
    scored = (T.score_trees(T.fit_trees(fit, stop, TREES, LABEL, SMALL), valid).select("flight_id", F.col(LABEL).alias("label"), "score") for _ in range(2))
    path = scratch_folder(spark)
    files.publish(next(scored), path)
    return T.require_reproduction(T.reproduction(files.read_parquet(spark, path, ["flight_id", "label", "score"]), stage(next(scored))), 1e-9)


LADDER = {name: T.Features(tuple(c for c in X.feature_columns(name) if c not in X.CATEGORICAL_BASE), TREES.categorical, TREES.encoded)
          for name in ("base", "base_no_year", "base_history_no_year", "full_no_year")}


def feature_ladder(spark, folder):
    """Feature sets against historical-rate baselines on the same validation rows."""
    fit, stop, valid = _parts(model_frame(spark, folder, history=True))
    rates = BL.rate_baselines(fit.withColumns({"label": F.col(LABEL), "carrier": F.col("carrier_id")}), valid.withColumn("carrier", F.col("carrier_id")))
    long = M.melt_scores(rates, {n: n for n in ("prevalence", *BL.KEYS)}, LABEL)
    parts = [M.binary_metrics(long, ["scorer"], label=LABEL).withColumnRenamed("scorer", "model")]
    fitted = T.fit_sets([(T.prepare_trees(fit, stop, f, LABEL), [SMALL]) for f in LADDER.values()])
    parts += [_metrics(T.score_trees(trees, valid), LABEL, f"trees_{n}") for n, (trees,) in zip(LADDER, fitted)]
    return _stack(parts)


#: Full settings: trees until the stop rows gain no more, 100 at most.
FULL = T.TreeSettings()
#: Settings drawn from the 96 of the space, besides the default, which is one of them.
DRAWS = 30
SPACE = {"depth": [2, 3, 4, 5], "step": [0.1, 0.2, 0.4], "min_rows": [20, 50, 100, 200], "subsample": [0.7, 1.0]}


def settings_search(spark, folder):
    """Settings chosen on the selection half, adopted only if the paired interval on the confirmation half is above zero."""
    fit, stop, valid = _parts(model_frame(spark, folder))
    settings = T.sample_settings(FULL, SPACE, DRAWS, 42)
    prepared = T.prepare_trees(fit, stop, TREES, LABEL)
    vectors = stage(T.tree_vectors(prepared, valid, "day", L.half(F.col("prediction_utc")).alias("half"), F.col(LABEL).alias("label")))
    names = [f"draw_{i}" if i else "default" for i in range(len(settings))]
    long = stage(T.melt_vectors(dict(zip(names, T.fit_settings(prepared, settings))), vectors, "scorer"))
    table = M.binary_metrics(long, ["half", "scorer"]).select("half", "scorer", "pr_auc")
    drawn = table.where((F.col("half") == "selection") & (F.col("scorer") != "default") & F.col("pr_auc").isNotNull() & ~F.isnan("pr_auc"))
    best = drawn.orderBy(F.desc("pr_auc"), F.substring_index("scorer", "_", -1).cast("int")).first()["scorer"]  # ties go to the earlier draw
    pair = long.where((F.col("half") == "confirmation") & F.col("scorer").isin("default", best))
    draws = R.resampled_average_precision(pair, "scorer", "day", REPLICATES)
    low = R.bootstrap_summary(cut_lineage(draws), M.binary_metrics(pair, ["scorer"]), "scorer", "default").where(F.col("scorer") == best).first()["difference_low"]
    chosen = spark.createDataFrame([(n, str(s)) for n, s in zip(names, settings)], "scorer string, settings string")
    return table.join(F.broadcast(chosen), "scorer").withColumns({"challenger": F.col("scorer") == best, "adopted": F.lit(bool(low > 0)) & (F.col("scorer") == best)})


#: Seeds of the ablation; the paired intervals are those of the first.
SEEDS = (42, 43, 44)


def _ablation_scores(spark, folder, seeds):
    """Validation scores of the fit rows with the shock year, without it, and of a sample as large, for each seed."""
    fit, stop, valid = _parts(model_frame(spark, folder))
    fit = fit.select("flight_id", "prediction_utc", LABEL, *TREES.numeric, *TREES.categorical, *TREES.encoded)
    variants = {seed: L.fit_variants(fit, SHOCK_YEAR, seed) for seed in seeds}
    sets = [("full", seeds), ("without_shock", seeds), *[("matched", (s,)) for s in seeds]]  # only the sample depends on the seed
    prepared = [T.prepare_trees(stage(variants[alike[0]].where(F.col("variant") == v).drop("variant")), stop, TREES, LABEL) for v, alike in sets]
    fitted = T.fit_sets([(p, [replace(FULL, seed=s) for s in alike]) for p, (_, alike) in zip(prepared, sets)])
    out = []
    for p, trees, (v, alike) in zip(prepared, fitted, sets):
        vectors = T.tree_vectors(p, valid, "day", "prediction_utc", F.col(LABEL).alias("label"))
        out.append(T.melt_vectors(dict(zip(alike, trees)), vectors, "seed").withColumn("variant", F.lit(v)))
    return stage(_stack(out))


def training_ablation(spark, folder):
    """Average precision of each training period over three seeds, by half of the validation year, and its spread."""
    return A.seed_spread(_ablation_scores(spark, folder, SEEDS))


def ablation_decision(spark, folder):
    """Paired day intervals between the training periods, and whether the shock year is dropped."""
    return A.with_drop_rule(cut_lineage(A.paired_differences(_ablation_scores(spark, folder, SEEDS[:1]), REPLICATES)))


def yearly_backtest(spark, folder):
    """Expanding windows: fit on the past, stop on six months, score the next year."""
    df = model_frame(spark, folder).where(F.col("eligible_severe") & (F.col("split") != L.FINAL_TEST))
    windows = {str(year): df.withColumn("role", L.expanding_roles(F.col("prediction_utc"), year)) for year in (1998, 1999, 2000)}
    prepared = [T.prepare_trees(rows.where(F.col("role") == L.FIT), rows.where(F.col("role") == L.EARLY_STOP), TREES, LABEL) for rows in windows.values()]
    fitted = T.fit_sets([(p, [SMALL]) for p in prepared])
    return _stack([_metrics(T.score_trees(trees, rows.where(F.col("role") == L.EVAL)), LABEL, year) for (year, rows), (trees,) in zip(windows.items(), fitted)])


def disjoint_holdout(spark, folder):
    """Fit on development, calibrate on the first half of validation, test on the final period: three disjoint spans."""
    df = model_frame(spark, folder).where(F.col("eligible_severe"))
    fit, stop = df.where(F.col("role") == "fit"), df.where(F.col("role") == "early_stop")
    fitted = T.fit_trees(fit, stop, TREES, LABEL, replace(SMALL, iterations=8))
    later = stage(T.score_trees(fitted, df.where(F.col("split") != L.DEVELOPMENT)).select("flight_id", "prediction_utc", "split", F.col(LABEL).alias("label"), "score"))
    calibrated = K.calibrate(later.where(L.half(F.col("prediction_utc")) == "selection"), later.where(F.col("split") == L.FINAL_TEST), "prediction_utc", F.lit(2**62))
    return M.binary_metrics(M.melt_scores(calibrated, {m: m for m in K.METHODS}, "label"), ["scorer"])


def feature_variants(spark, folder):
    """Base features against base with schedule counts and network degrees."""
    fit, stop, valid = _parts(model_frame(spark, folder, history=True))
    names = ("base", "full_no_year")
    fitted = T.fit_sets([(T.prepare_trees(fit, stop, LADDER[n], LABEL), [SMALL]) for n in names])
    return _stack([_metrics(T.score_trees(trees, valid), LABEL, n) for n, (trees,) in zip(names, fitted)])


def group_ablation(spark, folder):
    """Average precision of the tree model without each group of features."""
    fit, stop, valid = _parts(model_frame(spark, folder))
    return T.group_ablation(fit, stop, valid, TREES, {"route": ("route",), "carrier": ("carrier_id",), "clock": ("dep_hour", "dep_minute", "arr_hour", "arr_minute")}, LABEL, SMALL)


def _contributions(spark, folder):
    df = model_frame(spark, folder).where(F.col("eligible_severe"))
    fit, valid = df.where(F.col("split") == L.DEVELOPMENT), df.where(F.col("split") == L.VALIDATION)
    model = T.fit_logistic(fit, LINEAR, LABEL, iterations=30)
    return stage(T.linear_contributions(model, valid, fit, LINEAR))


def linear_contributions(spark, folder):
    held = _contributions(spark, folder)
    return held.select("flight_id", *[f"c_{c}" for c in (*LINEAR.numeric, *LINEAR.categorical)], "expected", "raw")


def contribution_check(spark, folder):
    """Contributions and expected value add up to the model's log-odds: rounded to 6 digits the gap is zero."""
    return T.additivity_gap(_contributions(spark, folder), LINEAR).withColumn("largest_gap", F.round("largest_gap", 6))


def contribution_summary(spark, folder):
    long = T.long_contributions(_contributions(spark, folder), LINEAR)
    importance = E.contribution_importance(long)
    families = E.family_importance(importance).withColumn("feature", F.lit("(family total)"))
    return importance.unionByName(families)


def contribution_effects(spark, folder):
    """Numeric effects by quintile, and the highest and lowest levels of the categories."""
    long = T.long_contributions(_contributions(spark, folder), LINEAR)
    return E.numeric_effect(long).unionByName(E.categorical_effect(long.where(F.col("level").isNotNull()), 50, 5), allowMissingColumns=True)


def contribution_top(spark, folder):
    names = (*LINEAR.numeric, *LINEAR.categorical)
    return E.top_contributions(_contributions(spark, folder), {c: f"c_{c}" for c in names}, 3)


QUERIES = {f.__name__: f for f in (
    logistic_scores, delay_regressions, ridge_scores, elastic_net_scores, gbt_scores, refit_check, feature_ladder, settings_search, training_ablation, ablation_decision, yearly_backtest, disjoint_holdout,
    feature_variants, group_ablation, linear_contributions, contribution_check, contribution_summary, contribution_effects, contribution_top)}

_VALID = f"{_COHORT}, k AS (SELECT count(*) AS rows FROM cohort WHERE split = 'validation' AND completed)"

SQL = {
    "contribution_check": f"WITH {_VALID} SELECT rows, 0.0::DOUBLE AS largest_gap FROM k",
    "refit_check": f"WITH {_VALID} SELECT rows, CAST(0 AS BIGINT) AS unmatched, 0.0::DOUBLE AS largest_difference, 0.0::DOUBLE AS mean_difference, 0.0::DOUBLE AS pr_auc_difference FROM k",
}
