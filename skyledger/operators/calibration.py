"""Probability calibration: logistic (Platt), isotonic, identity; slopes, guarded experiments and choice rules.

Fits run on counts per distinct score, so an iteration reads a reduced table once and only five sums reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.values import clip_probability, from_logit, to_logit
from skyledger.operators.isotonic import apply_steps, fit_steps
from skyledger.operators.schema import enforce, period_guard
from skyledger.session import cut_lineage, stage

METHODS = ("uncalibrated", "platt", "isotonic")


@dataclass(frozen=True)
class LogisticFit:
    intercept: float
    slope: float
    iterations: int
    gradient: float


def logit_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """Distinct score counts with their logit, materialised once for all iterations."""
    grouped = df.groupBy(F.col(score).cast("double").alias("_s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("e"))
    return cut_lineage(grouped.select(to_logit(F.col("_s")).alias("z"), "n", "e"))


def _weighted_line(counts: DataFrame, a: float, b: float) -> tuple[float, float, float, float, float, float]:
    """Means and spreads of the working response on the logit under the current fit, and the largest score equation."""
    eta = F.lit(a) + F.lit(b) * F.col("z")
    mu = from_logit(eta)
    weight, residual = F.col("n") * mu * (1 - mu), F.col("e") - F.col("n") * mu
    response = weight * eta + residual  # weight times the working response, also where the weight vanishes
    row = counts.agg(F.sum(weight), F.sum(weight * F.col("z")), F.sum(weight * F.col("z") * F.col("z")), F.sum(response), F.sum(response * F.col("z")),
                     F.greatest(F.abs(F.sum(residual)), F.abs(F.sum(residual * F.col("z"))))).first()
    return tuple(math.nan if v is None else float(v) for v in row)


def fit_logistic(counts: DataFrame, slope: bool = True, max_iter: int = 60, tol: float = 1e-10) -> LogisticFit:
    """Unpenalised logistic fit of events on the logit by iteratively reweighted least squares: each round is the
    weighted line through the working response. ``slope=False`` keeps the slope at 1 and fits the level alone."""
    present = counts.agg(F.sum("e"), F.sum(F.col("n") - F.col("e"))).first()
    if not all(present):
        raise ValueError("both classes are needed to fit a calibrator")
    share = present[0] / (present[0] + present[1])
    a, b = (math.log(share / (1 - share)), 0.0) if slope else (0.0, 1.0)
    for iteration in range(1, max_iter + 1):
        w, wz, wzz, r, rz, equation = _weighted_line(counts, a, b)
        spread = w * wzz - wz * wz
        new_b = (w * rz - wz * r) / spread if slope and spread > 0 else b
        new_a = (r - new_b * wz) / w if w > 0 else math.nan
        if not (math.isfinite(new_a) and math.isfinite(new_b)):
            raise ValueError("the classes are separated by the score, so the logistic fit has no finite solution")
        moved, (a, b) = max(abs(new_a - a), abs(new_b - b)), (new_a, new_b)
        if moved < tol:
            return LogisticFit(a, b, iteration, equation)
    raise ValueError("the logistic fit did not converge")


def fit_platt(df: DataFrame, score: str = "score", label: str = "label") -> LogisticFit:
    """Platt scaling on the logit; a slope that is not positive would reverse the ranking and is refused."""
    fit = fit_logistic(logit_counts(df, score, label))
    if not fit.slope > 0:
        raise ValueError(f"the slope {fit.slope:.4g} is not positive")
    return fit


def apply_platt(fit: LogisticFit, score: Column) -> Column:
    return clip_probability(from_logit(F.lit(fit.intercept) + F.lit(fit.slope) * to_logit(score)))


def calibration_slope(df: DataFrame, probability: str, label: str = "label") -> tuple[float, float]:
    """Slope of a logistic recalibration, and the level shift at slope 1."""
    counts = logit_counts(df, probability, label)
    return fit_logistic(counts).slope, fit_logistic(counts, slope=False).intercept


def grouped_slopes(df: DataFrame, keys: list[str], probability: str, label: str = "label", max_iter: int = 60, tol: float = 1e-9) -> DataFrame:
    """``calibration_slope`` and ``calibration_in_the_large`` of every key at once; null where a class is missing.

    All keys take a reweighted least-squares step together on counts per distinct probability; the state is one row for
    each key. A key stops moving when it is fitted, and the last one to move ends the loop.
    """
    score = F.col(probability).cast("double")
    counts = stage(df.groupBy(*keys, to_logit(score).alias("z")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("e")))
    both = counts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum("e").alias("_e")).where((F.col("_e") > 0) & (F.col("_e") < F.col("_n")))
    state = stage(both.select(*keys, F.log(F.col("_e") / (F.col("_n") - F.col("_e"))).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("level")))
    for _ in range(max_iter):
        work = counts.join(state, keys)
        eta, shifted = F.col("a") + F.col("b") * F.col("z"), F.col("level") + F.col("z")
        weight, flat = (F.col("n") * from_logit(x) * (1 - from_logit(x)) for x in (eta, shifted))
        response = weight * eta + F.col("e") - F.col("n") * from_logit(eta)
        sums = work.groupBy(*keys, "a", "b", "level").agg(
            F.sum(weight).alias("w"), F.sum(weight * F.col("z")).alias("wz"), F.sum(weight * F.col("z") * F.col("z")).alias("wzz"), F.sum(response).alias("r"), F.sum(response * F.col("z")).alias("rz"),
            (F.sum(F.col("e") - F.col("n") * from_logit(shifted)) / F.sum(flat)).alias("shift"))
        new_b = (F.col("w") * F.col("rz") - F.col("wz") * F.col("r")) / (F.col("w") * F.col("wzz") - F.col("wz") * F.col("wz"))
        moved = sums.withColumn("nb", new_b).withColumn("na", (F.col("r") - F.col("nb") * F.col("wz")) / F.col("w"))
        step = F.greatest(F.abs(F.col("na") - F.col("a")), F.abs(F.col("nb") - F.col("b")), F.abs(F.col("shift")))
        state = stage(moved.select(*keys, F.col("na").alias("a"), F.col("nb").alias("b"), (F.col("level") + F.col("shift")).alias("level"), step.alias("step")))
        if (state.agg(F.max("step")).first()[0] or 0.0) < tol:
            break
        state = state.drop("step")
    return state.select(*keys, F.col("b").alias("calibration_slope"), F.col("level").alias("calibration_in_the_large"))


def fit_isotonic(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Steps of the monotone fit on distinct scores, weighted by their rows."""
    return fit_steps(df, score, label)


def apply_isotonic(steps: DataFrame, df: DataFrame, score: str, out: str) -> DataFrame:
    """Fitted values, linear between steps; scores outside the fitted range take the nearest value."""
    return apply_steps(steps, df, score, out).withColumn(out, clip_probability(F.col(out)))


def calibrate(fit: DataFrame, apply: DataFrame, second: str, locked_from: Column, identity: str = "flight_id", score: str = "score") -> DataFrame:
    """Fit every method on the earlier rows and add its probability to the later ones, after the guards pass."""
    report = period_guard(fit, apply, identity, second, locked_from)
    enforce(report, {"no locked rows": F.col("locked_rows") == 0, "calibration before evaluation": F.col("in_order"), "disjoint ids": F.col("shared_ids") == 0})
    platt = fit_platt(fit, score)
    out = apply.withColumns({"uncalibrated": F.col(score).cast("double"), "platt": apply_platt(platt, F.col(score))})
    return apply_isotonic(fit_isotonic(fit, score), out, score, "isotonic")


def method_column(difference_high: str = "{}_high", brier: str = "brier_{}", pair: str = "isotonic_over_platt_high") -> Column:
    """The chosen method of a one-row table of metrics.

    A method qualifies if its selection-half Brier score is below the raw score's and the upper end of the interval of
    its difference on the other half is below zero; between two that do, isotonic needs the same against Platt.
    """
    def confirmed(name: str) -> Column:
        high = F.nanvl(F.col(difference_high.format(name)), F.lit(0.0))
        return F.coalesce((F.col(brier.format(name)) < F.col(brier.format("uncalibrated"))) & (high < 0), F.lit(False))

    platt, isotonic, ahead = confirmed("platt"), confirmed("isotonic"), F.coalesce(F.nanvl(F.col(pair), F.lit(0.0)) < 0, F.lit(False))
    return F.when(isotonic & (~platt | ahead), "isotonic").when(platt, "platt").otherwise("uncalibrated")


def fit_source_column(method: str, recent_high: str = "recent_high") -> Column:
    """Which rows the final calibrator is fitted on: the recent ones only if they are confirmed to be better."""
    better = F.coalesce(F.nanvl(F.col(recent_high), F.lit(0.0)) < 0, F.lit(False))
    return F.when(F.col(method) == "uncalibrated", "none").when(better, "recent_year").otherwise("same_as_here")
