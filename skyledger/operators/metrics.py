"""Rare-event metrics from score-grouped counts.

Rows are first reduced to counts per distinct score inside the map tasks; every metric is then an aggregate over that
table and its distributed running sums, so ties are handled exactly and no row-level global sort is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.values import nearest_count, ratio
from skyledger.operators.attach import attach_row
from skyledger.operators.ordering import equal_count_bins, exact_quantiles, keyed_rank, quantile_bins, running_totals
from skyledger.session import stage

MIN_EVENTS = 30  # fixed value: a group needs this many events and non-events for a ranking metric


def melt_scores(df: DataFrame, scorers: dict[str, str], *keep: str) -> DataFrame:
    """Long form ``(keep, scorer, score)`` from one column per scorer, without a shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("scorer"), F.col(c).cast("double").alias("score")) for n, c in scorers.items()]))
    return df.select(*keep, pairs.alias("_s")).select(*keep, "_s.scorer", "_s.score")


def score_groups(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Rows and events per key and distinct score."""
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("e"))


def score_curve(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Score groups with running rows and events from the highest score down, and the key's totals."""
    return running_totals(score_groups(df, keys, score, label), keys, [("score", True)], {"cum_n": "n", "cum_e": "e"})


def average_precision_term() -> Column:
    """Per score group: recall gained times precision at that score. Its sum is the average precision."""
    return F.col("e") / F.col("cum_e_total") * (F.col("cum_e") / F.col("cum_n"))


def curve_metrics(curve: DataFrame, keys: list[str], probabilities: bool = True) -> DataFrame:
    """Rows, events, prevalence, average precision, lift, ROC-AUC (ties half), Brier and mean score per key."""
    negatives = F.col("n") - F.col("e")
    pairs = F.sum(negatives * (F.col("cum_e") - F.col("e") / 2.0))
    brier = F.sum(F.col("e") * F.pow(F.col("score") - 1, F.lit(2)) + negatives * F.pow("score", F.lit(2))) / F.sum("n")
    out = curve.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.sum("e").alias("events"), F.sum(average_precision_term()).alias("pr_auc"), pairs.alias("_pairs"),
        brier.alias("brier"), (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mean_score"))
    prevalence = F.col("events") / F.col("rows")
    nothing = F.lit(None).cast("double")
    return out.select(
        *keys, "rows", "events", prevalence.alias("prevalence"), "pr_auc", ratio(F.col("pr_auc"), prevalence).alias("lift"),
        ratio(F.col("_pairs"), F.col("events") * (F.col("rows") - F.col("events"))).alias("roc_auc"),
        (F.col("brier") if probabilities else nothing).alias("brier"), (F.col("mean_score") if probabilities else nothing).alias("mean_score"))


def binary_metrics(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", probabilities: bool = True) -> DataFrame:
    return curve_metrics(score_curve(df, keys, score, label), keys, probabilities)


def _stack(df: DataFrame, keys: list[str], rows: list[dict[str, Column]]) -> DataFrame:
    """Several rows per input row from a list of column dictionaries."""
    packed = F.explode(F.array(*[F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]))
    return df.select(*keys, packed.alias("_r")).select(*keys, *[f"_r.{n}" for n in rows[0]])


def ranking_table(df: DataFrame, keys: list[str], fractions: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """Results of reviewing the top fraction; a tie at the cut-off contributes in proportion to what fits."""
    curve = score_curve(df, keys, score, label)
    aggregates = [F.max("cum_n_total").alias("n"), F.max("cum_e_total").alias("events")]
    before = F.col("cum_n") - F.col("n")
    for i, f in enumerate(fractions):
        k = nearest_count(F.col("cum_n_total"), F.lit(f))
        inside = (before < k) & (k <= F.col("cum_n"))
        captured = F.col("cum_e") - F.col("e") + F.col("e") * (k - before) / F.col("n")
        aggregates += [F.max(F.when(inside, captured)).alias(f"_c{i}"), F.max(F.when(inside, k)).alias(f"_k{i}")]
    wide = curve.groupBy(*keys).agg(*aggregates)
    rows = []
    for i, f in enumerate(fractions):
        c, k = F.col(f"_c{i}"), F.col(f"_k{i}")
        precision, recall = c / k, ratio(c, F.col("events"))
        rows.append({
            "fraction": F.lit(f), "reviewed": k, "events_captured": c, "false_alerts": k - c, "precision": precision, "recall": recall,
            "f1": F.when(c > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0),
            "lift": ratio(precision, F.col("events") / F.col("n"))})
    return _stack(wide, keys, rows)


def fraction_cutoffs(df: DataFrame, fractions: dict[str, float], score: str = "score") -> DataFrame:
    """One row: the lowest score inside each top fraction (ties at the cut-off are all included)."""
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"))
    curve = running_totals(counts, [], [("score", True)], {"cum_n": "n"})
    return curve.agg(*[
        F.max(F.when((F.col("cum_n") - F.col("n") < nearest_count(F.col("cum_n_total"), F.lit(f)))
                     & (nearest_count(F.col("cum_n_total"), F.lit(f)) <= F.col("cum_n")), F.col("score"))).alias(name) for name, f in fractions.items()])


def precision_at(df: DataFrame, fractions: list[float], score: str = "score", label: str = "label", identity: str = "flight_id") -> DataFrame:
    """Precision and recall of exactly ceil(f * n) rows, ties by id."""
    ranked = keyed_rank(df.select(identity, score, label), [], [(score, True), identity], "_r")
    n = F.col("_r_size")
    aggregates = [F.max(n).alias("rows"), F.sum(F.col(label).cast("long")).alias("events")]
    aggregates += [F.sum(F.when(F.col("_r") <= F.ceil(n * F.lit(f)), F.col(label).cast("long")).otherwise(0)).alias(f"_c{i}") for i, f in enumerate(fractions)]
    wide = ranked.agg(*aggregates)
    return _stack(wide, [], [{
        "fraction": F.lit(f), "reviewed": F.ceil(F.col("rows") * F.lit(f)).cast("long"), "captured": F.col(f"_c{i}"),
        "precision": F.col(f"_c{i}") / F.ceil(F.col("rows") * F.lit(f)), "recall": ratio(F.col(f"_c{i}"), F.col("events"))} for i, f in enumerate(fractions)])


def precision_recall_points(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """One point per distinct score."""
    curve = score_curve(df, keys, score, label)
    return curve.select(*keys, "score", F.col("cum_n").alias("flagged"), F.col("cum_e").alias("captured"),
                        (F.col("cum_e") / F.col("cum_n")).alias("precision"), ratio(F.col("cum_e"), F.col("cum_e_total")).alias("recall"))


def f1_cutoff(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: the score with the highest F1 when flagging score >= cutoff; the lowest such score on ties."""
    f1 = 2.0 * F.col("cum_e") / (F.col("cum_n") + F.col("cum_e_total"))
    best = score_curve(df, [], score, label).agg(F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("minus"))).alias("b"))
    return best.select((-F.col("b.minus")).alias("f1_cutoff"), F.col("b.f1").alias("f1_at_cutoff"))


def learn_cutoffs(df: DataFrame, fractions: dict[str, float], score: str = "score", label: str = "label") -> DataFrame:
    """Operating points from one period, as rows (operating_point, cutoff_score)."""
    points = attach_row(fraction_cutoffs(df, fractions, score), f1_cutoff(df, score, label).select("f1_cutoff"))
    names = {**{n: F.col(n) for n in fractions}, "f1_optimal": F.col("f1_cutoff")}
    return _stack(points, [], [{"operating_point": F.lit(n), "cutoff_score": c} for n, c in names.items()])


def confusion(df: DataFrame, points: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Confusion counts of every operating point per key. The few points travel as one array on score groups."""
    groups = score_groups(df, keys, score, label)
    held = attach_row(groups, points.agg(F.collect_list(F.struct("operating_point", "cutoff_score")).alias("points")))
    long = held.select(*keys, "score", "n", "e", F.explode("points").alias("p"))
    hit = F.col("score") >= F.col("p.cutoff_score")
    out = long.groupBy(*keys, F.col("p.operating_point").alias("operating_point"), F.col("p.cutoff_score").alias("cutoff_score")).agg(
        F.sum("n").alias("flights"), F.sum("e").alias("events"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("flagged"),
        F.sum(F.when(hit, F.col("e")).otherwise(0)).alias("true_positives"))
    tp, flagged, events, flights = (F.col(c) for c in ("true_positives", "flagged", "events", "flights"))
    return out.select(
        "*", (flagged - tp).alias("false_positives"), (events - tp).alias("false_negatives"), (flights - flagged - events + tp).alias("true_negatives"),
        (flagged / flights).alias("alert_rate"), ratio(tp, flagged).alias("precision"), ratio(tp, events).alias("recall"),
        F.when(tp > 0, 2.0 * tp / (flagged + events)).otherwise(0.0).alias("f1"),
        ratio(flights - flagged - events + tp, flights - events).alias("specificity"))


def reliability(df: DataFrame, keys: list[str], bins: int = 10, probability: str = "probability", label: str = "label", identity: str = "flight_id") -> DataFrame:
    """Mean probability against observed rate in equal-count bins (lowest first, ties by id)."""
    binned = equal_count_bins(df.select(*keys, identity, probability, label), keys, [probability, identity], bins)
    return _bin_table(binned, keys, probability, label)


def calibration_table(df: DataFrame, keys: list[str], bins: int = 10, probability: str = "probability", label: str = "label", identity: str = "flight_id") -> DataFrame:
    """The same table with bins cut at rank quantiles."""
    binned = quantile_bins(df.select(*keys, identity, probability, label), keys, [probability, identity], bins)
    return _bin_table(binned, keys, probability, label)


def _bin_table(binned: DataFrame, keys: list[str], probability: str, label: str) -> DataFrame:
    return binned.groupBy(*keys, "bin").agg(F.count("*").alias("rows"), F.sum(F.col(label).cast("long")).alias("events"),
                                            F.avg(probability).alias("mean_predicted"), F.avg(label).alias("observed_rate"))


def calibration_error(table: DataFrame, keys: list[str]) -> DataFrame:
    """Expected calibration error: row-weighted gap of a reliability table."""
    gap = F.sum(F.col("rows") * F.abs(F.col("mean_predicted") - F.col("observed_rate")))
    return table.groupBy(*keys).agg((gap / F.sum("rows")).alias("ece"))


def probability_metrics(df: DataFrame, keys: list[str], reference_rate: Column, probability: str = "probability", label: str = "label") -> DataFrame:
    """Brier score, skill against a constant rate, and predicted over observed."""
    y = F.col(label)
    out = df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum(y.cast("long")).alias("events"), F.avg(F.pow(F.col(probability) - y, F.lit(2))).alias("brier"),
        F.avg(F.pow(reference_rate - y, F.lit(2))).alias("brier_constant"), F.avg(probability).alias("mean_predicted"))
    return out.select("*", (1 - ratio(F.col("brier"), F.col("brier_constant"))).alias("brier_skill"),
                      ratio(F.col("mean_predicted"), F.col("events") / F.col("rows")).alias("predicted_to_observed"))


def regression_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str, severe_from: float) -> DataFrame:
    """MAE, RMSE, exact median absolute error, bias, and MAE of the severe subset."""
    work = stage(df.select(*keys, actual, (F.col(predicted) - F.col(actual)).alias("_error")).withColumn("_abs", F.abs("_error")))
    plain = work.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.avg("_abs").alias("mae"), F.sqrt(F.avg(F.col("_error") * F.col("_error"))).alias("rmse"),
        F.avg("_error").alias("bias"), F.avg(F.when(F.col(actual) >= severe_from, F.col("_abs"))).alias("severe_mae"))
    middle = exact_quantiles(work, keys, "_abs", {"median_ae": 0.5})
    return plain.join(middle, keys) if keys else attach_row(plain, middle)


def group_metrics(df: DataFrame, dimensions: dict[str, str], cutoffs: DataFrame, alerts: list[str], minimum: int = MIN_EVENTS) -> DataFrame:
    """Metrics per value of every dimension, with alert rate, precision and recall at the given cut-offs.

    ``df`` needs label, score and probability; ``cutoffs`` is one row with a column per alert name. Rows are stacked by
    dimension and combined per (dimension, group, score) inside the map tasks before anything is shuffled.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("unseen")).alias("group")) for n, c in dimensions.items()]))
    keys = ["dimension", "group"]
    stacked = df.select(pairs.alias("d"), "label", F.col("score").cast("double").alias("score"), "probability").select("d.dimension", "d.group", "label", "score", "probability")
    y = F.col("label")
    groups = stacked.groupBy(*keys, "score").agg(
        F.count("*").alias("n"), F.sum(y.cast("long")).alias("e"), F.sum("probability").alias("sum_p"), F.sum(F.pow(F.col("probability") - y, F.lit(2))).alias("sum_sq"))
    curve = attach_row(running_totals(groups, keys, [("score", True)], {"cum_n": "n", "cum_e": "e"}), cutoffs)
    hits = [x for a in alerts for x in (
        F.sum(F.when(F.col("score") >= F.col(a), F.col("n")).otherwise(0)).alias(f"_f_{a}"), F.sum(F.when(F.col("score") >= F.col(a), F.col("e")).otherwise(0)).alias(f"_t_{a}"))]
    table = curve.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.sum("e").alias("events"), (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mean_score"),
        (F.sum("sum_p") / F.sum("n")).alias("mean_probability"), (F.sum("sum_sq") / F.sum("n")).alias("brier_probability"),
        F.sum(average_precision_term()).alias("_ap"), *hits)
    total = table.where(F.col("dimension") == next(iter(dimensions))).agg(F.sum("rows").alias("_all"))
    enough = (F.col("events") >= minimum) & (F.col("rows") - F.col("events") >= minimum)
    prevalence = F.col("events") / F.col("rows")
    return attach_row(table, total).select(
        *keys, "rows", (F.col("rows") / F.col("_all")).alias("share_of_rows"), "events", prevalence.alias("prevalence"), "mean_score", "mean_probability",
        ratio(F.col("mean_probability"), prevalence).alias("probability_to_observed"), "brier_probability",
        *[x for a in alerts for x in (
            (F.col(f"_f_{a}") / F.col("rows")).alias(f"alert_rate_{a}"), ratio(F.col(f"_t_{a}"), F.col(f"_f_{a}")).alias(f"precision_{a}"),
            ratio(F.col(f"_t_{a}"), F.col("events")).alias(f"recall_{a}"))],
        F.when(enough, F.col("_ap")).alias("pr_auc"), F.when(enough, ratio(F.col("_ap"), prevalence)).alias("lift"), (~enough).alias("small_sample"))


def severity_recall(df: DataFrame, cutoffs: DataFrame, alerts: list[str], edges: list[float], delay: str = "arr_delay", minimum: int = MIN_EVENTS) -> DataFrame:
    """Among events: share of each delay band a global top-fraction review would catch."""
    band = F.lit(None).cast("string")
    bounds = list(zip(edges, [*edges[1:], None]))
    for low, high in bounds:
        inside = F.col(delay) >= low if high is None else (F.col(delay) >= low) & (F.col(delay) < high)
        band = F.when(inside, f"[{low:g}, {'inf' if high is None else format(high, 'g')})").otherwise(band)
    events = attach_row(df.where(F.col("label") == 1).select("score", band.alias("band")), cutoffs)
    table = events.where(F.col("band").isNotNull()).groupBy("band").agg(
        F.count("*").alias("events"), *[F.avg((F.col("score") >= F.col(a)).cast("double")).alias(f"recall_{a}") for a in alerts])
    total = df.where(F.col("label") == 1).agg(F.count("*").alias("_all"))
    return attach_row(table, total).withColumns({"share_of_events": F.col("events") / F.col("_all"), "small_sample": F.col("events") < minimum}).drop("_all")


def alert_shares(groups: DataFrame, alert_rate: str, top: int, minimum_rows: int) -> DataFrame:
    """Per dimension, the groups with most alerts and their share of alerts, rows and events, with a running share.

    Input is a group-metric table: one row per group, so the per-dimension windows are small.
    """
    from pyspark.sql import Window

    part = Window.partitionBy("dimension")
    alerts = F.col("rows") * F.col(alert_rate)
    shaped = groups.where(F.col("rows") >= minimum_rows).withColumn("alerts", F.round(alerts, 6))
    shaped = shaped.withColumns({
        "share_of_alerts": ratio(F.col("alerts"), F.sum("alerts").over(part)), "share_of_events": ratio(F.col("events"), F.sum("events").over(part)),
        "share_of_rows": ratio(F.col("rows"), F.sum("rows").over(part))})
    order = part.orderBy(F.desc("alerts"), "group")
    ranked = shaped.withColumns({"rank": F.row_number().over(order), "running_share": F.sum("share_of_alerts").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.where(F.col("rank") <= top).select("dimension", "rank", "group", "rows", "alerts", "share_of_alerts", "share_of_rows", "share_of_events", "running_share")


def verdict(difference: Column, low: Column, high: Column, better: str = "better", worse: str = "worse") -> Column:
    """What an interval of a paired difference says."""
    return F.when(low > 0, better).when(high < 0, worse).when(difference.isNotNull(), "no_clear_difference")


def material_verdict(difference: Column, low: Column, high: Column, material: float = 0.0005) -> Column:
    """Verdict that also calls a clear but very small change tiny."""
    tiny = F.abs(difference) < material
    return (F.when(high < 0, F.when(tiny, "falls_but_tiny").otherwise("falls")).when(low > 0, F.when(tiny, "rises_but_tiny").otherwise("rises"))
            .otherwise("no_clear_change"))


def _weighted_correlation(first: Column, second: Column, weight: Column) -> Column:
    """Correlation of two columns that are centred well enough for sums of squares to be safe."""
    n, a, b = F.sum(weight), F.sum(weight * first), F.sum(weight * second)
    products = F.sum(weight * first * second) - a * b / n
    return products / F.sqrt((F.sum(weight * first * first) - a * a / n) * (F.sum(weight * second * second) - b * b / n))


def rank_correlation(df: DataFrame, first: str, second: str) -> DataFrame:
    """Spearman correlation with average ranks for ties, and Pearson's. Rows shrink to counts per pair of values before
    the ranks are joined, so a value that very many rows share is one row for each partner."""
    from skyledger.operators.ordering import average_rank

    pairs = stage(df.groupBy(F.col(first).alias("_a"), F.col(second).alias("_b")).agg(F.count("*").alias("_w")))
    middle = pairs.agg(F.sum("_w").alias("_rows"), (F.sum(F.col("_a") * F.col("_w")) / F.sum("_w")).alias("_ma"), (F.sum(F.col("_b") * F.col("_w")) / F.sum("_w")).alias("_mb"))
    ranks = [average_rank(pairs, [], n, f"_r{n}", "_w") for n in ("_a", "_b")]
    joined = attach_row(pairs.join(ranks[0], "_a").join(ranks[1], "_b"), middle)
    centre, weight = (F.col("_rows") + 1) / 2.0, F.col("_w")
    return joined.agg(F.max("_rows").alias("rows"), _weighted_correlation(F.col("_r_a") - centre, F.col("_r_b") - centre, weight).alias("spearman"),
                      _weighted_correlation(F.col("_a") - F.col("_ma"), F.col("_b") - F.col("_mb"), weight).alias("pearson"))
