"""Error-analysis dimensions, rule-based case selection and summaries of additive contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import clocks as C
from skyledger.functions.values import nearest_count, ratio
from skyledger.operators.attach import attach_row
from skyledger.operators.ordering import keyed_rank, quantile_bins, running_totals
from skyledger.session import stage

OTHER_AIRPORTS = "all other airports"


def volume_band(count: Column) -> Column:
    return F.when(count.isNull() | (count == 0), "unseen route").when(count < 100, "1-99").when(count < 1000, "100-999").otherwise("1000 or more")


def dimensions(df: DataFrame, fit: DataFrame, top: int = 25) -> DataFrame:
    """One label per row for every dimension: quarter, carrier, busiest origins, route volume in the fit rows, hour band,
    weekday, completeness (unseen levels, and any missing number among both clocks, duration and distance), and score decile.
    Needs id, score, carrier, origin, destination, dep_hhmm, arr_hhmm, sched_elapsed, distance and flight_date."""
    route = F.concat_ws("-", "origin", "destination")
    busiest = df.groupBy("origin").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "origin").limit(top).select("origin", F.lit(1).alias("_top"))
    volume = fit.groupBy(route.alias("route")).agg(F.count("*").alias("_volume"))
    carriers = fit.select(F.col("carrier")).distinct().withColumn("_seen", F.lit(1))
    work = df.withColumn("route", route).join(F.broadcast(busiest), "origin", "left").join(volume, "route", "left").join(carriers, "carrier", "left")
    work = work.withColumn("_minutes", C.clock_minutes(F.col("dep_hhmm"), accept_2400=False))
    unseen = F.col("_seen").isNull() | F.col("_volume").isNull()
    absent = F.col("_minutes").isNull() | C.clock_minutes(F.col("arr_hhmm"), accept_2400=False).isNull() | F.col("sched_elapsed").isNull() | F.col("distance").isNull()
    hour = C.clock_parts(F.col("_minutes"))["hour"]
    labelled = work.select(
        *df.columns,
        F.concat(F.year("flight_date").cast("string"), F.lit("Q"), F.quarter("flight_date").cast("string")).alias("quarter"),
        F.when(F.col("_top") == 1, F.col("origin")).otherwise(OTHER_AIRPORTS).alias("origin_group"),
        volume_band(F.col("_volume")).alias("route_volume"), F.coalesce(C.hour_band(hour), F.lit("unknown")).alias("departure_hours"),
        F.weekday("flight_date").cast("string").alias("weekday"),
        F.when(unseen & absent, "unseen category and missing number").when(unseen, "unseen category").when(absent, "missing number").otherwise("complete").alias("completeness"))
    binned = quantile_bins(labelled, [], ["score", "flight_id"], 10, "_decile")
    text = F.concat(F.lit("decile "), F.lpad(F.col("_decile").cast("string"), 2, "0"))
    return binned.withColumn("score_decile", F.when(F.col("_decile") == 1, F.concat(text, F.lit(" (lowest)"))).when(
        F.col("_decile") == 10, F.concat(text, F.lit(" (highest)"))).otherwise(text)).drop("_decile")


def _extremes(pooled: DataFrame, event: int, direction: str, extremes: int) -> DataFrame:
    category, pick, order = (("high_confidence_false_positive", "highest_scoring_non_event", F.asc("rank")) if direction == "high"
                             else ("high_confidence_false_negative", "lowest_scoring_event", F.desc("rank")))
    best = pooled.where(F.col("label") == event).orderBy(order).limit(extremes)
    return best.select("flight_id", F.lit(category).alias("category"), F.lit(pick).alias("pick"), "rank", "score", "label")


def _first_free(starts: list[Column], free: Column) -> Column:
    """For each wanted free number its pick: the first one from there on, then from the beginning, that no earlier wish took."""
    width = len(starts)

    def choose(taken, start):
        onwards = F.when(start <= free, F.sequence(start, F.least(free, start + width))).otherwise(F.array().cast("array<bigint>"))
        around = F.sequence(F.lit(1).cast("long"), F.least(free, F.lit(width + 1).cast("long")))
        options = F.filter(F.concat(onwards, around), lambda x: (x >= 1) & (x <= free) & ~F.array_contains(taken, x))
        return F.concat(taken, F.array(F.when(free > 0, F.try_element_at(options, F.lit(1)))))

    return F.aggregate(F.array(*starts), F.array().cast("array<bigint>"), choose)


def select_cases(df: DataFrame, alert_fraction: float = 0.01, missed_fraction: float = 0.10, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), extremes: int = 3) -> DataFrame:
    """Rows to explain: extreme errors first, then typical members of four pools at fixed quantiles, no row twice.

    Members of a pool that are no extreme case have consecutive free numbers. A wanted place becomes the free number that
    follows it; one row for each pool settles which wishes fall together, and the picks are joined to the members.
    """
    if not 0 < alert_fraction < missed_fraction <= 1:
        raise ValueError("need 0 < alert_fraction < missed_fraction <= 1")
    ranked = keyed_rank(df.select("flight_id", "score", "label"), [], [("score", True), "flight_id"], "rank")
    n, event = F.col("rank_size"), F.col("label") == 1
    alert, missed = F.col("rank") <= nearest_count(n, F.lit(alert_fraction)), F.col("rank") > nearest_count(n, F.lit(missed_fraction))
    pool = (F.when(alert & event, "true_positive").when(alert, "false_positive").when(missed & event, "false_negative")
            .when(~event & (F.col("rank") > n / 2.0), "low_risk_correct"))
    pooled = stage(ranked.withColumn("pool", pool))
    chosen = stage(_extremes(pooled, 0, "high", extremes).unionByName(_extremes(pooled, 1, "low", extremes)))
    placed = keyed_rank(pooled.where(F.col("pool").isNotNull()), ["pool"], ["rank"], "place")
    gone = placed.join(F.broadcast(chosen.select("flight_id")), "flight_id", "left_semi")  # at most 2 * extremes rows
    gone = stage(gone.groupBy(F.col("pool").alias("of")).agg(F.sort_array(F.collect_list("place")).alias("gone")))
    members = placed.join(F.broadcast(gone), F.col("pool") == F.col("of"), "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<bigint>")))
    free = F.col("place") - F.size(F.filter("gone", lambda x: x < F.col("place")))
    members = members.where(~F.array_contains("gone", F.col("place"))).withColumn("free", free)

    def wish(q: float) -> Column:
        start = F.bround(F.lit(q) * (F.col("place_size") - 1), 0).cast("long") + 1
        return start - F.size(F.filter("gone", lambda x: x < start))

    pools = members.groupBy("pool").agg(F.first("place_size").alias("place_size"), F.first("gone").alias("gone"), F.max("free").alias("most"))
    names = F.array(*[F.lit(f"typical_q{round(q * 100):02d}") for q in quantiles])
    picks = pools.select(F.col("pool").alias("of_pool"), F.explode(F.arrays_zip(names.alias("pick"), _first_free([wish(q) for q in quantiles], F.col("most")).alias("at"))).alias("p")).select("of_pool", "p.pick", "p.at")
    typical = members.join(F.broadcast(picks), (F.col("pool") == F.col("of_pool")) & (F.col("free") == F.col("at")))  # pools times quantiles rows
    return chosen.unionByName(typical.select("flight_id", F.col("pool").alias("category"), "pick", "rank", "score", "label"))


def contribution_importance(long: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature and its share, from rows (id, feature, family, value, contribution)."""
    table = long.groupBy("feature", "family").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    return attach_row(table, table.agg(F.sum("mean_abs").alias("_all"))).select("feature", "family", "mean_abs", ratio(F.col("mean_abs"), F.col("_all")).alias("share_of_total"))


def family_importance(importance: DataFrame) -> DataFrame:
    return importance.groupBy("family").agg(F.sum("mean_abs").alias("mean_abs"), F.sum("share_of_total").alias("share_of_total"))


def numeric_effect(long: DataFrame, identity: str = "flight_id", bins: int = 5) -> DataFrame:
    """Mean contribution by equal-count bin of each numeric feature's value, ties by id.

    Rows shrink to counts per (feature, value, contribution). Equal values are neighbours in rank, so running counts place
    them; rows are ranked by id only where one value reaches over a bin edge with several contributions.
    """
    rows = long.where(F.col("value").isNotNull())
    counts = stage(rows.groupBy("feature", "value", "contribution").agg(F.count("*").alias("n")))
    values = counts.groupBy("feature", "value").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.col("contribution")).alias("total"),
                                                    F.sum(F.when(F.col("contribution").isNotNull(), F.col("n"))).alias("known_rows"))
    upto = running_totals(values, ["feature"], ["value"], {"last": "n"})
    steps = F.greatest(F.col("last_total") - 1, F.lit(1))

    def bin_at(rank):
        return F.greatest(F.lit(1), F.ceil((rank - 1) * bins / steps - 1e-9)).cast("int")

    def last_of(number):
        return F.when(number < 1, 0).when(number >= bins, F.col("last_total")).otherwise(F.floor((number + 1e-9) * steps / bins) + 1)

    first = F.col("last") - F.col("n") + 1
    placed = stage(upto.select("*", first.alias("first"), bin_at(first).alias("low"), bin_at(F.col("last")).alias("high")))
    torn = (F.col("low") != F.col("high")) & (F.col("kinds") > 1)
    cut = placed.where(~torn).withColumn("bin", F.explode(F.sequence("low", "high")))
    inside = F.least(F.col("last"), last_of(F.col("bin"))) - F.greatest(F.col("first"), last_of(F.col("bin") - 1) + 1) + 1
    share = F.col("total") * inside / F.col("n")
    whole = cut.select("feature", "bin", "value", inside.alias("rows"), (F.col("known_rows") * inside / F.col("n")).alias("known"), share.alias("total")).where(F.col("rows") > 0)
    ranked = keyed_rank(rows.join(placed.where(torn).select("feature", "value"), ["feature", "value"]).select("feature", "value", identity, "contribution"), ["feature", "value"], [identity], "_r")
    torn_rows = ranked.join(placed.select("feature", "value", "first", "last_total"), ["feature", "value"])
    single = torn_rows.select("feature", bin_at(F.col("first") + F.col("_r") - 1).alias("bin"), "value", F.lit(1).cast("long").alias("rows"),
                              F.col("contribution").isNotNull().cast("double").alias("known"), F.col("contribution").alias("total"))
    return whole.unionByName(single).groupBy("feature", "bin").agg(
        F.min("value").alias("value_low"), F.max("value").alias("value_high"), F.sum("rows").cast("long").alias("rows"), ratio(F.sum("total"), F.sum("known")).alias("mean_contribution"))


def categorical_effect(long: DataFrame, minimum: int, top: int) -> DataFrame:
    """Levels with the highest and lowest mean contribution among levels with enough rows (one row per level)."""
    table = long.groupBy("feature", "level").agg(F.count("*").alias("rows"), F.avg("contribution").alias("mean_contribution")).where(F.col("rows") >= minimum)
    part = Window.partitionBy("feature")
    ranked = table.withColumns({"_h": F.row_number().over(part.orderBy(F.desc("mean_contribution"), "level")), "_l": F.row_number().over(part.orderBy("mean_contribution", "level"))})
    keep = F.explode(F.array_compact(F.array(F.when(F.col("_h") <= top, F.struct(F.lit("highest").alias("d"), F.col("_h").alias("r"))),
                                             F.when(F.col("_l") <= top, F.struct(F.lit("lowest").alias("d"), F.col("_l").alias("r"))))))
    return ranked.select("feature", "level", "rows", "mean_contribution", keep.alias("k")).select("feature", F.col("k.d").alias("direction"), F.col("k.r").alias("place"), "level", "rows", "mean_contribution")


def top_contributions(wide: DataFrame, features: dict[str, str], k: int, identity: str = "flight_id") -> DataFrame:
    """The k features with the largest absolute contribution per row, by sorting a short array inside the row."""
    items = F.array(*[F.struct((-F.abs(F.col(c))).alias("m"), F.lit(f).alias("feature"), F.col(c).alias("contribution")) for f, c in features.items()])
    best = F.slice(F.array_sort(items), 1, k)
    return wide.select(identity, F.posexplode(best).alias("place", "t")).select(identity, (F.col("place") + 1).alias("place"), "t.feature", "t.contribution")
