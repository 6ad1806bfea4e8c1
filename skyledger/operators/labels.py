"""Labels, splits, roles and cohorts. Everything is row-local except the summaries and exact-size samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import clocks as C
from skyledger.functions.values import is_binary, ratio, tolerant_binary, tolerant_number
from skyledger.operators.ordering import keyed_rank

# Severe-delay thresholds in minutes, and the split names.
SEVERE_THRESHOLDS = (60, 90, 120, 180)
DEVELOPMENT, VALIDATION, FINAL_TEST, EMBARGOED = "development", "validation", "final_test_locked", "embargoed_boundary"
SPLITS = (DEVELOPMENT, VALIDATION, FINAL_TEST)
FIT, EARLY_STOP, EVAL, UNUSED = "fit", "early_stop", "eval", "unused"


@dataclass(frozen=True)
class Boundaries:
    """First days (UTC) of the validation and final periods, the early-stop start and where history begins."""

    validation_start: str = "2000-01-01"
    final_start: str = "2001-01-01"
    early_stop_start: str = "1999-07-01"
    history_start: str = "1995-02-01"
    confirmation_start: str = "2000-07-01"

    def __post_init__(self) -> None:
        if not self.early_stop_start <= self.validation_start < self.final_start:
            raise ValueError("split boundaries are out of order")


BOUNDARIES = Boundaries()
# Year to regime for the generated calendar; pass another map for other data.
REGIMES = {1995: "reference", 1996: "shock", 1997: "recovery", 1998: "recovery", 1999: "recovery", 2000: "recovery", 2001: "partial_final"}
THREE_REGIMES = {**REGIMES, 2001: "recovery"}


def seconds_of(day: str) -> Column:
    """UTC second at the start of an ISO date."""
    return F.unix_date(F.lit(day).cast("date")).cast("long") * C.DAY


def regime(day: Column, mapping: dict[int, str] = REGIMES, default: str = "other") -> Column:
    """Regime of a date by calendar year."""
    year = F.year(day)
    result = F.lit(default)
    for value, name in mapping.items():
        result = F.when(year == value, name).otherwise(result)
    return F.when(day.isNotNull(), result).otherwise(default)


def outcome_labels(df: DataFrame, thresholds=SEVERE_THRESHOLDS) -> DataFrame:
    """Cleaned flags, completed flag, nullable severe labels and the reason a row has none."""
    work = df.withColumns({
        "cancelled_source": tolerant_binary(F.col("cancelled")), "diverted_source": tolerant_binary(F.col("diverted")),
        "cancelled_valid": is_binary(F.col("cancelled")), "diverted_valid": is_binary(F.col("diverted")),
        "_delay": tolerant_number(F.col("arr_delay")),
    })
    completed = (
        F.col("cancelled_valid") & F.col("diverted_valid") & (F.coalesce("cancelled_source", F.lit(1)) == 0)
        & (F.coalesce("diverted_source", F.lit(1)) == 0) & F.col("_delay").isNotNull()
    )
    work = work.withColumns({"completed": completed, "delay_valid": F.col("_delay").isNotNull()})
    reason = (
        F.when(~F.col("cancelled_valid"), "invalid_cancelled_value")
        .when(F.col("cancelled_source") == 1, "cancelled_flight")
        .when(~F.col("diverted_valid"), "invalid_diverted_value")
        .when(F.col("diverted_source") == 1, "diverted_flight")
        .when(F.col("_delay").isNull(), "missing_or_invalid_arrival_delay")
        .otherwise("eligible_completed_flight")
    )
    return work.select(
        *df.columns, "cancelled_source", "diverted_source", "cancelled_valid", "diverted_valid", "delay_valid", "completed",
        F.when(F.col("completed"), F.col("_delay")).alias("delay_minutes"),
        *[F.when(F.col("completed"), (F.col("_delay") >= t).cast("int")).alias(f"severe_{t}") for t in thresholds],
        reason.alias("exclusion_reason"),
    )


def base_features(df: DataFrame) -> DataFrame:
    """Schedule-only predictors: calendar parts, clock parts (2400 is not accepted here), route and carrier id."""
    work, columns = _feature_columns(df)
    return work.select("flight_id", "flight_date", *[c.alias(n) for n, c in columns.items()])


def add_features(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the named columns of ``base_features`` next to its own; one of the same name is replaced."""
    work, columns = _feature_columns(df)
    return work.select(*[c for c in df.columns if c not in names], *[columns[n].alias(n) for n in names])


def _feature_columns(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    work = df.withColumns({
        "_dep": C.clock_minutes(F.col("dep_hhmm"), accept_2400=False),
        "_arr": C.clock_minutes(F.col("arr_hhmm"), accept_2400=False),
    })
    dep, arr = C.clock_parts(F.col("_dep")), C.clock_parts(F.col("_arr"))
    return work, {
        **{f"departure_{n}": c for n, c in C.calendar_parts(F.col("flight_date")).items()},
        "dep_hour": dep["hour"], "dep_minute": dep["minute"], "arr_hour": arr["hour"], "arr_minute": arr["minute"],
        "sched_elapsed": tolerant_number(F.col("sched_elapsed")), "distance": tolerant_number(F.col("distance")),
        "origin": F.col("origin"), "destination": F.col("destination"),
        "route": F.concat(F.coalesce("origin", F.lit("MISSING")), F.lit("-"), F.coalesce("destination", F.lit("MISSING"))),
        "carrier_id": F.concat(F.lit("ID_"), F.coalesce("carrier", F.lit("MISSING"))),
        "dep_time_valid": F.col("_dep").isNotNull(), "arr_time_valid": F.col("_arr").isNotNull(), "date_valid": F.col("flight_date").isNotNull(),
    }


def date_split(day: Column, b: Boundaries = BOUNDARIES) -> Column:
    """Split by local date."""
    return (
        F.when(day < F.lit(b.validation_start).cast("date"), DEVELOPMENT)
        .when(day < F.lit(b.final_start).cast("date"), VALIDATION)
        .when(day.isNotNull(), FINAL_TEST)
    )


def utc_embargo(split: Column, prediction: Column, b: Boundaries = BOUNDARIES) -> Column:
    """Keep a split label only where the UTC prediction second agrees with it."""
    start, final = seconds_of(b.validation_start), seconds_of(b.final_start)
    agrees = (
        ((split == DEVELOPMENT) & (prediction < start))
        | ((split == VALIDATION) & (prediction >= start) & (prediction < final))
        | ((split == FINAL_TEST) & (prediction >= final))
    )
    return F.when(F.coalesce(agrees, F.lit(False)), split).otherwise(EMBARGOED)


def cohort(df: DataFrame, b: Boundaries = BOUNDARIES) -> DataFrame:
    """Splits, regime and per-task eligibility on a labelled frame with ``prediction_utc``."""
    work = df.withColumn("original_split", date_split(F.col("flight_date"), b))
    work = work.withColumn("split", utc_embargo(F.col("original_split"), F.col("prediction_utc"), b))
    return work.select(
        *work.columns,
        regime(F.col("flight_date")).alias("regime"),
        (F.col("split") == EMBARGOED).alias("embargoed"),
        F.lit(True).alias("eligible_cancellation"),
        (F.col("completed") & F.col("severe_120").isNotNull()).alias("eligible_severe"),
        (F.col("completed") & F.col("delay_minutes").isNotNull()).alias("eligible_regression"),
    )


def cohort_summary(df: DataFrame) -> DataFrame:
    grouped = df.groupBy("split", "regime").agg(
        F.count("*").alias("rows"),
        F.sum(F.col("completed").cast("long")).alias("completed_flights"),
        F.sum(F.coalesce("cancelled_source", F.lit(0)).cast("long")).alias("cancelled_events"),
        F.coalesce(F.sum(F.col("severe_120").cast("long")), F.lit(0).cast("long")).alias("severe_events"),
    )
    return grouped.select(
        "*", ratio(F.col("cancelled_events"), F.col("rows")).alias("cancellation_rate"),
        ratio(F.col("severe_events"), F.col("completed_flights")).alias("severe_rate_completed"),
    )


def chronology(df: DataFrame, split: str, seconds: str) -> DataFrame:
    """First and last instant per split, in order, and whether each ends before the next starts (three rows)."""
    order = F.create_map(*[v for i, s in enumerate(SPLITS) for v in (F.lit(s), F.lit(i))])
    report = df.where(F.col(split).isin(*SPLITS)).groupBy(F.col(split).alias("split")).agg(
        F.count("*").alias("rows"), F.min(seconds).alias("min_utc"), F.max(seconds).alias("max_utc"))
    window = Window.partitionBy(F.lit(1)).orderBy(order[F.col("split")])  # at most three rows
    following = F.lead("min_utc").over(window)
    return report.select("*", (following.isNull() | (F.col("max_utc") < following)).alias("ends_before_next_starts"))


def split_crosstab(df: DataFrame) -> DataFrame:
    """Original split by embargoed split."""
    names = [*SPLITS, EMBARGOED]
    return df.groupBy("original_split").pivot("split", names).count().na.fill(0, names)


def roles(df: DataFrame, b: Boundaries = BOUNDARIES, early_stop: bool = True) -> DataFrame:
    """fit / early_stop / validation / final_test by split and UTC second; without early stop all development is fit."""
    split, second = F.col("split"), F.col("prediction_utc")
    late = (second >= seconds_of(b.early_stop_start)) if early_stop else F.lit(False)
    role = (
        F.when(split == VALIDATION, "validation").when(split == FINAL_TEST, "final_test")
        .when((split == DEVELOPMENT) & late, EARLY_STOP).when(split == DEVELOPMENT, FIT)
    )
    return df.withColumn("role", role)


#: The roles in the order in which they must follow each other.
ROLE_ORDER = ("fit", "early_stop", "validation", "final_test")


def role_spans(df: DataFrame) -> DataFrame:
    """Rows and span of each role, and whether it ends before the next role present begins: strictly, no shared instant."""
    spans = df.groupBy("role").agg(F.count("*").alias("rows"), F.min("prediction_utc").alias("first_utc"), F.max("prediction_utc").alias("last_utc"))
    place = F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), F.col("role"))
    following = F.lead("first_utc").over(Window.orderBy(place))  # one row for each role
    return spans.withColumn("ends_before_next", F.coalesce(F.col("last_utc") < following, F.lit(True)))


def require_chronology(spans: DataFrame) -> DataFrame:
    """The spans, unless a role reaches into the next one."""
    late = [r["role"] for r in spans.where(~F.col("ends_before_next")).select("role").collect()]
    if late:
        raise ValueError(f"roles that do not end before the next one begins: {sorted(late)}")
    return spans


def expanding_roles(second: Column, year: int, stop_months: int = 6) -> Column:
    """fit, then ``stop_months`` of early stop, then the evaluation year."""
    if stop_months < 1:
        raise ValueError("stop_months must be at least 1")
    start = F.lit(f"{year}-01-01").cast("date")
    stop = F.unix_date(F.add_months(start, -stop_months)).cast("long") * C.DAY
    return (
        F.when(second < stop, FIT).when(second < seconds_of(f"{year}-01-01"), EARLY_STOP)
        .when(second < seconds_of(f"{year + 1}-01-01"), EVAL).when(second.isNotNull(), UNUSED)
    )


def expanding_windows(df: DataFrame, years: list[int], stop_months: int = 6) -> DataFrame:
    """Role of every row for every evaluation year, as an exploded array (rows x years, no join)."""
    pairs = F.array(*[F.struct(F.lit(y).alias("eval_year"), expanding_roles(F.col("prediction_utc"), y, stop_months).alias("role")) for y in years])
    return df.select("*", F.explode(pairs).alias("_p")).select(*df.columns, "_p.eval_year", "_p.role")


def half(second: Column, b: Boundaries = BOUNDARIES) -> Column:
    """Selection or confirmation half of the validation year; other rows get null."""
    inside = (second >= seconds_of(b.validation_start)) & (second < seconds_of(b.final_start))
    return F.when(inside & (second < seconds_of(b.confirmation_start)), "selection").when(inside, "confirmation")


def seeded_order(identity: Column, seed: int) -> Column:
    """A reproducible random order: the digest of seed and id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), identity.cast("string")))


def exact_sample(df: DataFrame, rows: int, seed: int, identity: str = "flight_id") -> DataFrame:
    """Exactly ``rows`` rows (or all, if fewer) in a seeded order, by distributed rank rather than a global sort."""
    if rows < 1:
        raise ValueError("rows must be at least 1")
    ranked = keyed_rank(df.withColumn("_order", seeded_order(F.col(identity), seed)), [], ["_order", identity], "_rank")
    return ranked.where(F.col("_rank") <= rows).select(*df.columns)


def fit_variants(df: DataFrame, shock_year: int, seed: int, identity: str = "flight_id") -> DataFrame:
    """The fit rows under three variants: all, without the shock year, and a size-matched random subset."""
    year = F.year(F.timestamp_seconds("prediction_utc"))
    kept = df.where(year != shock_year)
    size = kept.count()
    if size == 0:
        raise ValueError("every fit row is from the shock year")
    matched = exact_sample(df, size, seed, identity)
    return (
        df.withColumn("variant", F.lit("full")).unionByName(kept.withColumn("variant", F.lit("without_shock")))
        .unionByName(matched.withColumn("variant", F.lit("matched")))
    )


def fit_composition(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """Rows, events, rate and share of fit rows by UTC year (one row per year, so the total window is tiny)."""
    by_year = df.groupBy(*keys, F.year(F.timestamp_seconds("prediction_utc")).alias("year")).agg(
        F.count("*").alias("rows"), F.sum(F.col(label).cast("long")).alias("events"))
    total = F.sum("rows").over(Window.partitionBy(*(keys or [F.lit(1)])))
    return by_year.select("*", ratio(F.col("events"), F.col("rows")).alias("event_rate"), ratio(F.col("rows"), total).alias("share_of_fit_rows"))


def separate_labels(df: DataFrame, predictors: list[str], labels: list[str], eligible: str) -> tuple[DataFrame, DataFrame]:
    """Predictor table and label table of the eligible rows, kept apart and joined again only by id."""
    kept = df.where(F.col(eligible))
    return kept.select("flight_id", *predictors), kept.select("flight_id", *labels)
