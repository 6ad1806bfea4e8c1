"""Audit, typing and expectation queries."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from skyledger.functions.values import is_binary, normalise_code, strict_binary, to_boolean, tolerant_binary
from skyledger.operators import labels as L
from skyledger.operators import profile as P
from skyledger.operators import schema as X
from skyledger.operators.attach import attach_row
from skyledger.operators.schedule import prediction_times, standardise as standardise_columns
from skyledger.plans.cohorts import _COHORT, _REGIME, cohort_frame, labelled
from skyledger.plans.oracle_views import FLIGHTS, div
from skyledger.sources import files
from skyledger.session import scratch_folder
from skyledger.sources.adapters import FLIGHT_COLUMNS, ZONES, flights, table
from skyledger.sources.fingerprint import fingerprint


def standardise(spark, folder):
    raw = flights(spark, folder, "flight_id", "carrier_code", "origin", "destination").withColumnsRenamed(
        {"flight_id": "ID", "carrier_code": "OP CARRIER", "origin": "ORG", "destination": "DST"})
    names = {"ID": "flight_id", "OP CARRIER": "carrier_code", "ORG": "origin", "DST": "destination"}
    return standardise_columns(raw, names, ["carrier_code", "origin", "destination"])


_RAW_FLAG = """CASE WHEN l_partkey % 31 = 0 THEN 'x' WHEN l_partkey % 37 = 0 THEN NULL WHEN l_partkey % 41 = 0 THEN '2'
 WHEN l_returnflag = 'R' THEN '1' ELSE '0.0' END"""


def binary_clean(spark, folder):
    raw = table(spark, folder, "lineitem").select(F.expr(_RAW_FLAG).alias("raw"))
    flag = F.col("raw")
    usable = F.when(is_binary(flag), flag)
    return raw.select("raw", tolerant_binary(flag).alias("cleaned"), is_binary(flag).alias("valid"), to_boolean(usable).alias("as_boolean"),
                      strict_binary(usable, "raw").alias("strict")).groupBy("raw", "cleaned", "valid", "as_boolean", "strict").agg(F.count("*").alias("rows"))


def select_features(spark, folder):
    df = flights(spark, folder, "flight_id", "sched_elapsed", "distance", "origin", "carrier_code")
    df = df.withColumn("carrier_code", F.when(F.col("carrier_code") != " c3 ", normalise_code(F.col("carrier_code"))))
    return X.select_base_features(df, ["sched_elapsed", "distance"], ["origin", "carrier_code"])


def feature_sets(spark, folder):
    """Every named feature set over the schedule predictors: its columns, those that other tables must add, and the values that are there."""
    df = L.base_features(flights(spark, folder, "flight_id", "flight_date", "dep_hhmm", "arr_hhmm", "sched_elapsed", "distance", "origin", "destination", "carrier"))
    rows = []
    for name in X.FEATURE_SETS:
        columns = X.feature_columns(name)
        present = [c for c in columns if c in df.columns]
        if len(present) == len(columns):
            X.validate_features(df, name)
        values = reduce(add, (F.count(c) for c in present))
        rows.append(F.struct(F.lit(name).alias("feature_set"), F.lit(len(columns)).alias("columns"), F.lit(len(columns) - len(present)).alias("to_join"), F.count("*").alias("rows"), values.alias("values")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


INSTANTS = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


def utc_guard(spark, folder):
    """Each time column as an instant and as a wall clock: whether the guard takes it, and the span that it then has."""
    parts = []
    for name, column in INSTANTS.items():
        for form, kind in (("instant", "timestamp"), ("wall_clock", "timestamp_ntz")):
            df = table(spark, folder, name).select(F.col(column).cast(kind).alias(column))
            try:
                value, accepted = F.unix_micros(X.require_utc(df, column)), True
            except ValueError:
                value, accepted = F.lit(None).cast("long"), False
            parts.append(df.agg(F.lit(name).alias("table_name"), F.lit(form).alias("form"), F.lit(accepted).alias("accepted"), F.count(column).alias("values"),
                                F.min(value).alias("first_micros"), F.max(value).alias("last_micros")))
    return X.stack_tables(parts)


def _two_tables(spark, folder):
    df = flights(spark, folder, "flight_id", "flight_date", "dep_hhmm", "flight_number")
    left = df.where(F.col("flight_number") % 113 != 0)
    right = df.where(F.col("flight_number") % 109 != 0).withColumns({
        "dep_hhmm": F.when(F.col("flight_number") % 127 == 0, F.lit(None)).otherwise(F.col("dep_hhmm")),
        "flight_date": F.when(F.col("flight_number") % 131 == 0, F.date_add("flight_date", 1)).otherwise(F.col("flight_date"))})
    return left, right


def table_alignment(spark, folder):
    return X.alignment(*_two_tables(spark, folder), "flight_id", ["flight_date", "dep_hhmm"])


def row_equality(spark, folder):
    return X.first_mismatches(*_two_tables(spark, folder), "flight_id", ["flight_date", "dep_hhmm"])


def id_set_diff(spark, folder):
    return X.id_set_difference(*_two_tables(spark, folder), "flight_id")


def guard_violations(spark, folder):
    """The period guard where some evaluation rows are among the calibration rows too, so that it has something to find."""
    df = cohort_frame(spark, folder, "flight_number").where(F.col("prediction_utc").isNotNull())
    early = F.col("original_split") == L.DEVELOPMENT
    return X.period_guard(df.where(early), df.where(~early | (F.col("flight_number") % 151 == 0)), "flight_id", "prediction_utc", L.seconds_of("2001-01-01"))


def fixed_lead(spark, folder):
    """The fixed lead where some predictions are lost and some are shifted by a minute."""
    df = prediction_times(flights(spark, folder, "flight_date", "dep_hhmm", "origin_zone", "flight_number"), zones=ZONES)
    number = F.col("flight_number")
    broken = F.when(number % 211 != 0, F.col("prediction_utc") + F.when(number % 223 == 0, 60).otherwise(0))
    return X.lead_violations(df.withColumn("prediction_utc", broken), "departure_utc", "prediction_utc")


def key_uniqueness(spark, folder):
    df = flights(spark, folder, "flight_id", "flight_date", "carrier", "flight_number", "origin", "destination", "dep_hhmm")
    parts = [X.key_uniqueness(df, ["flight_id"], "flight_id"),
             X.key_uniqueness(df, ["flight_date", "carrier", "origin", "dep_hhmm"], "schedule_slot"),
             X.key_uniqueness(df, ["flight_date", "flight_number", "origin", "destination"], "natural_key")]
    return X.stack_tables(parts)


def label_audit(spark, folder):
    """Labels against the rule applied to the source, counted in one pass over a copy in which some labels are spoiled."""
    df, number = labelled(spark, folder, "flight_number"), F.col("flight_number")
    df = df.withColumns({
        "completed": F.when(number % 89 == 0, ~F.col("completed")).otherwise(F.col("completed")),
        "severe_120": F.when(number % 97 == 0, 1 - F.col("severe_120")).when(number % 101 == 0, F.lit(None)).otherwise(F.col("severe_120")),
        "exclusion_reason": F.when(number % 103 == 0, "spoiled").otherwise(F.col("exclusion_reason"))})
    done = (F.col("cancelled") == 0) & (F.col("diverted") == 0) & F.col("arr_delay").isNotNull()
    checks = {"completed_disagrees": F.col("completed") != done, "label_without_completion": ~F.col("completed") & F.col("severe_120").isNotNull(),
              "completion_without_label": F.col("completed") & F.col("severe_120").isNull(),
              "order_broken": (F.col("severe_180") > F.col("severe_120")) | (F.col("severe_120") > F.col("severe_60")),
              "reason_disagrees": F.col("completed") != (F.col("exclusion_reason") == "eligible_completed_flight")}
    checks |= {f"severe_{t}_disagrees": (F.col(f"severe_{t}") == 1) != (F.col("arr_delay") >= t) for t in L.SEVERE_THRESHOLDS}
    return df.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in checks.items()])


def missingness_profile(spark, folder):
    return P.missingness(flights(spark, folder), [c for c in FLIGHT_COLUMNS if not c.startswith("score")])


def categorical_profile(spark, folder):
    df = flights(spark, folder, "carrier", "origin", "destination", "carrier_code")
    return P.categorical(df, ["carrier", "origin", "destination", "carrier_code"], 5)


def numeric_profile(spark, folder):
    columns = ["dep_hhmm", "arr_hhmm", "sched_elapsed", "distance", "arr_delay", "dep_delay", "elapsed"]
    return P.numeric(flights(spark, folder, *columns), columns)


def date_coverage(spark, folder):
    return P.date_coverage(flights(spark, folder, "flight_date"), "flight_date")


def airport_coverage(spark, folder):
    return P.airport_coverage(flights(spark, folder, "flight_id", "origin", "destination", "origin_city", "destination_city"))


def carrier_mapping(spark, folder):
    df = flights(spark, folder, "carrier", "carrier_code")
    return P.code_mapping(df.withColumn("carrier_code", normalise_code(F.col("carrier_code"))), "carrier", "carrier_code")


def entity_coverage(spark, folder):
    df = flights(spark, folder, "flight_date", "carrier", "origin", "destination")
    return P.entity_coverage(df.withColumns({"regime": L.regime(F.col("flight_date")), "route": F.concat_ws("-", "origin", "destination")}))


FINGERPRINTED = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"], "events": ["event_id", "ts", "user_id", "event_type", "value", "props"]}


def table_fingerprint(spark, folder):
    """All columns of all tables that the package reads."""
    return X.stack_tables([fingerprint(table(spark, folder, t), t, c, portable=True) for t, c in FINGERPRINTED.items()])


def null_rates(spark, folder):
    df = flights(spark, folder, "flight_date", "dep_hhmm", "arr_hhmm", "sched_elapsed", "distance")
    return P.null_rates(df.withColumn("split", L.date_split(F.col("flight_date"))), ["dep_hhmm", "arr_hhmm", "sched_elapsed", "distance"], "split")


def unseen_categories(spark, folder):
    df = flights(spark, folder, "flight_date", "origin", "destination", "carrier", "flight_number")
    df = df.withColumns({"split": L.date_split(F.col("flight_date")), "number": F.concat_ws("-", "carrier", "flight_number")})
    return P.unseen_levels(df.where(F.col("split") == L.DEVELOPMENT), df.where(F.col("split") != L.DEVELOPMENT), ["origin", "carrier", "number"], "split")


def airport_universe(spark, folder):
    return P.universe(flights(spark, folder, "flight_date", "origin", "destination"), ["origin", "destination"], "flight_date")


def stacked_tables(spark, folder):
    """Two report tables with different columns in one table."""
    df = flights(spark, folder, "flight_date", "carrier", "cancelled", "distance")
    a = df.groupBy("carrier").agg(F.count("*").alias("rows"), F.sum(F.col("cancelled").cast("long")).alias("cancelled_events"))
    b = df.groupBy(F.year("flight_date").alias("year")).agg(F.count("*").alias("rows"), F.max("distance").alias("max_distance"))
    return X.stack_tables([a, b])


def score_alignment(spark, folder):
    """Scores joined to labels by id, with one row of agreement counts."""
    from skyledger.sources.adapters import scored

    df = scored(spark, folder, "flight_number")
    other = df.where(F.col("flight_number") % 101 != 0).withColumn("label", F.when(F.col("flight_number") % 103 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    aligned = X.align_scores(df, other, "score")
    return aligned.agg(F.count("*").alias("rows"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("missing_row", "label_differs", "unusable_score")],
                       F.round(F.sum("aligned_score"), 6).alias("score_sum"))


CSV_TYPES = {"flight_id": "text", "flight_date": "date", "carrier_code": "code", "dep_hhmm": "double", "cancelled": "int", "arr_delay": "double"}


def csv_round_trip(spark, folder):
    """Write a CSV copy, read it back all-text with pruning and typed by role, and profile the result."""
    df = flights(spark, folder, "flight_id", "flight_date", "carrier_code", "dep_hhmm", "cancelled", "arr_delay", "distance")
    path = scratch_folder(spark)
    files.write_csv(df.withColumn("cancelled", F.col("cancelled").cast("int")), path)
    typed = files.read_csv_typed(spark, path, df.columns, CSV_TYPES)
    text = files.read_csv_text(spark, path, df.columns, ["dep_hhmm"])
    counts = typed.groupBy("carrier_code").agg(
        F.count("*").alias("rows"), F.min("flight_date").cast("string").alias("first_day"), F.sum("cancelled").alias("cancelled_events"),
        F.sum("arr_delay").alias("delay_sum"))
    return attach_row(counts, text.agg(F.sum(F.col("dep_hhmm").try_cast("double").isNull().cast("long")).alias("blank_clocks")))


# What the flight view has of the raw file's columns; the others are blank in it.
RAW_FROM_VIEW = {
    "FL_DATE": "flight_date", "AIRLINE_CODE": "carrier_code", "FL_NUMBER": "flight_number", "ORIGIN": "origin", "ORIGIN_CITY": "origin_city", "DEST": "destination", "DEST_CITY": "destination_city",
    "CRS_DEP_TIME": "dep_hhmm", "DEP_DELAY": "dep_delay", "CRS_ARR_TIME": "arr_hhmm", "ARR_TIME": "reported_arr_hhmm", "ARR_DELAY": "arr_delay", "CANCELLED": "cancelled", "DIVERTED": "diverted",
    "CRS_ELAPSED_TIME": "sched_elapsed", "ELAPSED_TIME": "elapsed", "DISTANCE": "distance"}


def raw_flights(spark, folder):
    """A raw flight file with all its columns, written as CSV, read as text, brought to canonical names and types, and summed up."""
    df = flights(spark, folder, *dict.fromkeys(RAW_FROM_VIEW.values()))
    path = scratch_folder(spark)
    raw = df.select(*[(F.col(RAW_FROM_VIEW[c]).cast("string") if c in RAW_FROM_VIEW else F.lit("")).alias(c) for c in files.RAW_FLIGHT_COLUMNS])
    files.write_csv(raw, path)
    typed = files.canonical_flights(files.read_csv_text(spark, path, raw.columns, raw.columns))
    numbers = ("scheduled_departure_time_local_hhmm", "arrival_delay_minutes", "cancelled_indicator", "distance_miles", "scheduled_elapsed_minutes")
    filled = [name for name, _ in files.RAW_FLIGHT_COLUMNS.values()]
    return typed.groupBy("reporting_airline_code").agg(
        F.count("*").alias("rows"), F.min("flight_date_local").cast("string").alias("first_day"), *[F.sum(c).alias(f"sum_{c}") for c in numbers], *[F.count(c).alias(f"filled_{c}") for c in filled if c != "reporting_airline_code"])


def published_table(spark, folder):
    """Publish a typed Parquet table through a checked staging folder and read it with a pushed filter."""
    df = labelled(spark, folder).withColumn("split", L.date_split(F.col("flight_date")))
    path = scratch_folder(spark)

    def complete(written):
        X.enforce(written.agg(F.count("*").alias("n"), F.countDistinct("flight_id").alias("k")), {"unique ids": F.col("n") == F.col("k")})

    files.publish(df.select("flight_id", "split", "completed", "severe_120", "delay_minutes"), path, complete)
    kept = files.read_parquet(spark, path, ["severe_120", "delay_minutes"], (F.col("split") == L.VALIDATION) & F.col("completed"))
    return kept.groupBy("severe_120").agg(F.count("*").alias("rows"), F.sum("delay_minutes").alias("delay_sum"))


def zone_dimension(spark, folder):
    """Airport to zone lookup, validated, attached for origin and destination."""
    keys = table(spark, folder, "nation").select(
        F.concat(F.lit(" n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("airport"),
        F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("n_nationkey") % 6 + 1).cast("int")).alias("zone"), F.lit("confirmed").alias("status"))
    lookup = files.load_dimension(keys, "airport", "zone", {"status": {"confirmed"}})
    df = flights(spark, folder, "origin", "destination")
    joined = files.attach_dimension(df, lookup, "airport", "zone", {"origin": "from_zone", "destination": "to_zone"}, fixed_rows=25)
    return joined.groupBy("from_zone", "to_zone").agg(F.count("*").alias("rows"))


QUERIES = {f.__name__: f for f in (
    standardise, binary_clean, select_features, table_alignment, row_equality, id_set_diff, guard_violations, fixed_lead, key_uniqueness,
    label_audit, missingness_profile, categorical_profile, numeric_profile, date_coverage, airport_coverage, carrier_mapping, entity_coverage,
    table_fingerprint, null_rates, unseen_categories, airport_universe, stacked_tables, score_alignment, csv_round_trip, raw_flights, published_table, zone_dimension, feature_sets, utc_guard)}

_LEFT = "lt AS (SELECT flight_id, flight_date, dep_hhmm FROM flights WHERE flight_number % 113 <> 0)"
_RIGHT = """rt AS (SELECT flight_id, CASE WHEN flight_number % 131 = 0 THEN flight_date + 1 ELSE flight_date END AS flight_date,
  CASE WHEN flight_number % 127 = 0 THEN NULL ELSE dep_hhmm END AS dep_hhmm FROM flights WHERE flight_number % 109 <> 0)"""
_PAIR = f"{FLIGHTS}, {_LEFT}, {_RIGHT}"
_SPLITS = "CASE WHEN year(flight_date) < 2000 THEN 'development' WHEN year(flight_date) = 2000 THEN 'validation' ELSE 'final_test_locked' END"


def _unique(name: str, keys: str) -> str:
    where = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"""SELECT '{name}' AS key_name, CAST(sum(n) AS BIGINT) AS rows_with_key, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicate_groups,
CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_duplicate_groups FROM (SELECT count(*) AS n FROM flights WHERE {where} GROUP BY {keys})"""


_AMOUNTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "s_acctbal", "c_acctbal", "value")
_INSTANTS = ("l_shipdate", "o_orderdate", "ts")


_REST = "((abs({0}) - floor(abs({0}))) * 9007199254740992::DOUBLE)"
_BINARY_DIGITS = f"""(CASE WHEN {{0}} < 0 THEN '-' ELSE '' END || CAST(floor(abs({{0}})) AS BIGINT) || '.' || CAST(floor({_REST}) AS BIGINT) || '.' ||
  CAST(floor(({_REST} - floor({_REST})) * 9007199254740992::DOUBLE) AS BIGINT))"""


def _finger(name: str, columns: list[str]) -> str:
    form = {**dict.fromkeys(_AMOUNTS, _BINARY_DIGITS), **dict.fromkeys(_INSTANTS, "epoch_us({0})")}
    texts = [f"CAST({form.get(c, '{0}').format(c)} AS STRING)" for c in columns]
    text = " || ".join(f"coalesce(length({t}) || ':' || {t}, '~')" for t in texts)
    return f"""SELECT '{name}' AS table_name, count(*) AS rows, bit_xor(h) AS digest_xor, CAST(sum(h % 1000000007) AS BIGINT) AS digest_sum
FROM (SELECT CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) AS h FROM {name})"""


def _unseen(column: str, expr: str) -> str:
    return f"""SELECT split, '{column}' AS feature, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (k IS NULL) AS unseen_levels, CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT) AS unseen_rows
FROM (SELECT split, {expr} AS lv, count(*) AS n FROM s WHERE split <> 'development' GROUP BY 1, 2) LEFT JOIN (SELECT DISTINCT {expr} AS k FROM s WHERE split = 'development') ON lv = k GROUP BY 1"""


_PROFILED = [c for c in FLIGHT_COLUMNS if not c.startswith("score")]
_STATUS = """CASE WHEN rights_per_left = 1 AND lefts_per_right = 1 THEN 'one_to_one' WHEN lefts_per_right > 1 THEN 'several_left_codes' WHEN rights_per_left > 1 THEN 'several_right_codes' ELSE 'review' END"""
_ZONE_CASE = "CASE CAST(substr({0}, 2) AS INT) % 6 " + " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(ZONES)) + " END"

SQL = {
    "standardise": f"WITH {FLIGHTS} SELECT flight_id, upper(trim(carrier_code)) AS carrier_code, origin, destination FROM flights",
    "binary_clean": f"""WITH r AS (SELECT {_RAW_FLAG} AS raw FROM lineitem) SELECT raw, CAST(CASE WHEN raw IN ('1', '0.0') THEN CAST(raw AS DOUBLE) END AS INT) AS cleaned,
coalesce(raw IN ('1', '0.0'), false) AS valid, coalesce(raw = '1', false) AS as_boolean, CASE WHEN raw = '1' THEN 1 WHEN raw = '0.0' THEN 0 END AS strict, count(*) AS rows FROM r GROUP BY ALL""",
    "select_features": f"""WITH {FLIGHTS} SELECT flight_id, sched_elapsed, distance, coalesce(origin, '__MISSING__') AS origin,
CASE WHEN carrier_code = ' c3 ' THEN '__MISSING__' ELSE upper(trim(carrier_code)) END AS carrier_code FROM flights""",
    "table_alignment": f"""WITH {_PAIR} SELECT count(lt.flight_id) AS left_rows, count(rt.flight_id) AS right_rows, count(*) FILTER (lt.flight_id IS NOT NULL AND rt.flight_id IS NOT NULL) AS matched_rows,
count(*) FILTER (rt.flight_id IS NULL) AS only_left, count(*) FILTER (lt.flight_id IS NULL) AS only_right,
count(*) FILTER (lt.flight_id = rt.flight_id AND lt.flight_date IS DISTINCT FROM rt.flight_date) AS flight_date_differs,
count(*) FILTER (lt.flight_id = rt.flight_id AND lt.dep_hhmm IS DISTINCT FROM rt.dep_hhmm) AS dep_hhmm_differs FROM lt FULL JOIN rt ON lt.flight_id = rt.flight_id""",
    "row_equality": f"WITH {_PAIR} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS compared_rows, count(*) FILTER (lt.{c} IS DISTINCT FROM rt.{c}) AS mismatches,
min(CASE WHEN lt.{c} IS DISTINCT FROM rt.{c} THEN lt.flight_id END) AS first_mismatch FROM lt JOIN rt ON lt.flight_id = rt.flight_id""" for c in ("flight_date", "dep_hhmm")),
    "id_set_diff": f"""WITH {_PAIR} SELECT 'in_both' AS side, count(*) AS ids, min(flight_id) AS first_id FROM (SELECT flight_id FROM lt INTERSECT SELECT flight_id FROM rt)
UNION ALL SELECT 'only_left', count(*), min(flight_id) FROM (SELECT flight_id FROM lt EXCEPT SELECT flight_id FROM rt)
UNION ALL SELECT 'only_right', count(*), min(flight_id) FROM (SELECT flight_id FROM rt EXCEPT SELECT flight_id FROM lt)""",
    "guard_violations": f"""WITH {_COHORT}, k AS (SELECT *, original_split = 'development' AS early, original_split <> 'development' OR flight_number % 151 = 0 AS later FROM cohort WHERE prediction_utc IS NOT NULL),
g AS (SELECT count(*) FILTER (early AND prediction_utc >= epoch(DATE '2001-01-01')) + count(*) FILTER (later AND prediction_utc >= epoch(DATE '2001-01-01')) AS locked_rows,
max(prediction_utc) FILTER (early) AS calibration_end, min(prediction_utc) FILTER (later) AS evaluation_start, count(*) FILTER (early AND later) AS shared_ids FROM k)
SELECT *, calibration_end < evaluation_start AS in_order FROM g""",
    "fixed_lead": f"""WITH {_COHORT}, p AS (SELECT departure_utc AS d, CASE WHEN flight_number % 211 <> 0 THEN prediction_utc + CASE WHEN flight_number % 223 = 0 THEN 60 ELSE 0 END END AS p FROM cohort)
SELECT count(*) AS rows, count(p) AS with_prediction, count(*) FILTER ((d IS NULL) <> (p IS NULL)) AS one_sided, count(*) FILTER (d - p <> 7200) AS wrong_lead FROM p""",
    "key_uniqueness": f"WITH {FLIGHTS} " + " UNION ALL ".join((
        _unique("flight_id", "flight_id"), _unique("schedule_slot", "flight_date, carrier, origin, dep_hhmm"), _unique("natural_key", "flight_date, flight_number, origin, destination"))),
    "label_audit": f"""WITH {FLIGHTS}, a AS (SELECT flight_number, arr_delay, coalesce(cancelled = 0 AND diverted = 0 AND arr_delay IS NOT NULL, false) AS done FROM flights),
b AS (SELECT *, CASE WHEN flight_number % 89 = 0 THEN NOT done ELSE done END AS completed, """ + ", ".join(f"CASE WHEN done THEN CAST(arr_delay >= {t} AS INT) END AS r{t}" for t in L.SEVERE_THRESHOLDS) + """ FROM a),
c AS (SELECT *, CASE WHEN flight_number % 97 = 0 THEN 1 - r120 WHEN flight_number % 101 = 0 THEN NULL ELSE r120 END AS s120, CASE WHEN flight_number % 103 = 0 THEN false ELSE done END AS eligible FROM b)
SELECT count(*) AS rows, count(*) FILTER (completed <> done) AS completed_disagrees, count(*) FILTER (NOT completed AND s120 IS NOT NULL) AS label_without_completion,
count(*) FILTER (completed AND s120 IS NULL) AS completion_without_label, count(*) FILTER (r180 > s120 OR s120 > r60) AS order_broken, count(*) FILTER (completed <> eligible) AS reason_disagrees, """
        + ", ".join(f"count(*) FILTER (({'s' if t == 120 else 'r'}{t} = 1) <> (arr_delay >= {t})) AS severe_{t}_disagrees" for t in L.SEVERE_THRESHOLDS) + " FROM c",
    "missingness_profile": f"WITH {FLIGHTS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS STRING)) = '') AS missing_rows, "
        f"count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS STRING)) = '')::DOUBLE / count(*) * 100 AS missing_pct FROM flights" for c in _PROFILED),
    "categorical_profile": f"WITH {FLIGHTS}, c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS level, count(*) AS rows FROM flights GROUP BY 2" for c in ("carrier", "origin", "destination", "carrier_code"))
        + """), t AS (SELECT column_name, count(level) AS distinct_levels, CAST(coalesce(sum(rows) FILTER (level IS NULL), 0) AS BIGINT) AS missing_rows FROM c GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY rows DESC, level) AS rank FROM c WHERE level IS NOT NULL)
SELECT r.column_name, rank, level, rows, distinct_levels, missing_rows FROM r JOIN t USING (column_name) WHERE rank <= 5""",
    "numeric_profile": f"WITH {FLIGHTS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS non_missing, min({c}) AS min_value, max({c}) AS max_value, sum({c}) / count({c}) AS mean_value, median({c}) AS median_value FROM flights"
        for c in ("dep_hhmm", "arr_hhmm", "sched_elapsed", "distance", "arr_delay", "dep_delay", "elapsed")),
    "date_coverage": f"""WITH {FLIGHTS} SELECT year(flight_date) AS year, count(*) AS rows, count(DISTINCT flight_date) AS days, CAST(min(flight_date) AS STRING) AS first_day,
CAST(max(flight_date) AS STRING) AS last_day, date_diff('day', min(flight_date), max(flight_date)) + 1 - count(DISTINCT flight_date) AS missing_days FROM flights GROUP BY 1""",
    "airport_coverage": f"""WITH {FLIGHTS}, a AS (SELECT flight_id, 1 AS o, 0 AS d, origin AS airport, origin_city AS city FROM flights UNION ALL SELECT flight_id, 0, 1, destination, destination_city FROM flights)
SELECT airport, CAST(sum(o) AS BIGINT) AS origin_rows, CAST(sum(d) AS BIGINT) AS destination_rows, count(*) AS total_rows, arg_min(city, flight_id) AS first_city FROM a GROUP BY 1""",
    "carrier_mapping": f"""WITH {FLIGHTS}, p AS (SELECT carrier, upper(trim(carrier_code)) AS carrier_code, count(*) AS rows FROM flights GROUP BY 1, 2),
q AS (SELECT *, count(*) OVER (PARTITION BY carrier) AS rights_per_left, count(*) OVER (PARTITION BY carrier_code) AS lefts_per_right FROM p) SELECT *, {_STATUS} AS mapping_status FROM q""",
    "entity_coverage": f"WITH {FLIGHTS}, f AS (SELECT *, {_REGIME} AS regime FROM flights) " + " UNION ALL ".join(
        f"SELECT regime, '{n}' AS role, count(DISTINCT {e}) AS entities, count(*) AS appearances FROM f GROUP BY 1"
        for n, e in (("carrier", "carrier"), ("origin", "origin"), ("destination", "destination"), ("route", "origin || '-' || destination"))),
    "feature_sets": f"WITH {FLIGHTS}, v AS (SELECT count(*) AS n, count(*) FILTER (dep_hhmm < 2400) AS dep, count(*) FILTER (arr_hhmm < 2400) AS arr, count(distance) AS di, count(sched_elapsed) AS el FROM flights) "
    + " UNION ALL ".join(
        f"SELECT '{name}{suffix}' AS feature_set, {12 + more + year} AS columns, {more} AS to_join, n AS rows, {6 + year} * n + 2 * dep + 2 * arr + di + el AS values FROM v"
        for name, more in (("base", 0), ("base_history", 3), ("base_network", 4), ("full", 7)) for suffix, year in (("", 1), ("_no_year", 0))),
    "utc_guard": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{form}' AS form, {ok} AS accepted, count({c}) AS values, {'min' if ok else 'any_value'}({'epoch_us(' + c + ')' if ok else 'NULL::BIGINT'}) AS first_micros, "
        f"{'max' if ok else 'any_value'}({'epoch_us(' + c + ')' if ok else 'NULL::BIGINT'}) AS last_micros FROM {t}" for t, c in INSTANTS.items() for form, ok in (("instant", True), ("wall_clock", False))),
    "table_fingerprint": " UNION ALL ".join(_finger(t, c) for t, c in FINGERPRINTED.items()),
    "null_rates": f"WITH {FLIGHTS}, s AS (SELECT *, {_SPLITS} AS split FROM flights) " + " UNION ALL ".join(
        f"SELECT split, '{c}' AS feature, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS null_rows, count(*) FILTER ({c} IS NULL)::DOUBLE / count(*) AS null_rate FROM s GROUP BY 1"
        for c in ("dep_hhmm", "arr_hhmm", "sched_elapsed", "distance")),
    "unseen_categories": f"WITH {FLIGHTS}, s AS (SELECT *, {_SPLITS} AS split FROM flights) " + " UNION ALL ".join(
        _unseen(c, e) for c, e in (("origin", "origin"), ("carrier", "carrier"), ("number", "carrier || '-' || CAST(flight_number AS STRING)"))),
    "airport_universe": f"""WITH {FLIGHTS}, a AS (SELECT flight_date, origin AS entity FROM flights UNION ALL SELECT flight_date, destination FROM flights)
SELECT entity, count(*) AS appearances, CAST(min(flight_date) AS STRING) AS first_day, CAST(max(flight_date) AS STRING) AS last_day FROM a GROUP BY 1""",
    "stacked_tables": f"""WITH {FLIGHTS} SELECT carrier, count(*) AS rows, count(*) FILTER (cancelled = 1) AS cancelled_events, NULL::BIGINT AS year, NULL::DOUBLE AS max_distance FROM flights GROUP BY 1
UNION ALL SELECT NULL, count(*), NULL, year(flight_date), max(distance) FROM flights GROUP BY year(flight_date)""",
    "score_alignment": f"""WITH {FLIGHTS} SELECT count(*) AS rows, count(*) FILTER (flight_number % 101 = 0) AS missing_row,
count(*) FILTER (flight_number % 101 <> 0 AND flight_number % 103 = 0) AS label_differs, count(*) FILTER (flight_number % 101 = 0) AS unusable_score,
round(sum(score) FILTER (flight_number % 101 <> 0), 6) AS score_sum FROM flights WHERE cancelled = 0 AND diverted = 0 AND arr_delay IS NOT NULL""",
    "csv_round_trip": f"""WITH {FLIGHTS} SELECT upper(trim(carrier_code)) AS carrier_code, count(*) AS rows, CAST(min(flight_date) AS STRING) AS first_day, count(*) FILTER (cancelled = 1) AS cancelled_events,
sum(arr_delay) AS delay_sum, (SELECT count(*) FILTER (dep_hhmm IS NULL) FROM flights) AS blank_clocks FROM flights GROUP BY 1""",
    "raw_flights": f"WITH {FLIGHTS} SELECT upper(trim(carrier_code)) AS reporting_airline_code, count(*) AS rows, CAST(min(flight_date) AS STRING) AS first_day, sum(dep_hhmm) AS sum_scheduled_departure_time_local_hhmm, "
        "sum(arr_delay) AS sum_arrival_delay_minutes, sum(cancelled) AS sum_cancelled_indicator, sum(distance) AS sum_distance_miles, sum(sched_elapsed) AS sum_scheduled_elapsed_minutes, " + ", ".join(
        (f"count({RAW_FROM_VIEW[c]})" if c in RAW_FROM_VIEW else "CAST(0 AS BIGINT)") + f" AS filled_{name}" for c, (name, _) in files.RAW_FLIGHT_COLUMNS.items() if c != "AIRLINE_CODE") + " FROM flights GROUP BY 1",
    "published_table": f"""WITH {FLIGHTS} SELECT CAST(arr_delay >= 120 AS INT) AS severe_120, count(*) AS rows, sum(arr_delay) AS delay_sum FROM flights
WHERE year(flight_date) = 2000 AND cancelled = 0 AND diverted = 0 AND arr_delay IS NOT NULL GROUP BY 1""",
    "zone_dimension": f"WITH {FLIGHTS} SELECT {_ZONE_CASE.format('origin')} AS from_zone, {_ZONE_CASE.format('destination')} AS to_zone, count(*) AS rows FROM flights GROUP BY 1, 2",
}
