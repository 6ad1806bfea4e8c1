"""Schedule reconstruction: local clocks to UTC, arrival days, prediction and outcome times, clock checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import clocks as C
from skyledger.functions.values import normalise_code, tolerant_number


def known_zone(zone: Column, zones: tuple[str, ...]) -> Column:
    """The zone when it is one of ``zones``, else null. A name that the JVM does not know would stop the job."""
    text = F.trim(zone)
    return F.when(text.isin(*zones), text)


def local_to_utc(df: DataFrame, day: str, raw: str, zone: str, out: str, zones: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``{out}_local`` and ``{out}_utc`` (seconds) and ``{out}_input`` (why a row has no instant).

    ``zones`` are the zone names to convert, as a dimension lists them; left out, they are read from the column, which costs a
    pass over the rows. Every IANA zone is accepted.
    """
    zones = C.zones_in(df, zone) if zones is None else zones
    df = df.withColumns({f"_{out}_min": C.clock_minutes(F.col(raw)), f"_{out}_zone": known_zone(F.col(zone), zones)})
    df = df.withColumn(f"{out}_local", C.local_seconds(F.col(day), F.col(f"_{out}_min")))
    df = C.with_instant(df, f"{out}_local", f"_{out}_zone", f"{out}_utc", C.zone_calendar(df.sparkSession, zones))
    status = (
        F.when(F.col(f"_{out}_min").isNull(), C.clock_status(F.col(raw), F.col(f"_{out}_min")))
        .when(F.col(day).isNull(), "invalid_date")
        .when(F.col(f"_{out}_zone").isNull(), "invalid_timezone")
        .when(F.col(f"{out}_utc_state") == "nonexistent", "nonexistent_local_time")
        .when(F.col(f"{out}_utc_state") == "ambiguous", "ambiguous_local_time")
        .otherwise("valid")
    )
    return df.withColumn(f"{out}_input", status).drop(f"_{out}_min", f"_{out}_zone", f"{out}_utc_state")


def reconcile_departures(df: DataFrame, lead_seconds: int = 7200, zones: tuple[str, ...] | None = None) -> DataFrame:
    """Departure status, UTC second, day offset and prediction second (departure minus the lead)."""
    work = local_to_utc(df, "flight_date", "dep_hhmm", "origin_zone", "departure", zones)
    raw = F.col("departure_input")
    status = (
        F.when(raw == "valid", "reconciled")
        .when(raw.isin("missing_time", "invalid_time"), "invalid_departure_time")
        .when(raw == "ambiguous_local_time", "ambiguous_departure_local_time")
        .when(raw == "nonexistent_local_time", "nonexistent_departure_local_time")
        .otherwise(raw)
    )
    return work.select(
        *df.columns, status.alias("departure_status"), "departure_utc",
        F.when(raw == "valid", (F.floor(F.col("departure_local") / C.DAY) - F.unix_date("flight_date")).cast("int")).alias("departure_day_offset"),
        (F.col("departure_utc") - lead_seconds).alias("prediction_utc"),
    )


def reconcile_arrivals(df: DataFrame, max_day_offset: int = 2, tolerance_minutes: float = 30.0, zones: tuple[str, ...] | None = None) -> DataFrame:
    """Choose the arrival day whose UTC duration is closest to the scheduled one.

    Needs ``departure_utc``, ``flight_date``, ``arr_hhmm``, ``destination_zone`` and ``sched_elapsed``. The candidate
    days are an array inside the row, so no shuffle is needed; ties keep the earlier day.
    """
    if max_day_offset < 0 or tolerance_minutes < 0:
        raise ValueError("day offset and tolerance must not be negative")
    days = range(max_day_offset + 1)
    zones = C.zones_in(df, "destination_zone") if zones is None else zones
    work = df.withColumns({"_min": C.clock_minutes(F.col("arr_hhmm")), "_zone": known_zone(F.col("destination_zone"), zones)})
    base = C.local_seconds(F.col("flight_date"), F.col("_min"))
    work = work.withColumns({f"_local{k}": base + k * C.DAY for k in days})
    calendar = C.zone_calendar(df.sparkSession, zones)
    for k in days:
        work = C.with_instant(work, f"_local{k}", "_zone", f"_utc{k}", calendar)
    work = work.withColumns({f"_dur{k}": (F.col(f"_utc{k}") - F.col("departure_utc")) / 60.0 for k in days})
    candidates = F.array(*[
        F.when(F.col(f"_dur{k}") >= 0, F.struct(
            F.abs(F.col(f"_dur{k}") - F.col("sched_elapsed")).alias("difference"),
            (F.floor(F.col("_min") / 1440).cast("int") + k).alias("day_offset"),
            F.col(f"_utc{k}").alias("utc"), F.col(f"_dur{k}").alias("duration"),
        )) for k in days
    ])
    ready = F.col("sched_elapsed").isNotNull() & (F.col("_utc0_state") == "unique")
    work = work.withColumn("_best", F.when(ready, F.array_min(F.array_compact(candidates))))
    status = (
        F.when(F.col("departure_utc").isNull(), "missing_or_invalid_departure_utc")
        .when(F.col("_min").isNull(), F.when(F.col("arr_hhmm").isNull(), "missing_arrival_time").otherwise("invalid_arrival_time"))
        .when(F.col("flight_date").isNull(), "invalid_flight_date")
        .when(F.col("_zone").isNull(), "invalid_destination_timezone")
        .when(F.col("sched_elapsed").isNull(), "missing_scheduled_elapsed_time")
        .when(F.col("_utc0_state") == "ambiguous", "ambiguous_arrival_local_time")
        .when(F.col("_utc0_state") == "nonexistent", "nonexistent_arrival_local_time")
        .when(F.col("_best").isNull(), "no_valid_arrival_candidate")
        .when(F.col("_best.difference") <= tolerance_minutes, "reconciled")
        .otherwise("duration_difference_exceeds_tolerance")
    )
    return work.select(
        *df.columns,
        status.alias("arrival_status"),
        F.col("_best.utc").alias("arrival_utc"),
        F.col("_best.day_offset").alias("arrival_day_offset"),
        F.col("_best.duration").alias("duration_utc_minutes"),
        F.col("_best.difference").alias("duration_difference_minutes"),
    )


def normalise_schedule(df: DataFrame, tolerance_minutes: float = 60.0, zones: tuple[str, ...] | None = None) -> DataFrame:
    """Departure and arrival reconciliation in one row-local pass, over all zones of either column or the given ones."""
    zones = C.zones_in(df, "origin_zone", "destination_zone") if zones is None else zones
    return reconcile_arrivals(reconcile_departures(df, zones=zones), tolerance_minutes=tolerance_minutes, zones=zones)


def prediction_times(df: DataFrame, lead_seconds: int = 7200, zones: tuple[str, ...] | None = None) -> DataFrame:
    """Prediction instants with explicit daylight-saving flags and conversion status."""
    work = local_to_utc(df, "flight_date", "dep_hhmm", "origin_zone", "departure", zones)
    raw = F.col("departure_input")
    status = (
        F.when(F.col("flight_date").isNull(), "invalid_flight_date")
        .when(raw.isin("missing_time", "invalid_time"), "invalid_clock_time")
        .when(raw == "invalid_timezone", "unmapped_origin_timezone")
        .when(raw == "ambiguous_local_time", "dst_ambiguous")
        .when(raw == "nonexistent_local_time", "dst_nonexistent")
        .otherwise("ok")
    )
    return work.select(
        *df.columns, "departure_local", "departure_utc",
        (F.col("departure_utc") - lead_seconds).alias("prediction_utc"),
        F.coalesce(F.col("dep_hhmm") == 2400, F.lit(False)).alias("clock_value_2400"),
        (raw == "ambiguous_local_time").alias("dst_ambiguous"),
        (raw == "nonexistent_local_time").alias("dst_nonexistent"),
        status.alias("conversion_status"),
    )


def outcome_times(df: DataFrame, locked_from: str) -> DataFrame:
    """Candidate gate arrival instants from delay and flown minutes, with six statuses.

    The timing fields must satisfy arrival delay = departure delay + flown - scheduled, within one minute.
    Rows dated ``locked_from`` or later keep only the status ``final_test_locked``.
    """
    numbers = {f"_{c}": tolerant_number(F.col(c)) for c in ("arr_delay", "dep_delay", "elapsed", "sched_elapsed")}
    work = df.withColumns(numbers)
    arr, dep, flown, planned = (F.col(c) for c in numbers)
    completed = (F.col("cancelled") == 0) & (F.col("diverted") == 0)
    finite = arr.isNotNull() & dep.isNotNull() & flown.isNotNull() & planned.isNotNull()
    plausible = finite & (flown > 0) & (flown <= 1440) & (planned > 0)
    consistent = F.abs(arr - (dep + flown - planned)) <= 1
    status = (
        F.when(F.col("flight_date") >= F.lit(locked_from).cast("date"), "final_test_locked")
        .when(completed & plausible & F.col("departure_utc").isNotNull() & ~consistent, "inconsistent_timing_fields")
        .when(completed & plausible & (F.col("departure_utc").isNull() | (F.col("conversion_status") != "ok")), "unresolved_scheduled_timestamp")
        .when(completed & ~F.coalesce(plausible, F.lit(False)), "invalid_or_missing_timing")
        .when((F.col("diverted") == 1) & (F.col("cancelled") != 1), "diverted_excluded")
        .when(F.col("cancelled") == 1, "cancelled_no_arrival")
        .otherwise("usable_candidate")
    )
    candidate = F.col("departure_utc") + ((dep + flown) * 60).cast("long")
    work = work.withColumn("outcome_status", status)
    usable = F.col("outcome_status") == "usable_candidate"
    return work.select(*df.columns, "outcome_status", F.when(usable, candidate).alias("candidate_arrival_utc"))


def arrival_clock_check(df: DataFrame, tolerance_minutes: int = 1, zones: tuple[str, ...] | None = None) -> DataFrame:
    """Compare the candidate arrival, shown on the destination clock, with the reported clock."""
    work = df.withColumns({
        "_zone": known_zone(F.col("destination_zone"), C.zones_in(df, "destination_zone") if zones is None else zones),
        "_reported": C.clock_minutes(F.col("reported_arr_hhmm")) % 1440,
    })
    local = C.wall_seconds(F.col("candidate_arrival_utc"), F.col("_zone"))
    work = work.withColumn("_gap", C.circular_minutes(F.floor(F.pmod(local, F.lit(C.DAY)) / 60), F.col("_reported")))
    eligible = F.col("outcome_status") == "usable_candidate"
    status = (
        F.when(~eligible, F.col("outcome_status"))
        .when(F.col("_gap") <= tolerance_minutes, "validated_event_time")
        .when(F.col("_reported").isNull(), "invalid_reported_arrival_clock")
        .when(F.col("_zone").isNull(), "unmapped_destination_timezone")
        .otherwise("arrival_clock_mismatch")
    )
    work = work.withColumn("clock_status", status)
    valid = F.col("clock_status") == "validated_event_time"
    return work.select(*df.columns, "clock_status", F.when(valid, F.col("candidate_arrival_utc")).alias("validated_arrival_utc"))


def clock_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per clock column and category; columns are stacked, so the table is read once."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), C.clock_category(F.col(c)).alias("category")) for c in columns
    ]))
    return df.select(pairs.alias("p")).groupBy("p.column_name", "p.category").agg(F.count("*").alias("rows"))


def schedule_consistency(df: DataFrame) -> DataFrame:
    """Clock difference (next day when negative) against the scheduled minutes, ignoring zones: one audit row.

    Differences are whole minutes within two days, so the exact percentiles keep a small bounded table.
    """
    work = df.withColumns({"_d": C.clock_minutes(F.col("dep_hhmm")), "_a": C.clock_minutes(F.col("arr_hhmm"))})
    span = F.col("_a") - F.col("_d") + F.when(F.col("_a") < F.col("_d"), 1440).otherwise(0)
    work = work.withColumn("_gap", F.abs(span - F.col("sched_elapsed")))
    return work.agg(
        F.count("*").alias("rows"),
        F.count("_gap").alias("comparable_rows"),
        F.sum((F.col("_gap").isNotNull() & (F.col("_a") < F.col("_d"))).cast("long")).alias("overnight_rows"),
        F.sum((F.col("_gap") == 0).cast("long")).alias("exact_rows"),
        F.percentile("_gap", F.array(F.lit(0.5), F.lit(0.95))).alias("q"),
        F.max("_gap").alias("max_abs_difference"),
    ).select("rows", "comparable_rows", "overnight_rows", "exact_rows", F.col("q")[0].alias("median_abs_difference"),
             F.col("q")[1].alias("p95_abs_difference"), "max_abs_difference")


DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd")


def parse_dates(df: DataFrame, column: str, formats=DATE_FORMATS) -> DataFrame:
    """First matching date format per value: ``parsed_date`` and ``date_format``."""
    attempts = [F.try_to_timestamp(F.col(column), F.lit(f)) for f in formats]
    label = F.lit(None).cast("string")
    for attempt, name in reversed(list(zip(attempts, formats))):
        label = F.when(attempt.isNotNull(), name).otherwise(label)
    label = F.when(F.col(column).isNull(), "missing").otherwise(F.coalesce(label, F.lit("unparsed")))
    return df.select("*", F.coalesce(*attempts).cast("date").alias("parsed_date"), label.alias("date_format"))


def status_counts(df: DataFrame, status: str, *entities: str) -> DataFrame:
    """Rows per status, optionally per entity."""
    return df.groupBy(*entities, status).agg(F.count("*").alias("rows"))


def standardise(df: DataFrame, names: dict[str, str], codes: list[str]) -> DataFrame:
    """Canonical names, then trimmed upper-case codes."""
    df = df.withColumnsRenamed(names)
    return df.withColumns({c: normalise_code(F.col(c)) for c in codes})
