"""Clock and calendar column functions. Instants are handled as epoch seconds, so results do not
depend on the session time zone; every expression is row-local and stays inside code generation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400
ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ISO_LOCAL = "yyyy-MM-dd'T'HH:mm:ss"


def clock_minutes(raw: Column, accept_2400: bool = True) -> Column:
    """HHMM number to minutes after midnight; 2400 gives 1440, the next midnight; unusable values give null."""
    value = raw.try_cast("double")
    last = 2400 if accept_2400 else 2359
    usable = (value >= 0) & (value <= last) & (value == F.floor(value)) & (value % 100 <= 59)
    return F.when(usable, (F.floor(value / 100) * 60 + value % 100).cast("int"))


def clock_status(raw: Column, minutes: Column) -> Column:
    """``valid``, ``missing_time`` or ``invalid_time`` for a raw value and its :func:`clock_minutes`."""
    return F.when(minutes.isNotNull(), "valid").when(raw.isNull() | F.isnan(raw.try_cast("double")), "missing_time").otherwise("invalid_time")


def clock_parts(minutes: Column) -> dict[str, Column]:
    """Hour, minute and day rollover of minutes after midnight (1440 rolls over to hour 0)."""
    inside = minutes % 1440
    return {
        "hour": F.floor(inside / 60).cast("int"),
        "minute": (inside % 60).cast("int"),
        "rollover": F.when(minutes == 1440, 1).otherwise(0),
    }


def clock_category(raw: Column) -> Column:
    """Five classes of a raw HHMM value."""
    value = raw.try_cast("double")
    return (
        F.when(raw.isNull(), "missing")
        .when(value.isNull() | F.isnan(value) | (value != F.floor(value)), "non_integer")
        .when(value == 2400, "end_of_day_2400")
        .when((value >= 0) & (F.floor(value / 100) <= 23) & (value % 100 <= 59), "valid_hhmm")
        .otherwise("invalid_hhmm")
    )


def local_seconds(day: Column, minutes: Column) -> Column:
    """Wall-clock seconds since 1970 for a date and minutes after midnight."""
    return F.unix_date(day).cast("long") * DAY + minutes * 60


def utc_seconds(local: Column, zone: Column) -> Column:
    """Wall-clock seconds to UTC seconds. Check :func:`dst_class` first; ``zone`` must be a valid zone name."""
    return F.unix_timestamp(F.to_utc_timestamp(F.timestamp_seconds(local), zone))


def wall_seconds(utc: Column, zone: Column) -> Column:
    """UTC seconds to wall-clock seconds."""
    return F.unix_timestamp(F.from_utc_timestamp(F.timestamp_seconds(utc), zone))


def zones_in(df: DataFrame, *columns: str) -> tuple[str, ...]:
    """The zone names in the columns that the JVM knows. There are some hundreds of names in all, so the list is bounded."""
    names = F.explode(F.array(*[F.trim(F.col(c)) for c in columns]))
    found = {r[0] for r in df.select(names.alias("zone")).where(F.col("zone").isin(*known_zones(df.sparkSession))).distinct().collect()}
    return tuple(sorted(found))


def known_zones(spark: SparkSession) -> list[str]:
    """All region names of the JVM's time-zone data."""
    return sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())


#: Days of one row of the zone calendar.
CALENDAR_DAYS = 366


def zone_calendar(spark: SparkSession, zones: tuple[str, ...], first: str = "1987-01-01", last: str = "2030-12-31") -> DataFrame:
    """``(cal_zone, cal_period, cal_first, cal_changes)``: offset intervals, one row for each zone and period of ``CALENDAR_DAYS`` days.

    ``cal_first`` is the offset from the period's start on, ``cal_changes`` the days with a clock change (those of other
    than 24 hours) with the offset after each, by day. All known zones are some 26,000 rows, so a broadcast of this table is bounded.
    """
    low, high = ((dt.date.fromisoformat(d) - dt.date(1970, 1, 1)).days for d in (first, last))
    low, high = low // CALENDAR_DAYS * CALENDAR_DAYS, (high // CALENDAR_DAYS + 1) * CALENDAR_DAYS
    names = F.array(*[F.lit(z) for z in zones]) if zones else F.array().cast("array<string>")
    grid = spark.range(low, high).select(F.explode(names).alias("cal_zone"), F.col("id").alias("day"))
    ends = grid.select("*", *[utc_seconds((F.col("day") + k) * DAY, F.col("cal_zone")).alias(f"_m{k}") for k in (0, 1)])
    change = F.when(F.col("_m1") - F.col("_m0") != DAY, F.struct("day", ((F.col("day") + 1) * DAY - F.col("_m1")).alias("offset")))
    return ends.groupBy("cal_zone", F.floor(F.col("day") / CALENDAR_DAYS).alias("cal_period")).agg(
        F.min_by(F.col("day") * DAY - F.col("_m0"), "day").alias("cal_first"), F.sort_array(F.collect_list(change)).alias("cal_changes"))


def with_instant(df: DataFrame, local: str, zone: str, out: str, calendar: DataFrame) -> DataFrame:
    """Add ``{out}_state`` (``unique``, ``ambiguous``, ``nonexistent``) and ``{out}`` (UTC second, null unless unique).

    Nearly all days keep one offset: that after the last change before them, found among the few changes of the zone's
    period. Other rows are converted one by one with the offsets of the day before and the day after: an instant is right
    if its wall clock shows the local time again. Both right: the time occurs twice; neither: never. Clock changes of
    any size are covered. The steps are separate columns so that each is evaluated once.
    """
    first, early, late, back, later = (f"_{out}_{x}" for x in ("first", "early", "late", "back", "later"))
    columns = df.columns
    df = df.withColumn("_day", F.floor(F.col(local) / DAY))
    df = df.join(F.broadcast(calendar), (F.col(zone) == F.col("cal_zone")) & (F.floor(F.col("_day") / CALENDAR_DAYS) == F.col("cal_period")), "left")
    passed = F.filter("cal_changes", lambda c: c["day"] <= F.col("_day"))
    df = df.withColumn("_last", F.try_element_at(passed, F.lit(-1)))
    df = df.withColumn("cal_offset", F.when(F.col("_last").isNull(), F.col("cal_first")).when(F.col("_last.day") < F.col("_day"), F.col("_last.offset")))
    known = F.col("cal_offset").isNotNull()
    df = df.withColumn(first, F.when(~known, utc_seconds(F.col(local), F.col(zone))))
    for name, shift in ((early, -DAY), (late, DAY)):
        df = df.withColumn(name, F.col(local) - (wall_seconds(F.col(first) + shift, F.col(zone)) - (F.col(first) + shift)))
    df = df.withColumns({back: wall_seconds(F.col(early), F.col(zone)) == F.col(local), later: wall_seconds(F.col(late), F.col(zone)) == F.col(local)})
    state = (
        F.when(known, "unique").when(F.col(back) & F.col(later) & (F.col(early) != F.col(late)), "ambiguous")
        .when(F.col(back) | F.col(later), "unique").when(F.col(first).isNotNull(), "nonexistent")
    )
    instant = F.when(known, F.col(local) - F.col("cal_offset")).when(F.col(back), F.col(early)).otherwise(F.col(late))
    df = df.withColumn(f"{out}_state", state)
    return df.select(*columns, f"{out}_state", F.when(F.col(f"{out}_state") == "unique", instant).alias(out))


def iso_utc(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), ISO_UTC)


def iso_local(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), ISO_LOCAL)


def calendar_parts(day: Column) -> dict[str, Column]:
    """Year, month, quarter, day, weekday (Monday 0), ISO week and weekend flag."""
    weekday = F.weekday(day)
    return {
        "year": F.year(day),
        "month": F.month(day),
        "quarter": F.quarter(day),
        "day_of_month": F.dayofmonth(day),
        "day_of_week": weekday,
        "week_of_year": F.weekofyear(day),
        "is_weekend": F.when(weekday >= 5, 1).when(day.isNotNull(), 0),
    }


def month_number(seconds: Column) -> Column:
    """UTC months as year * 12 + month, so 'one month earlier' is minus one."""
    day = F.date_from_unix_date(F.floor(seconds / DAY).cast("int"))
    return (F.year(day) * 12 + F.month(day)).cast("long")


def hour_band(hour: Column) -> Column:
    """Five bands of a local departure hour."""
    return (
        F.when(hour < 6, "00-05").when(hour < 10, "06-09").when(hour < 14, "10-13")
        .when(hour < 18, "14-17").when(hour.isNotNull(), "18-23")
    )


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position on a circle."""
    angle = value * F.lit(2.0 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def circular_minutes(a: Column, b: Column) -> Column:
    """Shortest distance between two minutes of a day."""
    gap = F.abs(a - b)
    return F.least(gap, F.lit(1440) - gap)
