"""Clock, daylight-saving and arrival-day cases with hand values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyledger.functions import clocks as C
from skyledger.operators import schedule as S

NY, CHI, LA = "America/New_York", "America/Chicago", "America/Los_Angeles"


def utc(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp())


@pytest.mark.parametrize("raw, minutes", [(5.0, 5), (45.0, 45), (930.0, 570), (2359.0, 1439), (2400.0, 1440), (1060.0, None), (2401.0, None), (-5.0, None), (9.5, None), (None, None)])
def test_clock_minutes(spark, raw, minutes):
    df = spark.createDataFrame([(raw,)], "raw double")
    assert df.select(C.clock_minutes(F.col("raw"))).first()[0] == minutes


def test_clock_without_2400(spark):
    df = spark.createDataFrame([(2400.0,), (2359.0,)], "raw double")
    assert [r[0] for r in df.select(C.clock_minutes(F.col("raw"), accept_2400=False)).collect()] == [None, 1439]


CASES = [
    # id, date, from zone, to zone, departure, arrival, minutes, departure status, departure utc, arrival status, arrival offset
    (1, "2023-06-01", NY, NY, 900.0, 1030.0, 90.0, "reconciled", utc(2023, 6, 1, 13, 0), "reconciled", 0),
    (2, "2023-06-01", NY, LA, 900.0, 1200.0, 360.0, "reconciled", utc(2023, 6, 1, 13, 0), "reconciled", 0),
    (3, "2023-06-01", LA, NY, 2300.0, 730.0, 330.0, "reconciled", utc(2023, 6, 2, 6, 0), "reconciled", 1),
    (4, "2023-06-01", NY, CHI, 2400.0, 100.0, 120.0, "reconciled", utc(2023, 6, 2, 4, 0), "reconciled", 1),
    (5, "2023-03-12", NY, NY, 230.0, 400.0, 90.0, "nonexistent_departure_local_time", None, "missing_or_invalid_departure_utc", None),
    (6, "2023-11-05", NY, NY, 130.0, 400.0, 90.0, "ambiguous_departure_local_time", None, "missing_or_invalid_departure_utc", None),
    (7, "2023-11-05", CHI, NY, 2.0, 130.0, 60.0, "reconciled", utc(2023, 11, 5, 5, 2), "ambiguous_arrival_local_time", None),
    (8, "2023-06-01", NY, NY, 900.0, 1300.0, 90.0, "reconciled", utc(2023, 6, 1, 13, 0), "duration_difference_exceeds_tolerance", 0),
    (9, "2023-06-01", NY, NY, None, 1300.0, 90.0, "invalid_departure_time", None, "missing_or_invalid_departure_utc", None),
    (10, "2023-06-01", NY, NY, 900.0, None, 90.0, "reconciled", utc(2023, 6, 1, 13, 0), "missing_arrival_time", None),
    (11, "2023-06-01", NY, "Mars/Base", 900.0, 1000.0, 90.0, "reconciled", utc(2023, 6, 1, 13, 0), "invalid_destination_timezone", None),
    (12, "2023-06-01", NY, NY, 900.0, 1030.0, None, "reconciled", utc(2023, 6, 1, 13, 0), "missing_scheduled_elapsed_time", None),
    (13, "2023-06-01", NY, NY, 900.0, 1060.0, 90.0, "reconciled", utc(2023, 6, 1, 13, 0), "invalid_arrival_time", None),
    (14, "2023-06-01", "", NY, 900.0, 1000.0, 90.0, "invalid_timezone", None, "missing_or_invalid_departure_utc", None),
]


def test_schedule_cases(spark):
    df = spark.createDataFrame([c[:7] for c in CASES], "id int, d string, origin_zone string, destination_zone string, dep_hhmm double, arr_hhmm double, sched_elapsed double")
    out = S.reconcile_arrivals(S.reconcile_departures(df.withColumn("flight_date", F.to_date("d"))), tolerance_minutes=30.0).collect()
    got = {r["id"]: (r["departure_status"], r["departure_utc"], r["arrival_status"], r["arrival_day_offset"]) for r in out}
    assert got == {c[0]: c[7:] for c in CASES}


def test_tolerance_is_inclusive(spark):
    df = spark.createDataFrame([("2023-06-01", NY, NY, 900.0, 1100.0, 90.0)], "d string, origin_zone string, destination_zone string, dep_hhmm double, arr_hhmm double, sched_elapsed double")
    ready = S.reconcile_departures(df.withColumn("flight_date", F.to_date("d")))
    assert S.reconcile_arrivals(ready, tolerance_minutes=30.0).first()["arrival_status"] == "reconciled"
    assert S.reconcile_arrivals(ready, tolerance_minutes=29.0).first()["arrival_status"] == "duration_difference_exceeds_tolerance"


def test_outcome_and_clock(spark):
    df = spark.createDataFrame([(1, 1400.0), (2, 1401.0), (3, 1402.0), (4, None)], "id int, reported_arr_hhmm double").select(
        "*", F.lit("usable_candidate").alias("outcome_status"), F.lit(utc(2023, 1, 5, 19, 0)).alias("candidate_arrival_utc"), F.lit(NY).alias("destination_zone"))
    got = {r["id"]: r["clock_status"] for r in S.arrival_clock_check(df).collect()}
    assert got == {1: "validated_event_time", 2: "validated_event_time", 3: "arrival_clock_mismatch", 4: "invalid_reported_arrival_clock"}


ZONE_CASES = [
    # zone, date, clock, status, UTC
    ("Pacific/Honolulu", "2023-06-01", 900.0, "valid", utc(2023, 6, 1, 19, 0)),
    ("America/Puerto_Rico", "2023-06-01", 900.0, "valid", utc(2023, 6, 1, 13, 0)),
    ("America/Boise", "2023-03-12", 230.0, "nonexistent_local_time", None),
    ("Australia/Sydney", "2023-04-02", 230.0, "ambiguous_local_time", None),
    ("Australia/Sydney", "2023-04-02", 330.0, "valid", utc(2023, 4, 1, 17, 30)),
    ("Australia/Lord_Howe", "2023-04-02", 145.0, "ambiguous_local_time", None),
    ("Australia/Lord_Howe", "2023-04-02", 115.0, "valid", utc(2023, 4, 1, 14, 15)),
    ("Australia/Lord_Howe", "2023-10-01", 215.0, "nonexistent_local_time", None),
    ("Asia/Kathmandu", "2023-06-01", 0.0, "valid", utc(2023, 5, 31, 18, 15)),
    (" Asia/Tokyo ", "2023-06-01", 2400.0, "valid", utc(2023, 6, 1, 15, 0)),
    ("Mars/Base", "2023-06-01", 900.0, "invalid_timezone", None),
    (None, "2023-06-01", 900.0, "invalid_timezone", None),
]


def test_any_zone_name_is_accepted(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(ZONE_CASES)], "id int, zone string, d string, hhmm double").withColumn("day", F.to_date("d"))
    out = {r["id"]: (r["t_input"], r["t_utc"]) for r in S.local_to_utc(df, "day", "hhmm", "zone", "t").collect()}
    assert out == {i: c[3:] for i, c in enumerate(ZONE_CASES)}
