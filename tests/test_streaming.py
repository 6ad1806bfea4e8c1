"""The stream's table does not depend on how the input falls into batches."""

import time

import pytest

from skyledger.streaming import airport as A
from skyledger.streaming import ingest as I

HOUR = 3600
SCHEMA = "airport string, destination string, dep_seconds long, elapsed double"


def write_files(spark, folder, files):
    for number, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/f{number}.parquet")
        time.sleep(1.1)  # files are read in the order of their modification times


def table(spark, folder, out, per_trigger):
    stream = I.file_stream(spark, f"{folder}/f*.parquet", per_trigger)
    I.run_to_table(A.windowed_counts(A.activity(stream)), f"{out}/table", f"{out}/progress", "update")
    return {(r["bin_start"], r["airport"]): (r["departures"], r["arrivals"], r["distinct_destinations"]) for r in A.bin_table(A.latest_counts(spark.read.parquet(f"{out}/table"))).collect()}


def test_same_table_for_any_batch_size(spark, tmp_path):
    moves = [(f"A{i % 3}", f"B{i % 5}", i * HOUR, 1200.0) for i in range(24)]
    write_files(spark, tmp_path / "in", [moves[i:i + 6] for i in range(0, 24, 6)])
    found = [table(spark, tmp_path / "in", tmp_path / f"out{n}", n) for n in (1, 2, None)]
    assert found[0] == found[1] == found[2]
    assert sum(v[0] for v in found[0].values()) == 24 and sum(v[1] for v in found[0].values()) == 24


def test_only_rows_later_than_the_delay_are_dropped(spark, tmp_path):
    on_time = [("A", "B", 100 * HOUR, 60.0)], [("A", "B", 99 * HOUR + 1, 60.0)]
    late = [("A", "B", 60 * HOUR, 60.0)]
    write_files(spark, tmp_path / "in", [on_time[0], [("Z", "Z", 100 * HOUR, None)], on_time[1] + late])
    rows = table(spark, tmp_path / "in", tmp_path / "out", 1)
    assert sum(v[0] for (_, airport), v in rows.items() if airport == "A") == 2
    assert (60 * HOUR, "A") not in rows


@pytest.mark.parametrize("elapsed", [None, 0.0, 1441.0])
def test_unplaceable_arrivals_leave_the_departure(spark, elapsed):
    rows = A.activity(spark.createDataFrame([("A", "B", 10, elapsed)], SCHEMA)).collect()
    assert [r["role"] for r in rows] == ["departure"] and rows[0]["airport"] == "A"
    assert rows[0]["event_time"] is not None
