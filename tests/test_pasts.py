"""As-of matches and past-only outcomes: nothing of the future is ever seen."""

import random

import pytest

from skyledger.operators import asof as A
from skyledger.operators import outcomes as W


@pytest.mark.parametrize("seed", [1, 2])
def test_asof_is_the_latest_earlier_observation(spark, seed):
    """A station with most rows, ties in time, stations that are never observed, rows without station or time."""
    draw = random.Random(seed)
    stations = ["hot"] * 6 + ["a", "b", None]
    observed = [(draw.choice(stations), draw.randrange(400), i, draw.random()) for i in range(150)] + [("a", None, 900, 0.5)]
    rows = [(i, draw.choice([*stations, "never"]), draw.randrange(400) if draw.random() < 0.95 else None, "own") for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    found = A.asof_match(spark.createDataFrame(rows, "id int, station string, t int, reading_source string"), spark.createDataFrame(observed, "station string, t int, n int, reading double"), "station", "t", "n", ["reading"], 20).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    got = {r["id"]: (r["observed_at"], r["reading"], r["age"], r["match_reason"], r["reading_source"]) for r in found}
    assert len(found) == len(rows)
    for i, station, t, own in rows:
        if station is None or t is None:
            assert got[i] == (None, None, None, A.NO_KEY, own)
            continue
        best = max(((o, n, v) for s, o, n, v in observed if s == station and o is not None and o <= t), default=None)
        if best is None:
            assert got[i] == (None, None, None, A.NO_EARLIER, own)
        elif t - best[0] > 20:
            assert got[i] == (None, None, t - best[0], A.TOO_OLD, own)
        else:
            assert got[i] == (best[0], best[2], t - best[0], A.MATCHED, own)


def test_asof_of_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a", 5)], "id int, station string, t int")
    none = spark.createDataFrame([], "station string, t int, n int, reading double")
    assert [r["match_reason"] for r in A.asof_match(rows, none, "station", "t", "n", ["reading"], 9).collect()] == [A.NO_EARLIER]
    assert A.asof_match(rows.limit(0), none, "station", "t", "n", ["reading"], 9).count() == 0


def outcome(day, known, severe=0, delay=0):
    return ("carrier", "X", day, known, 1, 1, severe, 0, delay)


SCHEMA = "level string, entity string, day int, known_day int, flights int, completed int, severe int, cancelled int, delay_minutes int"


def test_a_late_outcome_never_leaks(spark):
    """The flight of day 10 lands on day 12: it enters on day 13, though days 11 and 12 look back over day 10."""
    rows = spark.createDataFrame([outcome(10, 12, 1, 2900), outcome(11, 11), outcome(12, 12), outcome(13, 13, 1), outcome(20, None)], SCHEMA)
    got = {r["day"]: (r["flights_7d"], r["severe_rate_7d"], r["has_history_7d"]) for r in W.outcome_windows(rows, rows).collect()}
    assert got == {10: (0, None, False), 11: (0, None, False), 12: (1, 0.0, True), 13: (3, pytest.approx(1 / 3), True), 20: (1, 1.0, True)}


def test_windows_are_sums_over_days(spark):
    draw = random.Random(4)
    data = [(draw.choice(["carrier", "route"]), draw.choice("XY"), d := draw.randrange(200), d + draw.choice([0, 0, 1, 3]), 1, draw.randint(0, 1), 0, draw.randint(0, 1), draw.randint(-9, 90)) for _ in range(300)]
    rows = spark.createDataFrame(data, SCHEMA)
    for r in W.outcome_windows(rows, rows.select("level", "entity", "day"), (7, 90)).collect():
        for w in (7, 90):
            inside = [x for x in data if x[:2] == (r["level"], r["entity"]) and r["day"] - w <= x[3] < r["day"]]
            assert r[f"flights_{w}d"] == len(inside) and r[f"completed_{w}d"] == sum(x[5] for x in inside)
            done = sum(x[5] for x in inside)
            assert r[f"mean_delay_{w}d"] == (pytest.approx(sum(x[8] for x in inside) / done) if done else None)


def test_levels_leave_out_rows_without_their_columns(spark):
    rows = spark.createDataFrame([("C1", "A", None), ("C2", "A", "B")], "carrier string, origin string, destination string")
    got = sorted((r["level"], r["entity"]) for r in W.by_level(rows, {"global": [], "carrier": ["carrier"], "route": ["origin", "destination"]}).collect())
    assert got == [("carrier", "C1"), ("carrier", "C2"), ("global", "all"), ("global", "all"), ("route", "A>B")]
