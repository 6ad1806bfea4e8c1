"""Rotation links against a walk over each tail, rolling graphs against recounting every window."""

import random
from collections import Counter

import pytest

from skyledger.operators import rolling as G
from skyledger.operators import rotations as R

LEGS = ("leg_id int, tail string, origin string, destination string, departure_at long, planned_arrival_at long, arrived_at long, asked_at long, "
        "arr_delay double, cancelled boolean, diverted boolean")


def walk(rows, least, most):
    """The same by a plain loop over the legs of each tail."""
    out, tails = {}, {}
    for r in rows:
        leg = dict(zip(R.LEG_COLUMNS, r))
        tail = (leg["tail"] or "").strip().upper()
        at = leg["planned_arrival_at"] if leg["arrived_at"] is None else leg["arrived_at"]
        if not tail or at is None:
            out[leg["leg_id"]] = ("no_time" if tail else "no_tail", None, None, False, None, None, None, None)
        else:
            tails.setdefault(tail, []).append((at, leg["leg_id"], leg))
    for of_tail in tails.values():
        before, count, total, depth = None, 0, 0.0, 0
        for _, name, leg in sorted(of_tail, key=lambda x: x[:2]):
            turn = None if before is None or None in (before["arrived_at"], leg["departure_at"]) else leg["departure_at"] - before["arrived_at"]
            status = (
                "first_leg" if before is None else "prior_cancelled" if before["cancelled"] else "prior_diverted" if before["diverted"] else "prior_no_arrival" if before["arrived_at"] is None
                else "no_departure" if leg["departure_at"] is None else "airport_unknown" if None in (before["destination"], leg["origin"]) else "airport_mismatch" if before["destination"] != leg["origin"]
                else "turnaround_negative" if turn < 0 else "turnaround_short" if turn < least else "turnaround_long" if turn > most else "eligible")
            good = status == "eligible"
            severe = (leg["arr_delay"] or 0) >= 120
            late = max(leg["arr_delay"] or 0, 0)
            count, total, depth = (count + 1, total + late, (depth + 1) * severe) if good else (1, late, int(severe))
            known = good and leg["asked_at"] is not None and before["arrived_at"] <= leg["asked_at"]
            out[name] = (status, before["leg_id"] if good else None, turn if good else None, known, before["arr_delay"] if known else None, count, total, depth)
            before = leg
    return out


def draw_legs(seed, n=400):
    draw = random.Random(seed)

    def some(value, share=0.03):
        return None if draw.random() < share else value

    rows = []
    for i in range(n):
        start, took, late = draw.randrange(3000), draw.randrange(1, 20), draw.choice([-5.0, 0.0, 30.0, 130.0, 200.0])
        planned, gone = some(start + took), draw.random() < 0.05
        arrived = None if gone or planned is None else some(planned + int(late) // 10)
        rows.append((i, some(draw.choice([" hot", "HOT", "Hot ", "hot", "b", "c", ""])), some(draw.choice("xy")), some(draw.choice("xy")), some(start), planned, arrived, some(start - 3),
                     None if gone else some(late), some(gone), some(draw.random() < 0.05)))
    return rows


@pytest.mark.parametrize("seed,parts", [(1, 7), (2, 23), (3, 1)])
def test_links_equal_a_walk(spark, seed, parts):
    """One tail has most legs, so its chains run over many blocks."""
    rows = draw_legs(seed)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = R.rotation_links(spark.createDataFrame(rows, LEGS), 2, 60).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(found) == len(rows)
    got = {r["leg_id"]: (r["link_status"], r["prior_leg_id"], r["turnaround"], r["prior_known"], r["prior_delay"], r["chain_leg"], r["chain_delay"], r["cascade_depth"]) for r in found}
    assert got == walk(rows, 2, 60)
    assert {s for s, *_ in got.values()} >= {"eligible", "airport_mismatch", "turnaround_negative", "turnaround_short", "no_tail", "prior_cancelled"}
    for r in found:
        assert r["prior_known"] or (r["prior_delay"], r["prior_severe"], r["delay_growth"]) == (None, None, None)


@pytest.mark.parametrize("parts", [1, 40])
def test_a_chain_over_many_blocks(spark, parts):
    """Every link is eligible and every leg severe, so sums run through all blocks."""
    rows = [(i, "a", "x", "x", 100 * i, None, 100 * i + 50, 100 * i, 120.0, False, None) for i in range(300)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = R.rotation_links(spark.createDataFrame(rows, LEGS), 0, 60).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert sorted((r["leg_id"], r["chain_leg"], r["chain_delay"], r["cascade_depth"]) for r in found) == [(i, i + 1, 120.0 * (i + 1), i + 1) for i in range(300)]


def test_links_of_empty_and_repeated_legs(spark):
    none = spark.createDataFrame([], LEGS)
    assert R.rotation_links(none, 0, 1).count() == 0
    twice = [(1, "a", "x", "x", 0, None, 5, 0, 1.0, None, None)] * 2
    assert sorted(r["link_status"] for r in R.rotation_links(spark.createDataFrame(twice, LEGS), 0, 9).collect()) == ["first_leg", "turnaround_negative"]
    counts = R.link_coverage(R.rotation_links(spark.createDataFrame(twice, LEGS), 0, 9).selectExpr("*", "'c' AS carrier"), ["carrier"]).collect()
    assert [(r["legs"], r["candidate_links"], r["eligible_links"], r["first_leg"], r["known_share"]) for r in counts] == [(2, 1, 0, 1, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_graph_equals_recounting_every_day(spark, seed):
    """A hot edge, loops, rows without an end or day; asked on every day, before the first and long after the last flight too."""
    draw = random.Random(seed)
    rows = [(draw.choice(["h", "h", "a", "b", "c", None]), draw.choice(["h", "a", "a", "d", None]), draw.choice([draw.randrange(30), draw.randrange(30), None])) for _ in range(300)]
    asked = [(n, d) for n in ("h", "a", "b", "c", "d", "never") for d in range(-2, 60)] + [(None, 3), ("h", None), ("h", 5)]
    found = G.rolling_graph(spark.createDataFrame(rows, "origin string, destination string, day int"), spark.createDataFrame(asked, "node string, day int"), (3, 10)).collect()
    assert len(found) == 6 * 62 * 2
    for r in found:
        inside = [(o, d) for o, d, day in rows if None not in (o, d, day) and r["day"] - r["width"] <= day < r["day"]]
        out, into = Counter(d for o, d in inside if o == r["node"]), Counter(o for o, d in inside if d == r["node"])
        assert (r["out_degree"], r["in_degree"], r["out_flights"], r["in_flights"]) == (len(out), len(into), out.total(), into.total())
        for share, counts in ((r["out_hhi"], out), (r["in_hhi"], into)):
            assert share == (pytest.approx(sum(n * n for n in counts.values()) / counts.total() ** 2) if counts else None)
        assert r["has_history"] == bool(out or into)


def test_rolling_graph_of_empty_tables(spark):
    flights, targets = spark.createDataFrame([], "origin string, destination string, day int"), spark.createDataFrame([("a", 1)], "node string, day int")
    assert [(r["width"], r["out_degree"], r["out_hhi"], r["has_history"]) for r in G.rolling_graph(flights, targets).orderBy("width").collect()] == [(w, 0, None, False) for w in G.WIDTHS]
    assert G.rolling_graph(flights, targets.limit(0)).count() == 0
