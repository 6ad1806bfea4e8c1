"""What the larger runs asked for: linear trailing counts, one reading of the tables, fits that repeat exactly."""

import random

from pyspark.sql import functions as F

from skyledger.operators import attach as AT
from skyledger.operators import bins as B
from skyledger.operators import explain as E
from skyledger.operators import learning as T
from skyledger.operators.ordering import quantile_bins


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trailing_counts_are_running_sums(spark):
    draw = random.Random(3)
    facts = [(draw.choice("AB"), draw.randrange(0, 400)) for _ in range(300)] + [("A", 0), ("A", 50), ("A", 100), (None, 70), ("A", None)]
    asked = [(draw.choice("ABC"), draw.randrange(-60, 500)) for _ in range(200)] + [("A", 50), ("A", 50), ("A", 100), ("A", 150), (None, 90)]
    out = B.past_counts(spark.createDataFrame(facts, "key string, second long"), spark.createDataFrame(asked, "key string, second long"), ["key"], 50)
    expected = {(k, t): (asked.count((k, t)), sum(1 for fk, s in facts if fk == k and s is not None and t - 50 <= s < t)) for k, t in asked}
    assert {(r["key"], r["second"]): (r["rows"], r["prior"]) for r in out.collect()} == expected
    assert out.count() == len(expected)
    assert "RangeFrame, -50" not in plan(out) and "RangeFrame, unboundedpreceding" in plan(out)  # a moving frame is summed anew for every row


def test_numeric_effect_equals_ranked_rows(spark):
    draw = random.Random(5)
    rows = [(f"f{i:03}", f, float(draw.randrange(7)), draw.choice([0.5, 1.5, -2.0]) if f == "mixed" else 0.0) for i in range(203) for f in ("mixed", "plain")]
    rows = [(i, f, v, v * 2 if f == "plain" else c) for i, f, v, c in rows] + [("x", "mixed", None, 9.0), ("y", "one", 4.0, 1.0)]
    long = spark.createDataFrame(rows, "flight_id string, feature string, value double, contribution double")
    binned = quantile_bins(long.where("value is not null"), ["feature"], ["value", "flight_id"], 5)
    expected = binned.groupBy("feature", "bin").agg(F.min("value"), F.max("value"), F.count("*"), F.avg("contribution")).collect()
    found = E.numeric_effect(long).collect()
    assert {tuple(r)[:5] + (round(r[5], 9),) for r in found} == {tuple(r)[:5] + (round(r[5], 9),) for r in expected}


def test_pairing_by_id_equals_the_join(spark):
    whole = spark.createDataFrame([("a", 1, 2), ("b", 3, 4), ("b", 5, 6), ("c", 7, 8), (None, 9, 10), ("b", 3, 4)], "flight_id string, x int, y int")
    left = whole.where("x <> 5")
    expected = left.select("flight_id", "x").join(whole.select("flight_id", "y"), "flight_id")
    assert sorted(map(tuple, AT.pair_rows(left, whole, ["x"], ["y"]).collect())) == sorted(map(tuple, expected.collect()))
    single = whole.where("flight_id <> 'b'")
    out = AT.pair_rows(single, single, ["x"], ["y"])
    assert sorted(map(tuple, out.collect())) == [("a", 1, 2), ("c", 7, 8)] and "Join" not in plan(out)


def test_refits_repeat_in_any_row_order(spark):
    draw = random.Random(9)
    rows = [(f"f{i}", float(draw.choice([1, 2, 3])), None if i % 40 == 0 else draw.uniform(0, 9), draw.choice("XYZ"), draw.choice("PQRSTU"), draw.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "flight_id string, a double, b double, carrier_id string, route string, u double").withColumn("severe_120", (F.col("u") < F.col("b") / 18).cast("int")).fillna(0, ["severe_120"])
    features = T.Features(("a", "b"), ("carrier_id",), ("route",))
    fit, stop = df.where("flight_id not like '%7'"), df.where("flight_id like '%7'")
    plainly, again = (T.prepare_trees(f, stop, features, "severe_120") for f in (fit, fit.repartition(5)))
    known = sorted(r["b"] for r in fit.where("b is not null").collect())
    assert plainly.medians["b"] == again.medians["b"] == known[(len(known) + 1) // 2 - 1]
    assert plainly.levels == 3 and plainly.stages[0].labels == again.stages[0].labels
    small = T.TreeSettings(iterations=2, depth=2, step=0.2, min_rows=5)
    scores = [T.score_trees(T.fit_prepared(p, small), stop).select("flight_id", F.round("score", 9)).collect() for p in (plainly, plainly)]
    assert sorted(scores[0]) == sorted(scores[1])
    shared = T.score_vectors(T.fit_prepared(plainly, small), T.tree_vectors(plainly, stop, "flight_id")).select("flight_id", F.round("score", 9)).collect()
    assert sorted(shared) == sorted(scores[0])
