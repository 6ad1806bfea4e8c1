"""Distributed isotonic fit against MLlib's and against the definition."""

import random

import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from skyledger.operators import isotonic as I

ROWS = "id int, score double, label int"


def mllib(fit, apply):
    """The same by MLlib, on distinct scores weighted by their rows."""
    grouped = fit.groupBy("score").agg(F.avg("label").alias("y"), F.count("*").cast("double").alias("w"))
    vector = VectorAssembler(inputCols=["score"], outputCol="f")
    model = IsotonicRegression(featuresCol="f", labelCol="y", weightCol="w", predictionCol="p").fit(vector.transform(grouped))
    return {r["id"]: r["p"] for r in model.transform(vector.transform(apply)).collect()}


@pytest.mark.parametrize("kind,parts", [("many", 40), ("coarse", 5), ("falling", 23)])
def test_fit_equals_mllib(spark, kind, parts):
    """Mostly distinct scores, few scores with many ties, and a label that falls with the score, so that one pool spans all blocks."""
    draw = random.Random(kind)
    scores = [draw.random() if kind != "coarse" else draw.randrange(20) / 20 for _ in range(6000)]
    chance = {"many": lambda s: s * s, "coarse": lambda s: s / 2, "falling": lambda s: 1 - s}[kind]
    fit = spark.createDataFrame([(i, s, int(draw.random() < chance(s))) for i, s in enumerate(scores)], ROWS)
    apply = spark.createDataFrame([(i, draw.uniform(-0.2, 1.2) if i % 3 else scores[i], 0) for i in range(2000)], ROWS)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        steps = I.fit_steps(fit, "score", "label")
        got = {r["id"]: r["p"] for r in I.apply_steps(steps, apply, "score", "p").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    want = mllib(fit, apply)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)
    rows = steps.orderBy("first").collect()
    assert all(a["value"] < b["value"] and a["last"] < b["first"] == a["next_first"] and a["next_value"] == b["value"] for a, b in zip(rows, rows[1:]))


def test_pools_of_parts_are_never_split():
    draw = random.Random(7)
    whole = pd.DataFrame([(0, float(i), float(i), n, draw.randrange(n + 1)) for i, n in enumerate(draw.randrange(1, 9) for _ in range(500))], columns=["_group", "first", "last", "n", "e"])
    cuts = sorted(draw.sample(range(1, 500), 20))
    parts = [I.pool(whole[a:b]) for a, b in zip([0, *cuts], [*cuts, 500])]
    pd.testing.assert_frame_equal(I.pool(pd.concat(parts[::-1])), I.pool(whole))


def test_odd_rows(spark):
    """Null and NaN scores, null labels, a signed zero, columns of the operator's own names; no rows to fit or to apply."""
    fit = spark.createDataFrame([(1, 0.0, 0), (2, -0.0, 1), (3, None, 1), (4, float("nan"), 1), (5, 2.0, 1), (6, 2.0, None)], ROWS)
    steps = I.fit_steps(fit, "score", "label")
    assert [tuple(r) for r in steps.orderBy("first").collect()] == [(0.0, 0.0, 0.5, 2.0, 1.0), (2.0, 2.0, 1.0, None, None)]
    names = "id int, score double, first string, _x string, _row string, _fitted string, value string, p string"
    apply = spark.createDataFrame([(i, s, *"abcdef") for i, s in enumerate([0.0, 1.0, 9.0, -1.0, None, float("nan"), 1.0])], names)
    out = I.apply_steps(steps, apply, "score", "p")
    assert {r["id"]: r["p"] for r in out.collect()} == {0: 0.5, 1: 0.75, 2: 1.0, 3: 0.5, 4: None, 5: None, 6: 0.75}
    assert all((r["first"], r["_x"], r["_row"], r["_fitted"], r["value"]) == tuple("abcde") for r in out.collect())
    none = I.fit_steps(fit.limit(0), "score", "label")
    assert none.count() == 0 and {r["p"] for r in I.apply_steps(none, apply, "score", "p").collect()} == {None}
    assert I.apply_steps(steps, apply.limit(0), "score", "p").count() == 0
