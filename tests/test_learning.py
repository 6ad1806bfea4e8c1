"""Model queries do all their work: full fits, all draws, and trees that equal MLlib's."""

import inspect
import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import boosting as B
from skyledger.operators import learning as T
from skyledger.plans import learning as Q


@pytest.fixture(scope="module")
def flights(spark):
    """Rows of a model frame: the label falls with the hour and the carrier."""
    draw = random.Random(5)
    day = 86400
    names = ["flight_id", "role", "split", "prediction_utc", "day", "eligible_severe", "severe_120", "cancelled_source", *Q.NUMERIC, *Q.LINEAR.categorical, "route"]
    rows = []
    for i in range(1200):
        split = ("development", "development", "validation")[i % 3]
        role = "validation" if split == "validation" else "early_stop" if i % 12 == 1 else "fit"
        start = 946684800 if split == "validation" else 757382400  # 2000 and 1994
        second = start + i % 360 * day + i
        numbers = [None if i % 50 == 0 else float(draw.randint(0, 20)) for _ in Q.NUMERIC]
        levels = [draw.choice("ABCD") for _ in Q.LINEAR.categorical]
        event = int(draw.random() < 0.15 + 0.02 * (numbers[0] or 0) + 0.2 * (levels[0] == "A"))
        rows.append((f"f{i}", role, split, second, second // day, True, event, int(draw.random() < 0.3), *numbers, *levels, "-".join(levels[:2])))
    kinds = ["string", "string", "string", "long", "long", "boolean", "int", "int", *["double"] * len(Q.NUMERIC), *["string"] * len(Q.LINEAR.categorical), "string"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return df.cache()


def test_logistic_scores_fit_until_the_end(spark, flights, monkeypatch):
    asked, plain = [], T.fit_logistic

    def spy(*args, **kwargs):
        bound = inspect.signature(plain).bind(*args, **kwargs)
        bound.apply_defaults()
        asked.append(bound.arguments["iterations"])
        return plain(*args, **kwargs)

    monkeypatch.setattr(Q, "model_frame", lambda *_: flights)
    monkeypatch.setattr(T, "fit_logistic", spy)
    assert Q.logistic_scores(spark, "").count() == 4
    assert len(asked) == 4 and min(asked) >= 150


def test_trees_equal_those_of_mllib(spark):
    """More fit rows than thresholds are sampled from, and both kinds of features."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    draw = random.Random(3)
    rows = []
    for i in range(14000):
        a, b, c, k = draw.gauss(0, 1), float(draw.randint(0, 60)), draw.choice([None, 0.0, 1.0, 2.5]), draw.choice("PQRSTUVW")
        rows.append((i, a, b, c, k, f"{k}{i % 5}", int(draw.random() < 0.2 + 0.2 * (a > 0.5) + 0.2 * (k in "PQ") * (b > 30)), i % 7 == 3))
    df = spark.createDataFrame(rows, "flight_id int, a double, b double, c double, origin string, route string, severe_120 int, late boolean")
    features = T.Features(("a", "b", "c"), ("origin",), ("route",))
    prepared = T.prepare_trees(df.where("not late"), df.where("late"), features, "severe_120")
    vectors = T.stage(T.tree_vectors(prepared, df, "flight_id"))
    wanted = [T.TreeSettings(iterations=12, depth=3, step=0.2, min_rows=50), T.TreeSettings(iterations=40, depth=4, step=0.4, min_rows=5, tolerance=0.01)]
    for s, own in zip(wanted, T.fit_settings(prepared, wanted)):
        trees = GBTClassifier(featuresCol="features", labelCol="_label", validationIndicatorCol="_stop", maxIter=s.iterations, maxDepth=s.depth, stepSize=s.step,
                              minInstancesPerNode=s.min_rows, seed=s.seed, maxBins=max(32, prepared.levels + 2), validationTol=s.tolerance)
        with T._small_splits(prepared.rows):
            model = trees.fit(prepared.rows)
        expected = model.transform(vectors).select("flight_id", vector_to_array("probability")[1].alias("expected"))
        gap = T.score_vectors(own, vectors).join(expected, "flight_id").agg(F.max(F.abs(F.col("score") - F.col("expected"))), F.count("*")).first()
        assert own.trees == model.getNumTrees and gap[0] < 1e-9 and gap[1] == 14000


def test_settings_search_fits_the_default_and_thirty_draws_in_full(spark, flights, monkeypatch):
    asked, plain = [], T.fit_settings
    monkeypatch.setattr(Q, "model_frame", lambda *_: flights)
    monkeypatch.setattr(Q, "REPLICATES", 20)
    monkeypatch.setattr(T, "fit_settings", lambda p, settings: asked.extend(settings) or plain(p, settings))
    out = Q.settings_search(spark, "").collect()
    assert len(set(asked)) == 31 and asked[0] == T.TreeSettings() and {s.iterations for s in asked} == {100}
    assert len({r["scorer"] for r in out}) == 31 and sum(r["challenger"] for r in out) == 2


def test_fits_of_several_sets_share_the_passes(spark, flights, monkeypatch):
    passes, plain = [], B._sums
    monkeypatch.setattr(B, "_sums", lambda *a: passes.append(1) or plain(*a))
    fit, stop, valid = Q._parts(flights)
    prepared = [T.prepare_trees(f, stop, Q.TREES, Q.LABEL) for f in (fit, fit.where("flight_id not like '%3'"))]
    apart = [T.fit_prepared(p, Q.SMALL) for p in prepared]
    most = len(passes)
    shared = [f for f, in T.fit_sets([(p, [Q.SMALL]) for p in prepared])]
    assert len(passes) - most < most
    for a, b in zip(apart, shared):
        scores = [sorted(map(tuple, T.score_trees(f, valid).select("flight_id", F.round("score", 9)).collect())) for f in (a, b)]
        assert a.trees == b.trees and scores[0] == scores[1]


def test_ablation_fits_full_trees_for_every_variant_and_seed(spark, flights, monkeypatch):
    asked, plain = [], T.fit_sets
    monkeypatch.setattr(Q, "model_frame", lambda *_: flights)
    monkeypatch.setattr(T, "fit_sets", lambda sets: asked.extend(s for _, settings in sets for s in settings) or plain(sets))
    scores = Q._ablation_scores(spark, "", Q.SEEDS)
    assert {s.iterations for s in asked} == {100} and sorted(s.seed for s in asked) == sorted(3 * Q.SEEDS)
    assert {(r["variant"], r["seed"]): r["count"] for r in scores.groupBy("variant", "seed").count().collect()} == {
        (v, s): 400 for v in ("full", "without_shock", "matched") for s in Q.SEEDS}
