"""Operators against hand values and brute force on small seeded data."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.functions.draws import draw_weights
from skyledger.operators import baselines as BL
from skyledger.operators import bins as B
from skyledger.operators import calibration as K
from skyledger.operators import explain as E
from skyledger.operators import graph as G
from skyledger.operators import paths as P
from skyledger.operators import labels as L
from skyledger.operators import learning as T
from skyledger.operators import metrics as M
from skyledger.operators import ordering as O
from skyledger.operators import recovery as R
from skyledger.operators import resampling as RS
from skyledger.operators import review as V
from skyledger.operators import schema as X
from skyledger.sources import files


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.fixture(scope="module")
def scores():
    rng = random.Random(7)
    out = []
    for i in range(1200):
        score = rng.choice([0.1, 0.2, 0.3, 0.5]) if rng.random() < 0.5 else round(rng.random(), 3)
        out.append((f"r{i:05d}", score, int(rng.random() < 0.1 + 0.4 * score), i % 20, rng.choice("ab")))
    return out


@pytest.fixture(scope="module")
def scored(spark, scores):
    return spark.createDataFrame(scores, "flight_id string, score double, label int, day int, scorer string").repartition(5)


def average_precision(pairs):
    total, hits, seen, value = sum(y for _, y in pairs), 0, 0, 0.0
    for _, group in itertools.groupby(sorted(pairs, reverse=True), key=lambda p: p[0]):
        group = list(group)
        events = sum(y for _, y in group)
        hits, seen = hits + events, seen + len(group)
        value += events / total * hits / seen
    return value


def test_rank_and_running_totals_one_hot_key(spark):
    data = [("hot", 1.0, i) for i in range(900)] + [("cold", float(i), i) for i in range(10)]
    df = spark.createDataFrame(data, "k string, v double, i int").repartition(7)
    ranked = rows_of(O.keyed_rank(df, ["k"], [("v", True), "i"]), "k", "i", "rank", "rank_size")
    assert {i: r for k, i, r, _ in ranked if k == "hot"} == {i: i + 1 for i in range(900)}
    assert {i: r for k, i, r, _ in ranked if k == "cold"} == {i: 10 - i for i in range(10)}
    assert {(k, n) for k, _, _, n in ranked} == {("hot", 900), ("cold", 10)}


def test_quantiles_match_numpy(spark, scored, scores):
    got = O.exact_quantiles(scored, ["scorer"], "score", {"low": 0.1, "mid": 0.5, "high": 0.975})
    for row in got.collect():
        values = [s[1] for s in scores if s[4] == row["scorer"]]
        for name, p in (("low", 0.1), ("mid", 0.5), ("high", 0.975)):
            assert row[name] == pytest.approx(np.quantile(values, p))


def test_binary_metrics_brute_force(scored, scores):
    for row in M.binary_metrics(scored, ["scorer"]).collect():
        pairs = [(s[1], s[2]) for s in scores if s[4] == row["scorer"]]
        positive, negative = [s for s, y in pairs if y], [s for s, y in pairs if not y]
        auc = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative) / (len(positive) * len(negative))
        assert row["pr_auc"] == pytest.approx(average_precision(pairs))
        assert row["roc_auc"] == pytest.approx(auc)
        assert row["brier"] == pytest.approx(sum((s - y) ** 2 for s, y in pairs) / len(pairs))


def test_ranking_table_shares_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.5, 0), (0.5, 1), (0.1, 0), (0.1, 0), (0.1, 0), (0.1, 0), (0.1, 1)], "score double, label int")
    row = M.ranking_table(df, [], [0.3]).first()
    assert (row["reviewed"], row["events_captured"]) == (3, pytest.approx(1 + 2 * 2 / 4))


def test_review_flags_hand_case(spark):
    data = [("a", 0.9, 1), ("b", 0.8, 1), ("c", 0.7, 1), ("d", 0.5, 2), ("e", 0.5, 2), ("f", 0.4, 2)]
    ranked = V.review_ranks(spark.createDataFrame(data, "flight_id string, score double, day int"), ["day"])
    got = dict(rows_of(ranked.withColumn("flag", V.reviewed(0.5)), "flight_id", "flag"))
    assert got == {"a": True, "b": True, "c": False, "d": True, "e": True, "f": False}


def test_bootstrap_average_precision_brute_force(scored, scores):
    got = {(r["scorer"], r["replicate"]): r["pr_auc"] for r in RS.resampled_average_precision(scored, "scorer", "day", 8).collect()}
    weights = draw_weights(8, 20)
    assert (weights.sum(axis=1) == 20).all()
    for (scorer, b), value in got.items():
        pairs = [(s[1], s[2]) for s in scores if s[4] == scorer for _ in range(weights[b][s[3]])]
        assert value == pytest.approx(average_precision(pairs))


def test_bootstrap_does_not_depend_on_partitions(scored):
    first = RS.resampled_average_precision(scored, "scorer", "day", 3)
    second = RS.resampled_average_precision(scored.repartition(2), "scorer", "day", 3)
    assert sorted((r[0], r[1], round(r[2], 12)) for r in first.collect()) == sorted((r[0], r[1], round(r[2], 12)) for r in second.collect())


def test_case_selection_brute_force(scored, scores):
    got = [(r["flight_id"], r["category"], r["pick"]) for r in E.select_cases(scored, 0.05, 0.2).collect()]
    order = sorted(scores, key=lambda s: (-s[1], s[0]))
    rank = {s[0]: i + 1 for i, s in enumerate(order)}
    n, label = len(order), {s[0]: s[2] for s in order}
    alert, review = max(round(0.05 * n), 1), max(round(0.2 * n), 1)
    ids = [s[0] for s in order]
    pools = {"true_positive": [i for i in ids if rank[i] <= alert and label[i]], "false_positive": [i for i in ids if rank[i] <= alert and not label[i]],
             "false_negative": [i for i in ids if rank[i] > review and label[i]], "low_risk_correct": [i for i in ids if rank[i] > n / 2 and not label[i]]}
    want = [(i, "high_confidence_false_positive", "highest_scoring_non_event") for i in [i for i in ids if not label[i]][:3]]
    want += [(i, "high_confidence_false_negative", "lowest_scoring_event") for i in [i for i in reversed(ids) if label[i]][:3]]
    taken = {w[0] for w in want}
    for category, pool in pools.items():
        for q in (0.25, 0.5, 0.75):
            start = round(q * (len(pool) - 1))
            pick = next((pool[(start + k) % len(pool)] for k in range(len(pool)) if pool[(start + k) % len(pool)] not in taken), None)
            if pick:
                taken.add(pick)
                want.append((pick, category, f"typical_q{round(q * 100):02d}"))
    assert sorted(got) == sorted(want)


def test_logistic_fit_recovers_known_values(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.05, 0.6, 20000)
    z = np.log(p / (1 - p))
    y = (rng.random(20000) < 1 / (1 + np.exp(-(-0.4 + 0.7 * z)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "score double, label int")
    fit = K.fit_logistic(K.logit_counts(df, "score", "label"))
    assert fit.slope == pytest.approx(0.7, abs=0.08) and fit.intercept == pytest.approx(-0.4, abs=0.1) and fit.gradient < 1e-5
    level = K.fit_logistic(K.logit_counts(df, "score", "label"), slope=False)
    assert np.mean(1 / (1 + np.exp(-(level.intercept + z)))) == pytest.approx(y.mean(), abs=1e-6)


def test_grouped_slopes_match_single_fits(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(p), int(rng.random() < p * s)) for g, s in (("a", 0.9), ("b", 0.6)) for p in rng.uniform(0.05, 0.9, 400)] + [("none", 0.2, 0), ("none", 0.4, 0)]
    df = spark.createDataFrame(rows, "g string, p double, label int")
    got = {r["g"]: (r["calibration_slope"], r["calibration_in_the_large"]) for r in K.grouped_slopes(df, ["g"], "p").collect()}
    assert set(got) == {"a", "b"}
    for g, pair in got.items():
        assert pair == pytest.approx(K.calibration_slope(df.where(F.col("g") == g), "p"), abs=1e-7)


def test_reversed_scores_are_refused(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1), (0.2, 0), (0.8, 0), (0.9, 0), (0.9, 1)] * 5, "score double, label int")
    with pytest.raises(ValueError, match="not positive"):
        K.fit_platt(df)


def test_calibration_rules(spark):
    # raw, platt, isotonic Brier; upper ends of platt, isotonic, isotonic over platt, recent; method and source
    cases = [(0.03, 0.029, 0.028, -0.1, -0.1, -0.1, -1.0, "isotonic", "recent_year"), (0.03, 0.029, 0.028, -0.1, -0.1, 0.1, math.nan, "platt", "same_as_here"),
             (0.03, 0.029, 0.028, 0.1, -0.1, 0.1, None, "isotonic", "same_as_here"), (0.03, 0.04, 0.04, -0.1, -0.1, -0.1, -1.0, "uncalibrated", "none"), (0.03, 0.029, 0.04, -0.1, None, None, 0.0, "platt", "same_as_here")]
    df = spark.createDataFrame(cases, "brier_uncalibrated double, brier_platt double, brier_isotonic double, platt_high double, isotonic_high double, isotonic_over_platt_high double, recent_high double, want string, want_source string")
    rows = df.withColumn("method", K.method_column()).withColumn("source", K.fit_source_column("method")).collect()
    assert [(r["method"], r["source"]) for r in rows] == [c[-2:] for c in cases]


def test_guards(spark):
    early = spark.createDataFrame([(1, 10), (2, 20)], "flight_id int, second long")
    late = spark.createDataFrame([(2, 15), (3, 30)], "flight_id int, second long")
    row = X.period_guard(early, late, "flight_id", "second", F.lit(30)).first()
    assert (row["locked_rows"], row["in_order"], row["shared_ids"]) == (1, False, 1)
    with pytest.raises(ValueError, match="in order"):
        X.enforce(X.period_guard(early, late, "flight_id", "second", F.lit(99)), {"in order": F.col("in_order")})


def test_forbidden_columns():
    assert X.forbidden_columns(["arrival_delay_minutes", "sched_elapsed", "is_cancelled", "severe_120", "prior_route", "AIR_TIME"]) == ["arrival_delay_minutes", "is_cancelled", "severe_120", "AIR_TIME"]
    for bad in ("TAXI_OUT", "prior_month_severe_delay_rate", "tail_number", "origin_historical_rate", "actual_departure_hour"):
        assert X.forbidden_columns([bad]) == [bad]
        with pytest.raises(ValueError):
            X.checked_predictors(["distance", bad])
    for good in ("scheduled_elapsed_time_minutes", "prior_month_origin_weighted_out_degree", "carrier_identifier", "detail_rated"):
        assert X.checked_predictors([good]) == (good,)
    with pytest.raises(ValueError, match="repeated"):
        X.checked_predictors(["distance", "distance"])
    for name in X.FEATURE_SETS:
        assert X.feature_columns(name)
    with pytest.raises(ValueError):
        X.feature_columns("nothing")


def test_utc_column_required(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2020-01-01 00:00:00' AS wall, TIMESTAMP '2020-01-01 00:00:00' AS instant")
    X.require_utc(df, "instant")
    with pytest.raises(ValueError):
        X.require_utc(df, "wall")


def test_embargo_edges(spark):
    start = 946684800
    df = spark.createDataFrame([(L.DEVELOPMENT, start - 1), (L.DEVELOPMENT, start), (L.VALIDATION, start - 1), (L.VALIDATION, start), (L.FINAL_TEST, None)], "s string, p long")
    assert [r[0] for r in df.select(L.utc_embargo(F.col("s"), F.col("p"))).collect()] == [L.DEVELOPMENT, L.EMBARGOED, L.EMBARGOED, L.VALIDATION, L.EMBARGOED]


def test_exact_sample_is_stable(spark):
    df = spark.range(500).withColumnRenamed("id", "flight_id")
    first, second = ({r[0] for r in L.exact_sample(d, 77, 5).collect()} for d in (df, df.repartition(9)))
    assert first == second and len(first) == 77 and first != {r[0] for r in L.exact_sample(df, 77, 6).collect()}


RULES = [R.Rules("x", 20, 0.05, 0.02, 2)]


@pytest.mark.parametrize("days, want", [
    ([(1, .06), (2, .01), (3, .01)], [(1, 3, 1, R.RECOVERED)]),
    ([(1, .06), (2, .01), (3, .03), (4, .01), (5, .02)], [(1, 5, 1, R.RECOVERED)]),
    ([(1, .06), (2, .01), (4, .01)], [(1, 2, 0, R.GAP)]),
    ([(1, .06), (2, .01), (4, .07), (5, .01)], [(1, 2, 0, R.GAP), (4, 5, 0, R.LAST_DAY)]),
    ([(1, .06), (2, .01), (3, .01), (4, .09)], [(1, 3, 1, R.RECOVERED), (4, 4, 0, R.LAST_DAY)]),
    ([(1, .04), (2, .01)], []),
])
def test_episodes(spark, days, want):
    df = spark.createDataFrame([("A", d, 30, r) for d, r in days], "entity string, day int, completed long, severe_rate double")
    assert sorted(rows_of(R.episodes(df, RULES), "start_day", "end_day", "recovered", "end_reason")) == want


def test_kaplan_meier_hand_case(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (5, 0)], "t0 int, seen int")
    got = {r["t"]: (r["at_risk"], r["survival"]) for r in R.km_curve(df, [], "t0", "seen").collect()}
    assert got[1] == (5, pytest.approx(0.8)) and got[3] == (3, pytest.approx(0.8 / 3)) and got[5][1] == pytest.approx(0.8 / 3)


def random_edges(seed, n=9, p=0.22):
    rng = random.Random(seed)
    return [(w, f"n{a}", f"n{b}", rng.randint(1, 9)) for w in (1, 2) for a in range(n) for b in range(n) if a != b and rng.random() < p]


def all_distances(names, edges):
    reach = {}
    for s in names:
        reach[s], frontier, step = {s: 0}, {s}, 0
        while frontier:
            step += 1
            frontier = {b for a, b, _ in edges if a in frontier and b not in reach[s]}
            reach[s].update(dict.fromkeys(frontier, step))
    return reach


@pytest.mark.parametrize("seed, n, p, batch", [(1, 9, 0.22, 1024), (3, 20, 0.12, 16)])
def test_graph_metrics_brute_force(spark, seed, n, p, batch):
    """The last case has two batches of sources."""
    data = random_edges(seed, n, p)
    edges = spark.createDataFrame(data, "w int, src string, dst string, weight int").repartition(3)
    paths = {(r["w"], r["node"]): r for r in P.centrality(edges, "w", batch=batch).collect()}
    close, between = ({k: r[c] for k, r in paths.items()} for c in ("closeness", "betweenness"))
    searched = {(r["w"], r["source"]): (r["reached"], r["eccentricity"], r["distance_sum"]) for r in P.reach(edges, "w", batch).collect()}
    assert {k: r["closeness"] for k, r in paths.items()} == {(r["w"], r["node"]): r["closeness"] for r in P.centrality(edges, "w", between=False).collect()}
    strong, weak, rank = ({(r["w"], r["node"]): r[c] for r in df.collect()} for df, c in (
        (G.strong_components(edges, "w"), "label"), (G.weak_components(edges, "w"), "label"), (G.pagerank(edges, "w"), "pagerank")))
    for w in (1, 2):
        part = [(a, b, x) for ww, a, b, x in data if ww == w]
        names = sorted({n for a, b, _ in part for n in (a, b)})
        d = all_distances(names, part)
        undirected = all_distances(names, part + [(b, a, x) for a, b, x in part])
        n = len(names)

        def paths(s, t):
            if s == t:
                return 1
            return sum(paths(s, a) for a, b, _ in part if b == t and a in d[s] and d[s][a] == d[s][t] - 1)

        r = dict.fromkeys(names, 1 / n)
        out = {v: sum(x for a, _, x in part if a == v) for v in names}
        for _ in range(100):
            loose = sum(r[v] for v in names if not out[v])
            new = {v: 0.85 * (sum(r[a] * x / out[a] for a, b, x in part if b == v) + loose / n) + 0.15 / n for v in names}
            change, r = sum(abs(new[v] - r[v]) for v in names), new
            if change < n * 1e-6:
                break
        for v in names:
            assert searched[w, v] == (len(d[v]), max(d[v].values()), sum(d[v].values()))
            into = [d[s][v] for s in names if v in d[s]]
            want = (len(into) - 1) / sum(into) * (len(into) - 1) / (n - 1) if sum(into) else 0.0
            assert close[w, v] == pytest.approx(want)
            total = sum(paths(s, v) * paths(v, t) / paths(s, t) for s in names for t in names
                        if s != v and t != v and s != t and v in d[s] and t in d[v] and t in d[s] and d[s][v] + d[v][t] == d[s][t])
            assert between[w, v] == pytest.approx(total / ((n - 1) * (n - 2)))
            assert strong[w, v] == min(u for u in names if u in d[v] and v in d[u])
            assert weak[w, v] == min(undirected[v])
            assert rank[w, v] == pytest.approx(r[v], abs=1e-9)


@pytest.mark.parametrize("seed, n, p", [(5, 24, 0.06)])
def test_strong_components_brute_force(spark, seed, n, p):
    """Sparse graphs with chains, loops of several sizes and loops that reach each other."""
    data = random_edges(seed, n, p) + [(3, f"m{i}", f"m{i + 1}", 1) for i in range(6)] + [(3, "m6", "m2", 1), (3, "z", "m0", 1), (3, "m3", "a", 1), (3, "a", "b", 1), (3, "b", "a", 1)]
    got = {(r["w"], r["node"]): r["label"] for r in G.strong_components(spark.createDataFrame(data, "w int, src string, dst string, weight int"), "w").collect()}
    want = {}
    for w in (1, 2, 3):
        part = [(a, b, x) for ww, a, b, x in data if ww == w]
        names = {x for a, b, _ in part for x in (a, b)}
        d = all_distances(names, part)
        want |= {(w, v): min(u for u in names if u in d[v] and v in d[u]) for v in names}
    assert got == want


def test_graphs_without_edges(spark):
    none = spark.createDataFrame([], "w int, src string, dst string, weight int")
    assert [f(none, "w").count() for f in (G.strong_components, P.reach, P.centrality)] == [0, 0, 0]


def test_concentration_hand_case(spark):
    edges = spark.createDataFrame([(1, "JFK", "LAX", 4), (1, "JFK", "SFO", 1), (1, "LAX", "JFK", 2)], "w int, src string, dst string, weight int")
    got = {r["node"]: (r["out_degree"], r["weighted_out"], r["outgoing_hhi"]) for r in G.degrees(edges, "w").collect()}
    assert got == {"JFK": (2, 5, pytest.approx(0.68)), "LAX": (1, 2, pytest.approx(1.0)), "SFO": (0, 0, 0.0)}


def test_bad_edges_are_counted(spark):
    edges = spark.createDataFrame([(1, "A", "A", 1.0), (1, " ", "B", 1.0), (1, "A", "B", 0.0), (1, "B", "A", 1.5), (1, "C", "A", 1.0), (1, "C", "A", 2.0)], "w int, src string, dst string, weight double")
    assert G.edge_problems(edges).first().asDict() == {"blank_ends": 1, "self_loops": 1, "non_positive": 1, "fractional": 1, "duplicates": 1}


def test_past_counts_brute_force(spark):
    rng = random.Random(5)
    facts = [("hot" if rng.random() < 0.7 else "x", rng.randint(0, 5000)) for _ in range(800)]
    asked = [("hot" if rng.random() < 0.7 else "y", rng.randint(0, 5000)) for _ in range(200)]
    got = {(r["k"], r["second"]): r["prior"] for r in B.past_counts(*(spark.createDataFrame(d, "k string, second long") for d in (facts, asked)), ["k"], 700).collect()}
    assert got == {(k, t): sum(1 for kk, s in facts if kk == k and t - 700 <= s < t) for k, t in asked}


def test_lookback_edges(spark):
    moves = [("A", "B", 3600 * h, 60.0) for h in range(0, 96, 2)]
    df = spark.createDataFrame(moves, "airport string, destination string, dep_seconds long, elapsed double")
    grid = B.grid_for(df)
    asked = df.select("*", (F.col("dep_seconds") - 7200).alias("prediction_seconds"))
    out = B.lookback(asked, B.airport_bins(df, grid), grid)
    row = B.late_bins(out, grid).first()
    assert (row["late_rows"], row["least_valid_bins"], row["most_valid_bins"]) == (0, 0, 16)
    last = out.orderBy(F.desc("dep_seconds")).first()
    assert len(last["sequence"]) == 16 and all(c["real"] for c in last["sequence"])
    with pytest.raises(ValueError):
        B.make_grid(0, 10, 5)


def test_rate_baselines_fall_back(spark):
    schema = "carrier string, origin string, destination string, route string"
    fit = spark.createDataFrame([("c1", "o1", "d1", "o1-d1", 1), ("c1", "o1", "d2", "o1-d2", 0), ("c2", "o2", "d1", "o2-d1", 0)], schema + ", label int")
    row = BL.rate_baselines(fit, spark.createDataFrame([("new", "o1", "new", "o1-new")], schema)).first()
    assert row["carrier_rate"] == pytest.approx(1 / 3) and row["origin_rate"] == pytest.approx((1 + 50 / 3) / 52) and row["route_rate"] == row["origin_rate"]


def test_dimension_checks(spark):
    good = spark.createDataFrame([(" jfk", "America/New_York", "ok"), ("ORD", "America/Chicago", "ok"), ("ZZZ", "", "draft")], "a string, z string, s string")
    assert sorted(rows_of(files.load_dimension(good, "a", "z", {"s": {"ok"}}), "a")) == [("JFK",), ("ORD",)]
    for bad in ([("JFK", "x"), ("jfk", "y")], [("JFK", "")], [(None, "x")]):
        with pytest.raises(ValueError):
            files.load_dimension(spark.createDataFrame(bad, "a string, z string"), "a", "z")


def test_failed_publish_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    files.publish(spark.range(3), path)

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        files.publish(spark.range(9), path, refuse)
    assert spark.read.parquet(path).count() == 3
    assert files.publish(spark.range(5), path).count() == 5


def test_settings_draws_are_distinct():
    found = T.sample_settings(T.TreeSettings(), {"depth": [2, 3], "step": [0.1, 0.2]}, 3, 1)
    assert len(set(found)) == 4 and found[0] == T.TreeSettings()


def test_changed_tables_are_named(spark):
    from skyledger.sources.fingerprint import changed_tables, fingerprint

    first, second = spark.range(10), spark.range(20)
    stored = fingerprint(first, "a").unionByName(fingerprint(second, "b"))
    current = fingerprint(first.repartition(3), "a").unionByName(fingerprint(spark.range(21), "b"))
    assert rows_of(changed_tables(current, stored), "table_name") == [("b",)]


def test_portable_fingerprint_sees_small_changes_and_separators(spark):
    from skyledger.sources.fingerprint import fingerprint

    def digest(rows):
        return fingerprint(spark.createDataFrame(rows, "x double, a string, b string"), "t", ["x", "a", "b"], portable=True).first()["digest_xor"]

    rows = [(0.12, "a|b", "c"), (0.124, "a", "b|c"), (-0.12, "", "abc"), (1e-20, None, "~"), (-1e-20, "~", None), (float("nan"), "a", "b"), (2.0**70, "a", "b"), (None, "a", "b"), (0.1 + 0.2, "a", "b"), (0.3, "a", "b")]
    assert len({digest([r]) for r in rows}) == len(rows)
    assert digest(rows) == digest(rows[::-1])
    assert digest([(0.5, "a|b", "c")]) != digest([(0.5, "a", "b|c")])
