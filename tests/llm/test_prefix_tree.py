"""Components of near copies against comparing every pair of sets."""

import random

import numpy as np
import pytest

from skyledger.llm import linking, prefix_tree
from skyledger.llm.prefix_tree import Tree


def shingles(text):
    words = [w.decode().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in (text or "").encode().split()]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))}


def corpus(seed, groups=12, copies=14):
    draw = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    boiler = [draw.choice(vocabulary) for _ in range(25)]
    out = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([4, 8, 30, 90]))]
        for _ in range(draw.randint(1, copies)):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(words) // 15))):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            if draw.random() < 0.3:
                words += boiler[:draw.choice([2, 25])]
            out.append(" ".join(words))
    out += [" ".join(boiler)] * 3 + [" ".join(boiler + ["x"]), "One two", "one TWO", None, None, "", " \n", "a a a a a a a a a a", "a " * 900]
    draw.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed,hubs", [(1, 16), (2, 1), (3, 2)])
def test_against_all_pairs(spark, monkeypatch, seed, hubs):
    monkeypatch.setattr(prefix_tree, "HUBS", hubs)
    monkeypatch.setattr(prefix_tree, "CHUNK", 1 << 20 if hubs == 16 else 300)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, class int").repartition(6, "doc_id")
    _, found = prefix_tree.linked(docs, "doc_id", "text")
    least = {r["component"]: r["m"] for r in found.groupBy("component").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "m").collect()}
    assert {r["doc_id"]: (r["n"], least[r["component"]]) for r in found.collect()} == brute(rows)


def test_tree_finds_what_counting_finds():
    draw = np.random.default_rng(5)
    for _ in range(40):
        sets = [np.unique(draw.integers(0, 40, draw.integers(1, 30)).astype(np.uint64)) for _ in range(draw.integers(1, 25))]
        sizes = np.array([len(s) + draw.integers(0, 3) for s in sets])
        tree = Tree(sets, sizes)
        for probe, size in zip(sets, sizes):
            want = [i for i, (s, n) in enumerate(zip(sets, sizes)) if 7 * len(np.intersect1d(s, probe)) >= 3 * (n + size)]
            assert sorted(tree.linked(probe, int(size))) == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (103, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in linking.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_one_of_each(spark):
    text = " ".join(f"t{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, "a"), (9, text, "b"), (4, text + " end", "c"), (4, text + " end", "d"), (5, None, "e"), (5, "", None)], "doc_id long, text string, component string").coalesce(1)
    assert sorted((r["doc_id"], r["component"] or "") for r in prefix_tree.one_of_each(docs).collect()) == [(4, "c"), (5, ""), (5, "e")]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert prefix_tree.linked(docs, "doc_id", "text")[1].count() == 0
    assert prefix_tree.one_of_each(docs).count() == 0
