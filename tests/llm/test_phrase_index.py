"""Phrases and proximity from the index against scanning."""

import random
import re

import numpy as np
import pytest

from skyledger.llm import phrase_index

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        ws = words(text)
        size = min(width, len(ws))
        for i in range(len(ws) - size + 1 if size else 0):
            windows.setdefault((size, tuple(ws[i:i + size])), set()).add("" if item is None else str(item))
    sizes = {s for s, _ in windows}
    out = {}
    for doc, text in docs:
        ws, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(ws) - size + 1):
                if own := windows.get((size, tuple(ws[i:i + size]))):
                    found |= own
                    hit.update(range(i, i + size))
        out[doc] = (len(ws), len(hit), sorted(found))
    return out


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "ß", "9", "don't"]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, say(draw.choice([1, 3, 9, 10, 11, 25]))) for i in range(20)] + [(None, "null item words here"), (50, None), (51, " .. "), (3, say(12))]
    docs = []
    for i in range(60):
        parts = [say(draw.randint(0, 30))]
        if draw.random() < 0.5:
            parts.append((draw.choice(items)[1] or "").upper().replace(" ", draw.choice([" ", "\n", " - "])))
        docs.append((i, " ".join([*parts, say(draw.randint(0, 10))])))
    return [*docs, (100, None), (101, ""), (102, "w1 " * 400)], items


@pytest.mark.parametrize("seed,batch", [(1, 1 << 20), (2, 60)])
def test_against_scanning(spark, monkeypatch, seed, batch):
    monkeypatch.setattr(phrase_index, "BATCH_WORDS", batch)
    docs, items = corpus(seed)
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string").repartition(5, "doc_id")
    found = phrase_index.matched(frame, spark.createDataFrame(items, "item_id long, text string"))
    rows = found.select("doc_id", "n_words", phrase_index.n_hit().alias("hit"), phrase_index.F.array_sort("items").alias("items")).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in rows} == brute(docs, items)


def test_full_index_and_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "B c")], "doc_id long, text string").coalesce(1)
    index = phrase_index.build_index(docs)
    assert sorted(r["n"] for r in phrase_index.term_counts(index).collect()) == [1, 2, 2]
    known = np.sort(phrase_index.words_of(phrase_index.pa.array(["c zz a"]), phrase_index.NOT_ALNUM, lower=True).hashes())
    assert sorted(r["n"] for r in phrase_index.term_counts(phrase_index.build_index(docs, known)).collect()) == [1, 2]
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert [len(r["spans"]) for r in sorted(phrase_index.matched(docs, items, index=index).collect())] == [0, 1]


def test_proximity():
    def lists(texts):
        row = phrase_index.index_row(0, phrase_index.pa.array(range(len(texts))), phrase_index.pa.array(texts), None).to_pylist()[0]
        return phrase_index.Lists(row["terms"], row["counts"], row["places"])

    held = lists(["x a y b c z", "a b", "c a q q q b a"])
    term = phrase_index.words_of(phrase_index.pa.array(["a b c"]), phrase_index.NOT_ALNUM, lower=True).hashes()
    phrases = phrase_index.Phrases(["i"], [term], {})
    (_, starts, width), = phrases.matches(held, within=4)
    assert width == 4 and starts.tolist() == [1]
    (_, starts, _), = phrases.matches(held, within=6)
    assert np.array_equal(starts, [1, 8 + 2 * phrase_index.GAP])
    assert not list(phrases.matches(held))


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert phrase_index.matched(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    assert [len(r["spans"]) for r in phrase_index.matched(one, items).collect()] == [0, 0]
    assert phrase_index.clean(one, items).count() == 2
