"""Removed words against a brute-force search over all windows, with documents spread over several blocks."""

import random

import pytest
from pyspark.sql import functions as F

from skyledger.llm import repeats

SCHEMA = "doc_id long, text string, _kept string, words long"


def brute(rows, window=repeats.WINDOW):
    """rows in document order: (doc_id, text). Returns the kept words of each."""
    seen, out = set(), []
    for _, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            run = tuple(words[i:i + window])
            if run in seen:
                gone.update(range(i, i + window))
            seen.add(run)
        out.append((len(words), len(gone), b" ".join(w for j, w in enumerate(words) if j not in gone).decode()))
    return out


def texts(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[draw.choice(vocabulary) for _ in range(draw.randint(15, 60))] for _ in range(6)]
    out = []
    for _ in range(60):
        words = []
        for _ in range(draw.randint(0, 6)):
            words += draw.choice(passages) if draw.random() < 0.5 else [draw.choice(vocabulary) for _ in range(draw.randint(1, 40))]
        out.append(" ".join(words))
    out += ["a " * 70, "a b " * 40, "x a b " * 30, "a " * 19, "a " * 20, "\n".join(passages[0]) + "\x0b", "Ä  é x " * 30]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = list(enumerate(texts(seed)))
    rows += [(1000, rows[0][1]), (1001, None), (1002, ""), (1003, " \n ")]
    docs = spark.createDataFrame([(d, t, "clash", 5) for d, t in rows], SCHEMA).repartition(7, "doc_id")
    got = {r["doc_id"]: (r[repeats.N_WORDS], r[repeats.N_REMOVED], r[repeats.KEPT]) for r in repeats.deduplicated(docs).collect()}
    assert got == {d: w for (d, _), w in zip(rows, brute(rows))}


def test_null_and_equal_ids(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (None, None)], "doc_id long, text string").coalesce(1)
    rows = repeats.deduplicated(docs).select("doc_id", repeats.N_REMOVED).collect()
    assert sorted((r[0] or 0, r[1]) for r in rows) == [(0, 0), (0, 30), (5, 0), (5, 30)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    out = repeats.deduplicated(docs)
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "text", "lang"]


def test_other_columns_pass(spark):
    docs = spark.createDataFrame([(1, "a b", "en", None)], "doc_id long, text string, lang string, source string").withColumn("at", F.lit(1.5))
    row = repeats.deduplicated(docs).first()
    assert (row["lang"], row["source"], row["at"], row["text"], row[repeats.KEPT]) == ("en", None, 1.5, "a b", "a b")
