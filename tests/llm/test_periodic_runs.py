"""Runs against a search over all periods and stretches, in the library and in the registered query."""

import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyledger.llm import periodic_runs


def all_runs(words):
    """Every maximal stretch for every period, kept if no smaller period fits it."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                found.append((i, n, q))
            i = j + 1 if j > i else i + 1
    return sorted(found)


def made(draw):
    words = []
    for _ in range(draw.randint(0, 5)):
        kinds = draw.choice([1, 2, 3, 40])
        phrase = [str(draw.randrange(kinds)) for _ in range(draw.randint(1, draw.choice([2, 9, 20, 70])))]
        words += (phrase * draw.randint(1, 6) + phrase[:draw.randrange(len(phrase))]) if draw.random() < 0.6 else phrase
    return words


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_all_runs(seed):
    draw = random.Random(seed)
    for _ in range(25):
        texts = [made(draw) for _ in range(draw.randint(0, 6))]
        _, found = periodic_runs.block_runs(pa.array([" ".join(t) for t in texts], pa.string()))
        assert found == [all_runs(t) for t in texts]


def test_long_periods():
    draw = random.Random(3)
    phrase = [f"w{draw.randrange(500)}" for _ in range(1500)]
    words = ["x"] * 7 + phrase * 4 + phrase[:700] + ["y", "y"]
    _, found = periodic_runs.block_runs(pa.array(["a b c", " ".join(words), None]))
    assert found == [[], [(0, 7, 1), (7, 6700, 1500)], []]


def test_colliding_hashes_are_not_believed(monkeypatch):
    """With hashes of two bits only, nothing is found that is not there."""
    monkeypatch.setattr(periodic_runs, "mix", lambda x: x & np.uint64(3))
    draw = random.Random(5)
    for _ in range(20):
        words = [str(draw.randrange(30)) for _ in range(60)] * 2 + made(draw)
        _, found = periodic_runs.block_runs(pa.array([" ".join(words)]))
        assert set(found[0]) <= set(all_runs(words))


TEXTS = [
    (1, "a b a b a b a b c"), (2, "x x x x x x y y y y y y y"), (3, None), (4, ""), (None, "z " * 9), (5, " \n\t"), (6, "é ü\né ü\r\né ü é ü"), (7, "one two three"), (7, "one two three"),
    *[(i, " ".join(f"t{(i * k) % 13}" for k in range(i % 60))) for i in range(20, 160)], (300, "p q r s t u v w x y z " * 4000)]


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_query_against_brute_force(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_runs": F.lit(1), "best": F.lit("x"), "n_runs": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        if doc_id == 300:
            continue
        words = (text or "").encode().split()
        code = 1 if doc_id is None else crc32(str(doc_id).encode())
        if words and code % 10 == 0:
            at = code // 10 % len(words)
            p = 1 + (len(words) - at) // (3 + code // 10 % 8)
            words = [w if i < at else words[at + (i - at) % p] for i, w in enumerate(words)]
        runs = all_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        want.append((doc_id, len(runs), s, n, q, None if q is None else 1000 * n // q, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
                     hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r[c] for c in columns) for r in periodic_runs.query(spark, str(tmp_path)).collect()]
    assert sorted(map(str, want)) == sorted(str(g) for g in got if g[0] != 300)
    if rows:
        long = next(g for g in got if g[0] == 300)
        assert long[1] == 1 and long[4] == 11 and any(w[1] for w in want)


def test_other_columns_pass_by(spark):
    docs = spark.createDataFrame([(1, "a a a a a a a b", "own")], "doc_id long, text string, _collapsed string").withColumn("best", F.lit(3))
    row = periodic_runs.collapsed(docs).first()
    assert row.asDict(recursive=True) == {"doc_id": 1, "text": "a a a a a a a b", "best": 3, "_runs": [{"start": 0, "length": 7, "period": 1}], "_collapsed": "a b"}
