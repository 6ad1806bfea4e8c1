"""Repeated byte strings against counting every window, in one block and in many, sorted and counted by digest."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyledger.llm import suffix_sort
from skyledger.llm.suffix_sort import Suffixes

WIDTH = suffix_sort.WIDTH


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[i:i + WIDTH] for _, t in texts for i in range(len(t) - WIDTH + 1))
    out = []
    for doc_id, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - WIDTH + 1):
            if seen[t[i:i + WIDTH]] > 1:
                gone[i:i + WIDTH] = [True] * WIDTH
        left = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone])), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    draw = random.Random(seed)

    def prose(n):
        return " ".join("".join(draw.choice("abcdé") for _ in range(draw.randint(1, 6))) for _ in range(n))

    shared = [prose(90) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "x" * 200), (4, "y" * 700), (None, shared[0]), (6, "ab" * 300), (7, prose(40) + "q" * 201 + prose(60)), (8, "c" * 10 + "ab" * 150)]
    phrase = prose(25)[:70]
    rows.append((9, prose(20) + phrase * 6 + prose(20)))
    for i in range(20, 60):
        cut, size = draw.randrange(200), draw.randrange(150, 400)
        rows.append((i, prose(draw.randrange(60)) + draw.choice(shared)[cut:cut + size] + prose(draw.randrange(60))))
    edited = list(prose(300))
    for i in range(60, 70):
        edited[draw.randrange(len(edited))] = "!"
        rows.append((i, "".join(edited)))
    rows += [(80, "".join(edited)), (80, "".join(edited)), (90, prose(20_000))]
    return rows


def removed_rows(found):
    columns = ("doc_id", suffix_sort.N_BYTES, suffix_sort.N_REMOVED, suffix_sort.N_SPANS)
    return sorted(((*(r[c] for c in columns), hashlib.sha256(r[suffix_sort.KEPT]).hexdigest()) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed, parts, split", [(1, 1, 4096), (2, 9, 4096), (3, 9, 1), (4, 5, 3)])
def test_all_repeats_go(spark, seed, parts, split):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert removed_rows(suffix_sort.deduplicated(docs, split)) == brute(rows)


def test_query_and_clashing_columns(spark, tmp_path):
    rows = corpus(7)[:30]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("block", "payload", "marks", "_kept", "wide", "n_bytes")})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = suffix_sort.query(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)
    kept = suffix_sort.deduplicated(docs)
    assert kept.columns == ["doc_id", "text", "block", "payload", "marks", "wide", "n_bytes", "_kept", "_n_bytes", "_n_removed", "_n_spans"] and kept.first()["wide"] == "wide"


def test_empty_table(spark):
    assert suffix_sort.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("kinds", [1, 2, 30])
def test_suffixes_are_sorted(kinds):
    draw = np.random.default_rng(kinds)
    piece = bytes(draw.integers(97, 97 + kinds, 400).astype(np.uint8))
    text = b"".join([piece, bytes(draw.integers(97, 97 + kinds, 300).astype(np.uint8)), piece[:350], b"\xff\x00" * 40, piece])
    found = Suffixes(text, 100)
    starts = draw.permutation(len(text) - 99)
    order = found.sorted(starts.copy())
    assert [text[s:s + 100] for s in order] == sorted(text[s:s + 100] for s in starts)
    seen = Counter(text[s:s + 100] for s in starts)
    assert found.repeated(starts.copy()).tolist() == [seen[text[s:s + 100]] > 1 for s in starts]
    x, y = draw.integers(0, len(text) - 99, (2, 500))
    shared = [next((k for k in range(100) if text[a + k] != text[b + k]), 100) for a, b in zip(x, y)]
    assert found.extension(x, y).tolist() == shared


def test_colliding_hashes_are_verified(monkeypatch):
    """With every hash equal the merge sort is wrong, which the bytes show."""
    draw = np.random.default_rng(2)
    text = bytes(draw.integers(97, 99, 600).astype(np.uint8)) * 2
    found = Suffixes(text, 60)
    monkeypatch.setattr(found, "sums", np.zeros_like(found.sums))
    starts = np.arange(len(text) - 59)
    seen = Counter(text[s:s + 60] for s in starts)
    assert found.repeated(starts).tolist() == [seen[text[s:s + 60]] > 1 for s in starts]


def test_pieces_of_minimizers(monkeypatch):
    """Many small sorts give what one large one gives."""
    rows = corpus(11)
    monkeypatch.setattr(suffix_sort, "SORT_BYTES", 600)
    own = suffix_sort.Stretches(pa.array([t for _, t in rows]), 1)
    numbers = np.arange(len(own.chosen))
    at = own.chosen
    table = pa.table({"bucket": [0], "block": [5], "keys": [own.key[at].tobytes()], "windows": [own.windows[at].astype(np.int32).tobytes()], "asks": [np.ones(len(at), bool).tobytes()], "data": [own.bytes_of(numbers)]})
    answer = np.frombuffer(suffix_sort._compare(table)["marks"][0].as_py(), bool)
    texts = own.data.tobytes()
    starts = [s for n in at for s in range(own.first[n], own.first[n] + own.windows[n])]
    seen = Counter(texts[s:s + WIDTH] for s in starts)
    assert answer.tolist() == [seen[texts[s:s + WIDTH]] > 1 for s in starts]
