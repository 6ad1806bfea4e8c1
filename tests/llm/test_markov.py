"""The hidden Markov model against plain recursions, and its whole query against counting in Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skyledger.llm import markov


def plain(model, sequence):
    alpha = model.start * model.emit[sequence[0]]
    forward = [alpha]
    for c in sequence[1:]:
        forward.append((forward[-1] @ model.move) * model.emit[c])
    beta = [np.ones(len(model.start))]
    for c in sequence[:0:-1]:
        beta.append(model.move @ (model.emit[c] * beta[-1]))
    beta.reverse()
    total = forward[-1].sum()
    gamma = np.array([f * b / total for f, b in zip(forward, beta)])
    moves = sum((np.outer(forward[t - 1], model.emit[sequence[t]] * beta[t]) * model.move / total for t in range(1, len(sequence))), np.zeros(model.move.shape))
    return math.log(total), gamma, moves


def test_segments_match_plain_recursions(monkeypatch):
    monkeypatch.setattr(markov, "SEGMENT", 5)
    draw = np.random.default_rng(3)
    model = markov.Model(draw.dirichlet(np.ones(3)), draw.dirichlet(np.ones(3), 3), draw.dirichlet(np.ones(11), 3).T)
    sequences = [draw.integers(0, 11, n) for n in (1, 4, 5, 6, 17, 23, 1)]
    segments = markov.Segments(np.concatenate(sequences), np.array([len(s) for s in sequences]))
    _, total = segments.chain(model, *segments.products(model))
    expected = [plain(model, s) for s in sequences]
    assert np.allclose(total, [e[0] for e in expected])
    starts, moves, emitted, log = segments.expected(model)
    want = np.zeros((11, 3))
    for s, (_, gamma, _) in zip(sequences, expected):
        np.add.at(want, s, gamma)
    assert np.allclose(starts, sum(e[1][0] for e in expected))
    assert np.allclose(moves, sum(e[2] for e in expected))
    assert np.allclose(emitted, want) and np.isclose(log, sum(e[0] for e in expected))


ROWS = [(1, "The the cat\tsat"), (2, None), (3, ""), (None, "dog the"), (5, "cat dog cat dog Ärger"), (5, "cat dog cat dog Ärger"), (6, "unseen words only"), (7, "the " * 700), (8, "the cat sat"), (9, "b c d")]


def python_base(rows):
    tokens = {i: [w.lower() if w.isascii() else w for w in (t or "").split()] + [None] for i, (_, t) in enumerate(rows)}
    held = {i: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for i, (d, _) in enumerate(rows)}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(rows[i][0], held[i], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens.items()]


@pytest.mark.parametrize("top", [0, 2, 1000])
def test_counts_and_base(spark, monkeypatch, top):
    monkeypatch.setattr(markov, "TOP_WORDS", top)
    monkeypatch.setattr(markov, "OWN_TIMES", 2)
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in ROWS], "doc_id long, text string, score double")
    rows = markov.scored(docs, markov.fold("doc_id", 5) == 1).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r)[:6] for r in rows), key=key), sorted(python_base(ROWS), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    assert all(r["score"] < 0 for r in rows)


def hashed(word):
    return markov._words(pa.RecordBatch.from_pydict({"text": [word]})).hashes()[0]


@pytest.mark.parametrize("top", [0, 3, 1000])
def test_training_and_score_by_plain_recursions(spark, monkeypatch, top):
    """Every score from a model trained and a forward recursion run word by word in Python."""
    monkeypatch.setattr(markov, "TOP_WORDS", top)
    monkeypatch.setattr(markov, "OWN_TIMES", 2)
    monkeypatch.setattr(markov, "LEAST_CLASSES", 4)
    monkeypatch.setattr(markov, "SEGMENT", 7)
    monkeypatch.setattr(markov, "AT_ONCE", 3)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ROWS)], "doc_id long, text string")
    held = {i for i in range(len(ROWS)) if i in (3, 6, 8)}
    seen = []
    train = markov.train
    monkeypatch.setattr(markov, "train", lambda tokens, shares: seen.append((shares, train(tokens, shares, iterations=3, gain=-1.0))) or seen[0][1])
    rows = {r["doc_id"]: r["score"] for r in markov.scored(docs, markov.F.col("doc_id").isin(*held)).collect()}
    shares, (model, history) = seen[0]

    texts = {i: [w.lower() if w.isascii() else w for w in (t or "").split()] for i, (_, t) in enumerate(ROWS)}
    counts = Counter(w for i, ws in texts.items() if i not in held for w in ws)
    n_classes = markov.class_count(len(counts) + 1)
    frequent = sorted((w for w in counts if counts[w] > 1), key=lambda w: (-counts[w], hashed(w).view(np.int64)))[:top]
    place = {w: i for i, w in enumerate(sorted(frequent, key=hashed))}
    in_class = lambda w: len(place) + int(hashed(w) >> np.uint64(40)) % n_classes
    symbol = lambda w: place[w] if w in place else in_class(w)
    end = len(place) + n_classes
    mass, unseen = np.zeros(end + 1), np.full(end + 1, 0.5)
    for w, c in counts.items():
        mass[symbol(w)] += c + 0.5
        unseen[in_class(w)] += c == 1
    mass[len(place):end] += unseen[len(place):end]
    mass[end] = len(ROWS) - len(held) + 0.5
    assert np.allclose(shares, mass / mass.sum())

    sequences = {i: [*map(symbol, ws), end] for i, ws in texts.items()}
    again = markov.first_model(shares)
    for before in history:
        parts = [(s, *plain(again, s)) for i, s in sequences.items() if i not in held]
        assert np.isclose(before, sum(p[1] for p in parts))
        emitted = np.zeros(again.emit.shape)
        for s, _, gamma, _ in parts:
            np.add.at(emitted, s, gamma)
        again = markov.next_model(sum(p[2][0] for p in parts), sum(p[3] for p in parts), emitted, shares)
    assert len(history) == 3 and np.allclose(again.emit, model.emit) and np.allclose(again.move, model.move)
    share = lambda w: 1.0 if w in place else (counts[w] + 0.5 if counts[w] else unseen[in_class(w)]) / mass[symbol(w)]
    for i, ws in texts.items():
        want = plain(model, sequences[i])[0] / math.log(10) + sum(math.log10(share(w)) for w in ws)
        assert np.isclose(rows[i], want), ROWS[i]


@pytest.mark.parametrize("top", [0, 2, 1000])
def test_probabilities_sum_to_one(spark, monkeypatch, top):
    """With one state a token's probability does not depend on those before: end, known words and the unknown words of each class add up to 1."""
    monkeypatch.setattr(markov, "TOP_WORDS", top)
    monkeypatch.setattr(markov, "OWN_TIMES", 2)
    monkeypatch.setattr(markov, "LEAST_CLASSES", 2)
    first = markov.first_model
    monkeypatch.setattr(markov, "first_model", lambda shares: first(shares, 1))
    unknown = {int(hashed(w) >> np.uint64(40)) % 2: w for w in ("unknown", "never", "unseen", "other", "more", "x1", "x2")}
    assert len(unknown) == 2
    words = ["a", "b", "c", *unknown.values()]
    docs = spark.createDataFrame([(2, "a b a"), (3, "c a"), (4, "b")] + [(1000 + i, w) for i, w in enumerate(["", *words])], "doc_id long, text string")
    chance = {r["doc_id"] - 1000: 10 ** r["score"] for r in markov.scored(docs, markov.F.col("doc_id") >= 1000).where("held_out").collect()}
    assert np.isclose(chance[0] + sum(chance[1 + i] / chance[0] for i in range(len(words))), 1.0)
    assert chance[1] > chance[3]


def test_gain_over_single_words(spark):
    """Held-out texts whose words are all known are likelier than by their counts alone."""
    rows = markov.query(spark, "/root/testdata/sf0.01").where("held_out and n_known = n_tokens").collect()
    assert len(rows) > 10
    assert sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows) > 0.1


def test_classes_grow_with_the_vocabulary():
    assert [markov.class_count(n) for n in (0, 1, 128 * 1024, 128 * 1024 + 1, 10**12)] == [1024, 1024, 1024, 2048, 1 << 18]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert markov.scored(docs, markov.fold("doc_id", 5) == 1).count() == 0
