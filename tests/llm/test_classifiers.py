"""Language masks and toxicity: held-out accuracy, exact neighbours, and tables with nothing to learn from."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyledger.llm import language_masks, toxicity
from skyledger.llm.common import fold, table

FOLDER = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "lang")
    rows = language_masks.query(spark, FOLDER).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_texts(spark):
    rows = [(1, "the cat and the dog", "en"), (3, "el gato y el perro", "es"), (None, None, "en"), (5, "123 !?", None), (6, "", None), (7, "the dog", None), (7, "the dog", None), (8, "Z", None), (9, "gato " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    masks = language_masks.learn(docs)
    got = [(r["doc_id"], r["lang_pred"]) for r in language_masks.predicted(docs, masks).collect()]
    assert [g for g in got if g[0] in (None, 5, 6, 7, 9)] == [(None, "und"), (5, "und"), (6, "und"), (7, "en"), (7, "en"), (9, "es")]
    assert dict(got)[8] in ("en", "es")
    none = language_masks.learn(docs.where("lang is null"))
    assert {r["lang_pred"] for r in language_masks.predicted(docs, none).collect()} == {"und"}
    assert language_masks.predicted(docs.limit(0), masks).count() == 0


def test_more_languages_than_a_word_has_bits(spark):
    letters = "abcdefghijkl"
    own = {f"l{i:03}": f"{letters[i % 12]}{letters[i // 12]}qu{letters[i // 12]}{letters[i % 12]} " * 5 for i in range(130)}
    docs = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(own.items())], "doc_id long, text string, lang string")
    masks = language_masks.learn(docs)
    assert masks.words.shape[0] == 3
    assert {r["doc_id"]: r["lang_pred"] for r in language_masks.predicted(docs, masks).collect()} == dict(enumerate(own))


def test_masks_hold_every_gram():
    texts = pa.array(["abcdefgh ijkl", None, "", "ab", "Ärger 12 x"])
    value, of = language_masks.grams(texts)
    assert set(of.tolist()) == {0, 4} and (of == 0).sum() == 10


def test_toxicity_held_out(spark):
    labels = table(spark, FOLDER, "labels")
    rows = toxicity.query(spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r["predicted"] for r in rows if r["toxic"] == 1], [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(toxic) > 5 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_block_max_search_is_exact():
    draw = np.random.default_rng(4)
    terms, n = 60, 500
    held = draw.random((n, terms)) * (draw.random((n, terms)) < 0.1)
    at = np.nonzero(held)
    vectors = pa.table({"example": at[0], "term": at[1], "weight": held[at]})
    index = toxicity.build_index(vectors, np.arange(terms, dtype=np.uint64), np.ones(terms), np.arange(n), draw.integers(0, 2, n), np.ones(n))
    unit = held / np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-12)
    for _ in range(60):
        query = draw.random(terms) * (draw.random(terms) < 0.15)
        if not query.any():
            continue
        query /= np.linalg.norm(query)
        _, found = index.nearest(np.flatnonzero(query), query[query > 0])
        exact = np.sort((unit @ query)[unit @ query > 0])[::-1][:toxicity.NEAREST]
        assert np.allclose(found, exact)


def test_monotone_calibration():
    draw = np.random.default_rng(1)
    raw = draw.random(4000)
    _, levels = toxicity.monotone(raw, (draw.random(4000) < raw).astype(int), np.ones(4000))
    assert (np.diff(levels) >= -1e-12).all() and abs(levels[2] - 0.125) < 0.08 and abs(levels[17] - 0.875) < 0.08


@pytest.mark.parametrize("labelled", [True, False])
def test_small_tables(spark, labelled):
    rows = [(i, f"word{i} nice text here today", "x") for i in range(40)] + [(100 + i, f"word{i} vile text here today", "x") for i in range(40)] + [(None, "vile", "x"), (300, None, None), (301, "", None), (302, "vile " * 3000, None), (302, "vile", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = [(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(40)] + [(100, 0), (100, None), (None, 1), (999, 1)]
    labels = spark.createDataFrame(marks if labelled else [], "doc_id long, toxic int")
    index = toxicity.learn(docs, labels)
    out = toxicity.scored(docs, index)
    found = out.select("doc_id", "_score").collect()
    assert out.columns == ["doc_id", "text", "score", "_score", "_evidence"] and len(found) == len(rows)
    if labelled:
        assert all((r["_score"] >= 0.5) == (r["doc_id"] is None or 100 <= r["doc_id"] < 200 or r["doc_id"] == 302) for r in found)
    else:
        assert {r["_score"] for r in found} == {0.0}
    assert toxicity.scored(docs.limit(0), index).count() == 0


def test_fold_of_null_is_that_of_the_empty_text(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(fold("doc_id", 5)).first()[0] == 0


def test_few_labels_and_rare_words_are_enough(spark):
    """Twenty labelled rows, toxic words in a few examples each: no word is too rare to be found by."""
    clean = [(i, f"calm{i % 3} garden{i % 2} morning tea") for i in range(1000, 1010)]
    toxic = [(i, f"slur{i % 4} insult{i % 3} morning tea") for i in range(2000, 2010)]
    probes = [(1, "slur2 insult0"), (2, "calm1 morning"), (3, "insult1 slur3 tea"), (4, "garden1 tea")]
    docs = spark.createDataFrame(clean + toxic + probes, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic], "doc_id long, toxic int")
    score = {r["doc_id"]: r["_score"] for r in toxicity.scored(docs, toxicity.learn(docs, labels)).collect()}
    assert min(score[1], score[3]) >= 0.5 > max(score[2], score[4])


def test_long_clean_text_with_one_toxic_word(spark):
    """All words of a text count, so a single word of the other label does not decide."""
    draw = np.random.default_rng(2)
    clean = [(i, " ".join(f"plain{x}" for x in draw.integers(0, 400, 60))) for i in range(200)]
    toxic = [(1000 + i, f"vile thing {' '.join(f'other{x}' for x in draw.integers(0, 400, 10))}") for i in range(100)]
    probe = [(5000, " ".join([*(f"plain{x}" for x in range(0, 400, 2)), "vile"])), (5001, "vile thing other1")]
    docs = spark.createDataFrame(clean + toxic + probe, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic], "doc_id long, toxic int")
    score = {r["doc_id"]: r["_score"] for r in toxicity.scored(docs, toxicity.learn(docs, labels)).collect()}
    assert score[5000] < 0.5 <= score[5001]


@pytest.mark.parametrize("share", [16, 0])
def test_index_has_every_term_with_corpus_frequencies(spark, monkeypatch, share):
    """The evidence is that of all pairs over all terms, with document frequencies of all rows; matrix or postings alike."""
    monkeypatch.setattr(toxicity, "DENSE_SHARE", share)
    draw = np.random.default_rng(5)
    texts = {i: " ".join(f"w{x}" for x in np.minimum(draw.geometric(0.03, 30), 90)) for i in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    index = toxicity.learn(docs, labels)
    words = {i: t.split() for i, t in texts.items()}
    held = {i: {w: v.count(w) for w in v} for i, v in words.items()}
    number = {w: int(toxicity.words_of(pa.array([w]), toxicity.NOT_ALNUM, lower=True).hashes()[0]) for v in held.values() for w in v}
    assert {number[w] for i in index.ids.tolist() for w in held[i]} == set(index.terms.tolist())
    df = {w: sum(w in v for v in held.values()) for w in number}
    toxic, n1 = [i for i in index.ids.tolist() if i % 2], int(index.labels.sum())
    n0 = len(index.ids) - n1

    def weigh(w):
        a = sum(w in held[i] for i in toxic)
        b = sum(w in held[i] for i in index.ids.tolist()) - a
        chi = (a * (n0 - b) - b * (n1 - a)) ** 2 * (n0 + n1) / max((a + b) * (n0 + n1 - a - b) * n1 * n0, 1e-9)
        return (np.log(151 / (1 + df[w])) + 1) * np.sqrt(1 + chi)

    known = {w: weigh(w) for w in number if number[w] in set(index.terms.tolist())}
    unit = {i: {w: (1 + np.log(n)) * known[w] for w, n in v.items() if w in known} for i, v in held.items()}
    unit = {i: {w: x / np.linalg.norm(list(v.values())) for w, x in v.items()} for i, v in unit.items()}
    for i, (_, found) in zip(texts, index.searched(*index.vectors(pa.array(list(texts.values()))))):
        exact = sorted((sum(x * unit[j].get(w, 0) for w, x in unit[i].items()) for j in index.ids.tolist()), reverse=True)[:toxicity.NEAREST]
        assert np.allclose(found, exact, atol=1e-6)


def test_places_and_cut_hashes_equal_plain_search():
    import numpy as np
    import pyarrow as pa

    from skyledger.llm.words import NOT_ALNUM, Words, words_of

    draw = np.random.Generator(np.random.PCG64(5))
    for n in (0, 1, 2, 1000):
        terms = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        terms = np.unique(np.concatenate([terms, terms[:50] + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)[:n]]))  # crowded runs and both ends
        asked = np.concatenate([terms, terms, draw.integers(0, 1 << 63, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        number = {int(t): i for i, t in enumerate(terms)}
        assert toxicity.Places(terms).of(asked).tolist() == [number.get(int(v), -1) for v in asked]
    words = words_of(pa.array(["Some longer words, a b ab abcd abcde abcdef", None, "", "größer x" * 40]), NOT_ALNUM, lower=True)
    for size, (chosen, found) in zip((0, 4, 5), words.cut_hashes((0, 4, 5))):
        last = words.start[chosen] + size if size else words.end[chosen]
        assert (words.end - words.start > size).nonzero()[0].tolist() == chosen.tolist()
        assert found.tolist() == Words(words.data, words.start[chosen], last, words.first).hashes().tolist()
