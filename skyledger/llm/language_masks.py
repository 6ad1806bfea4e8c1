"""Language identification with Bloom filters sliced by language.

N-grams are runs of four bytes of the text, letters lower-cased (A-Z) and everything that is not a letter folded to
one blank. For each language the n-grams that make up at least ``MIN_SHARE`` of its training n-grams are kept, so a
language has at most ``1 / MIN_SHARE`` of them however large the corpus is. All languages share one array of 64-bit
words: a position has one bit for each language, in as many words as there are groups of ``WORD_BITS`` languages. The
words at an n-gram's positions, and-ed, are the languages that contain it, read at once. For each language the bits of a text's n-grams are counted and corrected for the false
positives that its filter lets through; the largest corrected count decides, ties go to the first language in order.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without text or language are not
learned from; a null id counts as the empty text in the fold; with nothing learned all is ``und``; repeated rows are
judged one by one; an empty table gives no rows. Only doc_id, lang and text are read, and lang only to learn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import fold, stage, table, text_slices
from skyledger.llm.words import LOWER, mix, texts_buffer

#: An n-gram belongs to a language if it is at least this share of the language's training n-grams.
MIN_SHARE = 1 / 50_000
GRAM, HASHES, BITS_PER_GRAM, WORD_BITS = 4, 3, 16, 64
#: Distinct n-grams of a language that a task holds before it sends them on.
TASK_GRAMS = 1 << 20
FOLDS, HELD_OUT = 4, 2

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as 32-bit numbers, and the index of each one's text. Blanks beside blanks do not count."""
    raw, at = texts_buffer(texts)
    data = _FOLD[raw]
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if not len(data):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (of[1:] != of[:-1])
    data, of = data[keep], of[keep]
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    wide = data.astype(np.uint32)
    value = wide[:n] | wide[1:n + 1] << np.uint32(8) | wide[2:n + 2] << np.uint32(16) | wide[3:n + 3] << np.uint32(24)
    inside = of[:n] == of[GRAM - 1:]
    return value[inside], of[:n][inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part in text_slices(batch):
            langs = part.column("lang").dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False)
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                value, _ = grams(part.column("text").filter(pa.array(codes == code)))
                held[lang] = _added(held.get(lang), *np.unique(value, return_counts=True))
                if len(held[lang][0]) > TASK_GRAMS:
                    yield _gram_rows(lang, *held.pop(lang))
    for lang, found in held.items():
        yield _gram_rows(lang, *found)


def _added(before: tuple[np.ndarray, np.ndarray] | None, value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if before is None:
        return value, count
    value, count = np.concatenate([before[0], value]), np.concatenate([before[1], count])
    order = np.argsort(value, kind="stable")
    value, count = value[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.empty(0, int)
    return value[first], np.add.reduceat(count, first) if len(first) else count


def _gram_rows(lang: str, value: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(value), pa.string()), "gram": pa.array(value.astype(np.int64)), "n": pa.array(count.astype(np.int64))})


@dataclass
class Masks:
    """The filters of all languages: rows of words, one row for each 64 languages, one word for each position; and each language's false-positive rate."""

    languages: list[str]
    words: np.ndarray
    wrong: np.ndarray


def positions(value: np.ndarray, size: int) -> list[np.ndarray]:
    return [(mix(value.astype(np.uint64) + np.uint64((i + 1) << 33)) % np.uint64(size)).astype(np.int64) for i in range(HASHES)]


def learn(training: DataFrame) -> Masks:
    """Filters from all rows of ``training`` (lang, text). What reaches the driver is bounded by the share that an n-gram needs."""
    counts = training.select("lang", "text").where("lang is not null and text is not null").mapInArrow(_counts, "lang string, gram long, n long")
    summed = stage(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    totals = summed.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("total"))
    ordered = [r["of"] for r in totals.orderBy("of").collect()]
    kept = summed.join(totals, F.col("lang") == F.col("of")).where(F.col("n") >= F.col("total") * MIN_SHARE).select("lang", "gram").toArrow()
    number = pc.index_in(kept["lang"], pa.array(ordered, pa.string())).to_numpy().astype(np.int64)
    group, place = np.divmod(number, WORD_BITS)
    size = max(64, BITS_PER_GRAM * int(np.bincount(number, minlength=1).max()))
    words = np.zeros((-(-len(ordered) // WORD_BITS), size), np.uint64)
    bit = np.uint64(1) << place.astype(np.uint64)
    for at in positions(kept["gram"].to_numpy(), size):
        np.bitwise_or.at(words, (group, at), bit)
    fill = np.array([np.count_nonzero(words[i // WORD_BITS] >> np.uint64(i % WORD_BITS) & np.uint64(1)) / size for i in range(len(ordered))])
    return Masks(ordered, words, fill ** HASHES)


def decide(masks: Masks, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The index of the language of each text, and the share of its n-grams that the language has after correction."""
    value, of = grams(texts)
    n = len(texts)
    every = np.bincount(of, minlength=n).astype(float)
    places = positions(value, masks.words.shape[1])
    best, most = np.zeros(n, np.int64), np.full(n, -np.inf)
    for i, wrong in enumerate(masks.wrong):
        if i % WORD_BITS == 0:
            held = np.full(len(value), ~np.uint64(0))
            for at in places:
                held &= masks.words[i // WORD_BITS][at]
        hits = np.bincount(of, weights=(held >> np.uint64(i % WORD_BITS) & np.uint64(1)).astype(float), minlength=n)
        share = (hits - every * wrong) / np.maximum(every * (1 - wrong), 1e-9)
        best[share > most] = i
        most = np.maximum(most, share)
    return best, np.clip(most, 0, 1)


def _decide(masks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = masks.value
        names = np.array([*known.languages, "und"], dtype=object)
        for batch in batches:
            for part in text_slices(batch):
                text, letters = part.column("text"), part.column("has_letter").to_numpy(zero_copy_only=False)
                if known.languages:
                    best, score = decide(known, text)
                else:
                    best, score = np.zeros(len(text), int), np.zeros(len(text))
                    letters = np.zeros(len(text), bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names[np.where(letters, best, len(known.languages))], pa.string()),
                     pa.array(np.where(letters, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, masks: Masks) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    held_out = fold("doc_id", FOLDS) == HELD_OUT
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), letter.alias("has_letter"), "text")
    return rows.mapInArrow(_decide(docs.sparkSession.sparkContext.broadcast(masks)), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return predicted(docs, learn(docs.where(fold("doc_id", FOLDS) != HELD_OUT)))
