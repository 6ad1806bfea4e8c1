"""Benchmark decontamination with a distributed positional inverted index.

The index has one row for each block of documents: its terms and, for each term, its places in the block. Places of
different documents are ``GAP`` apart, so no phrase crosses them. A window of an item is searched by intersecting the
lists of its terms, each moved back by the term's offset, beginning with the term that is rarest in the whole index; a
block that lacks one of the terms is passed over. Items come in batches of at most ``BATCH_WORDS`` words, which bounds
what each task is sent; a longer benchmark takes more passes over the index and loses nothing.

Words are letters (A-Z lower-cased), digits and all non-ASCII characters; a term is the 64-bit hash of a word. The index
holds every word of every document, so it serves any benchmark; ``vocabulary`` builds a smaller one for a known one.

Defined cases: a null text has no words; items without words match nothing; null item ids read as the empty text; rows
with equal ids are judged one by one, items with equal ids count once; empty tables give no rows or no hits. Only
doc_id, item_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import from_payload, numbered_slices, pack, stage, table
from skyledger.llm.words import NOT_ALNUM, words_of

WINDOW, GAP, BATCH_WORDS = 10, 128, 1 << 18
INDEX_SCHEMA = "block long, ids array<long>, n_words array<long>, terms binary, counts binary, places binary"
MATCH_SCHEMA = "block long, row int, doc_id long, n_words long, spans array<struct<first: long, last: long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def item_words(benchmark: DataFrame) -> DataFrame:
    """item, terms: the hashes of each item's words, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column("text"), NOT_ALNUM, lower=True)
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(words.hashes().view(np.int64)))], ["item", "terms"])

    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    return stage(benchmark.select(item.alias("item"), "text").mapInArrow(run, "item string, terms array<long>"), "items")


def index_row(block: int, ids: pa.Array, texts: pa.Array, known: np.ndarray | None) -> pa.RecordBatch:
    """The lists of one block: only of the terms in ``known``, if given."""
    words = words_of(texts, NOT_ALNUM, lower=True)
    value, place = words.hashes(), np.arange(len(words.start)) + words.text_of() * GAP
    if known is not None:
        at = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
        keep = known[at] == value if len(known) else np.zeros(len(value), bool)
        value, place = at[keep].astype(np.uint32), place[keep]
    order = np.argsort(value, kind="stable")
    terms, count = np.unique(value[order], return_counts=True)
    steps = np.diff(place[order].astype(np.int64), prepend=0).astype(np.int32)
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block], pa.int64()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "n_words": pa.array([words.count], pa.list_(pa.int64())),
        "terms": pa.array([(terms if known is None else known[terms]).tobytes()], pa.binary()), "counts": pa.array([count.astype(np.uint32).tobytes()], pa.binary()), "places": pa.array([zlib.compress(steps.tobytes(), 1)], pa.binary())})


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """The staged index of ``docs``, or of packed blocks of them; ``vocabulary``: sorted hashes of the terms to keep."""
    shared = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else shared.value
        for block, part in numbered_slices(batches):
            yield index_row(block, part.column("doc_id"), part.column("text"), known)

    def run_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else shared.value
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                rows = from_payload(payload.as_buffer())
                yield index_row(block, rows["doc_id"], rows["text"], known)

    if "payload" in docs.columns and "text" not in docs.columns:
        return stage(docs.select("block", "payload").mapInArrow(run_packed, INDEX_SCHEMA), "positions")
    return stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX_SCHEMA), "positions")


def term_counts(index: DataFrame) -> DataFrame:
    """term, n: how often each term occurs in all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_pydict({"term": pa.array(np.frombuffer(terms, np.int64)), "n": pa.array(np.frombuffer(counts, np.uint32).astype(np.int64))})

    return index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Lists:
    """Places of the terms of one block."""

    def __init__(self, terms: bytes, counts: bytes, places: bytes):
        self.terms = np.frombuffer(terms, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.uint32).astype(np.int64))])
        self.places = np.cumsum(np.frombuffer(zlib.decompress(places), np.int32).astype(np.int64))

    def number(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term in this block, -1 for a term it lacks."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def of(self, number: int) -> np.ndarray:
        return self.places[self.first[number]:self.first[number + 1]]


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def phrase_starts(lists: Lists, numbers: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where the phrase begins; ``order``: its offsets, rarest term first."""
    starts = lists.of(numbers[order[0]]) - order[0]
    for offset in order[1:]:
        starts = starts[_member(starts + offset, lists.of(numbers[offset]))]
        if not len(starts):
            break
    return starts


def near_starts(lists: Lists, numbers: np.ndarray, order: np.ndarray, within: int) -> np.ndarray:
    """Runs of ``within`` words that hold all terms, as often as the phrase has them, in any order: places of their first terms."""
    anchors = lists.of(numbers[order[0]])
    grid = np.unique((anchors[:, None] + np.arange(1 - within, 1)).ravel())
    terms, need = np.unique(numbers, return_counts=True)
    for number, least in zip(terms, need):
        own = lists.of(number)
        grid = grid[np.searchsorted(own, grid + within) - np.searchsorted(own, grid) >= least]
    return grid[_member(grid, np.sort(np.concatenate([lists.of(x) for x in terms])))] if len(grid) else grid


class Phrases:
    """Windows of a batch of items, grouped by length, with their offsets from the rarest term on."""

    def __init__(self, items: list[str], terms: list[np.ndarray], counts: dict[int, int], width: int = WINDOW):
        groups: dict[int, list[tuple[int, np.ndarray]]] = {}
        for number, words in enumerate(terms):
            size = min(width, len(words))
            for first in range(len(words) - size + 1 if size else 0):
                groups.setdefault(size, []).append((number, words[first:first + size]))
        self.items, self.groups = items, []
        for size, found in groups.items():
            matrix = np.array([w for _, w in found])
            often = np.array([[counts.get(int(t), 0) for t in w] for w in matrix.view(np.int64)])
            self.groups.append((size, np.array([i for i, _ in found]), matrix, np.argsort(often, axis=1, kind="stable")))

    def matches(self, lists: Lists, within: int = 0) -> Iterator[tuple[int, np.ndarray, int]]:
        """(item number, first places, words covered) of each window that occurs in the block."""
        for size, item, matrix, order in self.groups:
            numbers = lists.number(matrix)
            for i in np.flatnonzero((numbers >= 0).all(axis=1)):
                starts = near_starts(lists, numbers[i], order[i], within) if within else phrase_starts(lists, numbers[i], order[i])
                if len(starts):
                    yield int(item[i]), starts, within or size


def _merged(first: np.ndarray, size: np.ndarray, most: int) -> list[dict[str, int]]:
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.minimum(np.maximum.accumulate((first + size)[order]), most)
    cut = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]]))
    return [{"first": int(a), "last": int(b)} for a, b in zip(first[cut], last[np.append(cut[1:], len(last)) - 1])]


def _search(shared, within: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                n_words = np.array(row["n_words"], np.int64)
                begins = np.concatenate([[0], np.cumsum(n_words)])[:-1] + np.arange(len(n_words)) * GAP
                first, size, item = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for number, starts, width in phrases.matches(Lists(row["terms"], row["counts"], row["places"]), within):
                    first.append(starts)
                    size.append(np.full(len(starts), width))
                    item.append(np.full(len(starts), number))
                first, size, item = np.concatenate(first), np.concatenate(size), np.concatenate(item)
                text = np.searchsorted(begins, first, side="right") - 1
                spans, items = [[] for _ in n_words], [[] for _ in n_words]
                for t in np.unique(text):
                    own = text == t
                    spans[t] = _merged(first[own] - begins[t], size[own], int(n_words[t]))
                    items[t] = sorted({phrases.items[i] for i in np.unique(item[own])})
                n = len(n_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(row["ids"], pa.int64()), pa.array(n_words), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                    ["block", "row", "doc_id", "n_words", "spans", "items"])

    return run


def matched(docs: DataFrame, benchmark: DataFrame, within: int = 0, index: DataFrame | None = None) -> DataFrame:
    """A row for each document of ``docs``, plain or packed: merged ``spans`` of words hit (places in the document) and the ``items`` that hit.

    ``within`` asks for proximity instead of phrases: all words of a window, in any order, in a run of so many words.
    ``index`` is one already built for ``docs``.
    """
    if within >= GAP:
        raise ValueError(f"within must be below {GAP}")
    spark = docs.sparkSession
    words = item_words(benchmark)
    total = words.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    batches = max(1, math.ceil(total / BATCH_WORDS))
    part = F.pmod(F.xxhash64("item", F.hash("terms")), F.lit(batches))
    results = []
    index = build_index(docs) if index is None else index
    counts = term_counts(index)
    for number in range(batches):
        own = words.where(part == number)
        held = own.toArrow()  # at most about BATCH_WORDS words, by the number of batches
        often = counts.join(own.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").toArrow()
        phrases = Phrases(held["item"].to_pylist(), [np.array(t, np.int64).view(np.uint64) for t in held["terms"].to_pylist()], dict(zip(often["term"].to_pylist(), often["n"].to_pylist())))
        results.append(index.mapInArrow(_search(spark.sparkContext.broadcast(phrases), within), MATCH_SCHEMA))
    if batches == 1:
        return results[0]
    union = reduce(DataFrame.unionByName, results)
    return union.groupBy("block", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def n_hit():
    """Words under ``spans``, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(state, span):
        more = F.greatest(F.lit(0), span["last"] - F.greatest(span["first"], state["upto"]))
        return F.struct(F.greatest(state["upto"], span["last"]).alias("upto"), (state["n"] + more).alias("n"))

    return F.aggregate(F.array_sort("spans"), start, step, lambda state: state["n"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    blocks = pack(docs, "clean", *docs.columns)
    hit = matched(blocks, benchmark).where(F.size("spans") > 0).groupBy(F.col("block").alias("of")).agg(F.collect_list("row").alias("hit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, gone in zip(batch.column("payload"), batch.column("hit").to_pylist()):
                rows = from_payload(payload.as_buffer())
                keep = np.ones(rows.num_rows, bool)
                keep[gone or []] = False
                yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    return blocks.join(hit, F.col("block") == F.col("of"), "left").select("payload", "hit").mapInArrow(run, docs.schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = matched(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least({WINDOW}, len(ws)) AS size, array_to_string(ws[i + 1:i + least({WINDOW}, len(ws))], ' ') AS win
    FROM b, LATERAL (SELECT unnest(range(greatest(len(ws) - {WINDOW - 1}, 1))) AS i) WHERE len(ws) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
run AS (SELECT rid, i, size, array_to_string(ws[i + 1:i + size], ' ') AS win FROM d, (SELECT DISTINCT size FROM win), LATERAL (SELECT unnest(range(len(ws) - size + 1)) AS i) WHERE len(ws) >= size),
hit AS (SELECT rid, i, r.size, item FROM run r JOIN win w ON r.size = w.size AND r.win = w.win),
words AS (SELECT rid, count(DISTINCT i + k) AS n FROM hit, LATERAL (SELECT unnest(range(size)) AS k) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""
