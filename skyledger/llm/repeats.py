"""Substring deduplication on a compacted de Bruijn graph of words.

Edges are windows of ``WINDOW`` words, nodes the runs of one word less between them. Only windows that may repeat become
edges: each window is filed under its minimizer, the smallest hash among its runs of ``PIECE`` words, and equal
windows have equal minimizers, so a window whose minimizer occurs once in all documents is unique. A node branches if
the words before and after it, over all its occurrences, are not always the same; the border of a text counts as a
word. Between branching nodes the edges of a document form paths that every other occurrence of one of their edges shares
whole. Paths meet in a Spark aggregation by the SHA-256 of their words and their length, which verifies them word for
word at their source coordinates; the occurrence with the smallest (doc_id, start) stays, and the words under all
others go.

Defined cases: a null text has no words; null ids come last; rows with equal ids are one document in the order in which
they are stored, so the first of them keeps what they share; texts shorter than a window lose nothing; an empty table gives
no rows. All columns of the input pass by; ``kept``, ``n_words`` and ``n_removed`` are added under names of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from skyledger.llm import exchange
from skyledger.llm.common import discard, from_payload, pack, row_values, shuffle_width, stage, table, to_payload
from skyledger.llm.words import Words, full_windows, mix, window_hashes, words_of

WINDOW, PIECE = 20, 10
KEPT, N_WORDS, N_REMOVED = "_kept", "_n_words", "_n_removed"
_BEGIN, _END = np.uint64(0x5D), np.uint64(0xE7)
PATH_SCHEMA = "block long, row int, doc_id long, start long, words long, digest binary"


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[:-step], out[step:])
        reach += step
    return out


class Block:
    """The words of a block's texts, and its windows within texts."""

    def __init__(self, texts: pa.Array):
        self.words: Words = words_of(texts)
        self.hashes = self.words.hashes()
        self.inside = np.flatnonzero(full_windows(self.words.first, WINDOW))

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """The minimizer of each window within a text, and the hashes at all places that are one."""
        pieces = window_hashes(self.hashes, PIECE)
        span = WINDOW - PIECE + 1
        if not len(self.inside):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        least = _sliding_least(pieces, span)[self.inside]
        chosen = np.zeros(len(pieces), bool)
        for offset in range(span):
            chosen[self.inside + offset] |= pieces[self.inside + offset] == least
        return least, pieces[chosen]

    def nodes(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the nodes at both ends of the edges, their hashes, and a hash of the words before and after each."""
        place = np.unique(np.concatenate([edges, edges + 1]))
        first, last = self.words.first[:-1], self.words.first[1:]
        text = np.searchsorted(last, place, side="right")
        ends = place + WINDOW - 1
        before = np.where(place > first[text], self.hashes[np.maximum(place - 1, 0)], _BEGIN)
        after = np.where(ends < last[text], self.hashes[np.minimum(ends, len(self.hashes) - 1)], _END)
        link = mix(before ^ mix(after))
        return place, window_hashes(self.hashes, WINDOW - 1)[place], np.maximum(link, np.uint64(1))


def _send_minimizers(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, payload in row_values(batches, "block", "payload"):
            _, found = Block(from_payload(payload)["text"]).minimizers()
            keys, bucket, order = exchange.distinct(found, buckets)
            count = np.unique(found, return_counts=True)[1][order] if len(found) else np.empty(0, int)
            yield from exchange.sent(block, keys, bucket, (count > 1).astype(np.uint8))

    return run


def _candidates(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Split a block into texts without a candidate window, and the others with theirs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, payload, marks in row_values(batches, "block", "payload", "marks"):
            rows = from_payload(payload)
            block = Block(rows["text"])
            least, found = block.minimizers()
            keys, _, _ = exchange.distinct(found, buckets)
            repeated = np.sort(keys[exchange.received(marks) > 0])
            edges = block.inside[_isin(least, repeated)]
            text = np.searchsorted(block.words.first, edges, side="right") - 1
            with_edge = np.zeros(rows.num_rows, bool)
            with_edge[text] = True
            shift = np.cumsum(np.where(with_edge, 0, block.words.count))
            places = (edges - shift[text]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([number]), "done": pa.array([_some(rows, ~with_edge)], pa.binary()), "open": pa.array([_some(rows, with_edge)], pa.binary()),
                "rows": pa.array([np.flatnonzero(with_edge).astype(np.int32).tobytes()], pa.binary()), "edges": pa.array([pa.compress(np.diff(places, prepend=0).astype(np.int32).tobytes(), "zstd", asbytes=True)], pa.binary()), "n_edges": pa.array([len(places)], pa.int64())})

    return run


def _some(rows: pa.Table, keep: np.ndarray) -> bytes | None:
    if not keep.any():
        return None
    return to_payload(rows.filter(pa.array(keep)).combine_chunks().to_batches()[0])


def _isin(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _opened(payload: bytes, edges: bytes, n_edges: int) -> tuple[pa.Table, Block, np.ndarray]:
    rows = from_payload(payload)
    return rows, Block(rows["text"]), np.cumsum(np.frombuffer(pa.decompress(edges, n_edges * 4, "zstd", asbytes=True), np.int32).astype(np.int64))


def _send_nodes(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, payload, packed, n in row_values(batches, "block", "open", "edges", "n_edges"):
            _, block, edges = _opened(payload, packed, n)
            _, nodes, links = block.nodes(edges)
            sort = np.argsort(nodes, kind="stable")
            nodes, links = nodes[sort], links[sort]
            first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
            low, high = np.minimum.reduceat(links, first), np.maximum.reduceat(links, first)
            keys, bucket, order = exchange.distinct(nodes, buckets)
            yield from exchange.sent(number, keys, bucket, np.where(low == high, low, np.uint64(0))[order])

    return run


def _paths(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of edges cut at branching nodes and at text borders, with the digest of their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, payload, packed, n, numbers, marks in row_values(batches, "block", "open", "edges", "n_edges", "rows", "marks"):
            rows, block, edges = _opened(payload, packed, n)
            places, nodes, _ = block.nodes(edges)
            keys, _, _ = exchange.distinct(nodes, buckets)
            branching = places[_isin(nodes, np.sort(keys[exchange.received(marks) > 0]))]
            text = np.searchsorted(block.words.first, edges, side="right") - 1
            cut = np.ones(len(edges), bool)
            cut[1:] = (np.diff(edges) != 1) | (text[1:] != text[:-1]) | _isin(edges[1:], branching)
            first = np.flatnonzero(cut)
            begin, size = edges[first], np.diff(np.append(first, len(edges))) + WINDOW - 1
            of = text[first]
            data, start, end = block.words.data, block.words.start, block.words.end
            digests = [hashlib.sha256(b" ".join(data[start[b]:end[b + s - 1]].tobytes().split())).digest() for b, s in zip(begin, size)]
            ids = rows["doc_id"].combine_chunks().take(pa.array(of)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(of), number)), pa.array(np.frombuffer(numbers, np.int32)[of]), ids, pa.array(begin - block.words.first[of]), pa.array(size), pa.array(digests, pa.binary())],
                ["block", "row", "doc_id", "start", "words", "digest"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for done, payload, numbers, gone in row_values(batches, "done", "open", "rows", "gone"):
        if done:
            yield _finished(from_payload(done), {})
        if payload:
            place = {int(r): i for i, r in enumerate(np.frombuffer(numbers, np.int32))}
            spans: dict[int, list[tuple[int, int]]] = {}
            for g in gone or ():
                spans.setdefault(place[g["row"]], []).append((g["start"], g["words"]))
            yield _finished(from_payload(payload), spans)


def _finished(rows: pa.Table, spans: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
    kept, n_words, n_removed = [], [], []
    for number, text in enumerate(rows["text"].to_pylist()):
        words = (text or "").encode().split()
        n_words.append(len(words))
        if number in spans:
            change = np.zeros(len(words) + 1, np.int64)
            for start, size in spans[number]:
                change[start] += 1
                change[start + size] -= 1
            gone = np.cumsum(change[:-1]) > 0
            words = [w for w, g in zip(words, gone) if not g]
        kept.append(b" ".join(words).decode())
        n_removed.append(n_words[-1] - len(words))
    columns = [*[c.combine_chunks() for c in rows.columns], pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [*rows.column_names, KEPT, N_WORDS, N_REMOVED])


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept words joined by one blank, the number of words, and of removed words, of each row."""
    own = [c for c in docs.columns if c not in (KEPT, N_WORDS, N_REMOVED)]
    docs = docs.select(*own)
    blocks = pack(docs, "repeats", *own)
    buckets = shuffle_width(blocks)
    marks = exchange.shared(blocks.select("block", "payload").mapInArrow(_send_minimizers(buckets), exchange.SENT_SCHEMA))
    parted = stage(blocks.join(marks.withColumnRenamed("block", "of"), F.col("block") == F.col("of"), "left").select("block", "payload", "marks").mapInArrow(
        _candidates(buckets), "block long, done binary, open binary, rows binary, edges binary, n_edges long"), "repeats-parted")
    discard(blocks)
    opened = parted.where("open is not null").select("block", "open", "edges", "n_edges", "rows")
    branching = exchange.differing(opened.select("block", "open", "edges", "n_edges").mapInArrow(_send_nodes(buckets), exchange.SENT_SCHEMA))
    paths = stage(opened.join(branching.withColumnRenamed("block", "of"), F.col("block") == F.col("of"), "left").drop("of").mapInArrow(_paths(buckets), PATH_SCHEMA), "repeats-paths")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "block", "row", "start")
    # Written first, so that both sides of the join are dealt anew and Spark can split a path that very many documents share.
    firsts = stage(paths.groupBy(F.col("digest").alias("d"), F.col("words").alias("w")).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeats-firsts")
    again = paths.join(firsts, (F.col("digest") == F.col("d")) & (F.col("words") == F.col("w"))).where((F.col("block") != F.col("first.block")) | (F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start")))
    gone = again.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("row", "start", "words")).alias("gone"))
    schema = StructType([*docs.schema.fields]).add(KEPT, StringType()).add(N_WORDS, LongType()).add(N_REMOVED, LongType())
    return parted.join(gone, F.col("block") == F.col("of"), "left").select("done", "open", "rows", "gone").mapInArrow(_cut, schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = deduplicated(table(spark, folder, "documents").select(F.col("doc_id").cast("long"), "text"))
    return found.select("doc_id", F.col(N_WORDS).alias("n_words"), F.col(N_REMOVED).alias("n_removed"), F.sha2(F.col(KEPT), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 20], ' ')) AS run FROM d, LATERAL (SELECT unnest(range(len(ws) - 19)) AS i) WHERE len(ws) >= 20),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM win),
gone AS (SELECT DISTINCT doc_id, i + k AS place FROM ranked, range(20) AS t(k) WHERE nth > 1),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
