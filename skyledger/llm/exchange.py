"""Questions that blocks of texts ask each other about hashes, through one shuffle of packed arrays.

A block sends each of its distinct keys once, to the bucket that its high bits name, as 32 bits; a bucket marks each key
and sends the marks back. However often a text or a key is repeated, a bucket gets it at most once from each block, so
no frequent key makes a large group. Buckets grow in number with the data, so two keys of a bucket share their 32 bits as
rarely at any size; both uses below stay exact when they do, because a key marked in error is only looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT_SCHEMA = "bucket int, block long, keys binary, links binary"
_MARKS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("marks", pa.binary())])


def distinct(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in the order in which they are sent, their buckets, and the first place of each in the sorted input."""
    ordered = np.unique(keys)
    bucket = ((ordered >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return ordered[order], bucket[order], order


def sent(block: int, keys: np.ndarray, bucket: np.ndarray, links: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``SENT_SCHEMA`` for the distinct keys of a block."""
    if not len(keys):
        return
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    last = np.append(cut[1:], len(keys))
    small = keys.astype(np.uint32)
    yield pa.RecordBatch.from_pydict({
        "bucket": pa.array(bucket[cut].astype(np.int32)), "block": pa.array(np.full(len(cut), block)),
        "keys": pa.array([small[a:b].tobytes() for a, b in zip(cut, last)], pa.binary()), "links": pa.array([links[a:b].tobytes() for a, b in zip(cut, last)], pa.binary())})


def _runs(groups: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, np.uint32) for x in groups["keys"].to_pylist()]
    keys, links = np.concatenate(parts), np.concatenate([np.frombuffer(x, kind) for x in groups["links"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    return links[order], order, first, np.array([len(p) for p in parts])


def _answers(groups: pa.Table, marks: np.ndarray, order: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> pa.Table:
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(marks, np.diff(np.append(first, len(order))))
    parts = np.split(out, np.cumsum(sizes)[:-1])
    return pa.Table.from_arrays([groups["block"].combine_chunks(), groups["bucket"].combine_chunks(), pa.array([p.tobytes() for p in parts], pa.binary())], schema=_MARKS)


def _shared(groups: pa.Table) -> pa.Table:
    links, order, first, sizes = _runs(groups, np.uint8)
    blocks = np.diff(np.append(first, len(order)))
    marks = np.where((blocks > 1) | (np.maximum.reduceat(links, first) > 0), np.minimum(blocks, 255), 0).astype(np.uint8)
    return _answers(groups, marks, order, first, sizes)


def _differing(groups: pa.Table) -> pa.Table:
    links, order, first, sizes = _runs(groups, np.uint64)
    low, high = np.minimum.reduceat(links, first), np.maximum.reduceat(links, first)
    return _answers(groups, ((low != high) | (low == 0)).astype(np.uint8), order, first, sizes)


def by_block(marks: DataFrame) -> DataFrame:
    return marks.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "marks"))).alias("marks"))


def shared(rows: DataFrame) -> DataFrame:
    """block, marks: for each key in how many blocks it is (255 at most), 0 if in this one alone and not marked 1 by its link."""
    return by_block(rows.groupBy("bucket").applyInArrow(_shared, "block long, bucket int, marks binary"))


def differing(rows: DataFrame) -> DataFrame:
    """block, marks: 1 for each key whose links, over all blocks, are not all the same, or are 0 somewhere."""
    return by_block(rows.groupBy("bucket").applyInArrow(_differing, "block long, bucket int, marks binary"))


def received(marks) -> np.ndarray:
    """The marks of a block's distinct keys, in the order in which they were sent; ``marks`` is a row's value."""
    parts = [np.frombuffer(x["marks"], np.uint8) for x in marks or ()]
    return np.concatenate(parts) if parts else np.empty(0, np.uint8)
