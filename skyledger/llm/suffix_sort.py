r"""Removal of repeated byte strings with a suffix sort that compares by hashes.

Every window of ``WIDTH`` bytes that also starts anywhere else is cut out, wherever it stands. Windows that are equal
have the same minimizer, the smallest hash among their strings of ``PIECE`` bytes, at the same place; so the windows
whose minimizer is at one place of a text make a *stretch* of at most ``WIDTH - PIECE + 1`` windows, and windows of one
stretch are never equal. Blocks of texts send the minimizer and a 128-bit digest of each stretch to buckets, which answer: the
minimizer is nowhere else, so no window is repeated; the same stretch is elsewhere, so all are; or stretches that differ
share a minimizer. Only these last ones meet, by minimizer, and the suffixes at their windows are sorted: prefix
polynomial hashes and binary search give the common extension of two suffixes, a merge sort of equal prefixes needs a
logarithmic number of such comparisons for each suffix, and neighbours that share ``WIDTH`` bytes are repeats. All
neighbours of the result are then compared byte by byte; if a hash collided, the suffixes are sorted by their bytes.

A minimizer that more than ``SPLIT`` different stretches share would be a group without a bound. Its windows are counted
by digest instead, with partial counts in the map tasks.

Defined cases: a null text is empty; a text shorter than a window loses nothing; rows with equal ids are separate
documents; an empty table gives no rows. All columns of the input pass by; the results replace columns of their names.
What is left of a text may end inside a character, so it is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from skyledger.llm import exchange
from skyledger.llm.common import from_payload, pack, row_values, shuffle_width, stage, table
from skyledger.llm.words import BYTE_VALUE, powers, texts_buffer, window_hashes

WIDTH, PIECE = 200, 64
#: Different stretches of one minimizer that are sorted together at most.
SPLIT = 4096
#: Bytes of stretches that are sorted at once.
SORT_BYTES = 1 << 20
KEPT, N_BYTES, N_REMOVED, N_SPANS = "_kept", "_n_bytes", "_n_removed", "_n_spans"
#: What a bucket answers for a stretch: no window is repeated; all are; all are, and this copy is compared with others; to be compared;
#: the last two again for a minimizer with more than ``SPLIT`` stretches.
UNIQUE, REPEATED, SHOWN, COMPARED, REPEATED_WIDE, WIDE = range(6)
SENT = "bucket int, block long, keys binary, digests binary, twice binary"
SHOWN_SCHEMA = "bucket int, block long, keys binary, windows binary, asks binary, data binary"
ANSWER = "block long, bucket int, marks binary"
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = np.minimum(values[:-step], values[step:])
        reach += step
    return values


class Stretches:
    """The stretches of a block: first window, number of windows, minimizer; distinct ones in the order in which they are sent."""

    def __init__(self, texts: pa.Array, buckets: int):
        self.data, self.at = texts_buffer(texts)
        n = len(self.data)
        self.first, self.windows, self.key = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        if n >= WIDTH:
            grams = window_hashes(BYTE_VALUE[self.data], PIECE)
            bits = np.uint64(n.bit_length())
            places = np.arange(len(grams), dtype=np.uint64)
            least = sliding_least((grams >> bits << bits) | places, WIDTH - PIECE + 1)
            place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            place[~self._inside(len(place))] = -1
            cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            size, place = np.diff(np.append(cut, len(place))), place[cut]
            self.first, self.windows, self.key = cut[place >= 0], size[place >= 0], grams[place[place >= 0]]
        high, low = self._digests()
        bucket = ((self.key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((low, high, self.key, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.chosen = order[new]
        self.bucket, self.high, self.low = bucket[self.chosen], high[self.chosen], low[self.chosen]
        self.twice = np.bincount(self.number, minlength=len(self.chosen)) > 1

    def _inside(self, n: int) -> np.ndarray:
        """Marks the windows that lie within one text."""
        change = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(change, np.maximum(self.at[1:] - WIDTH + 1, self.at[:-1]), 1)
        np.subtract.at(change, self.at[1:], 1)
        return np.cumsum(change[:n]) == 0

    def _digests(self) -> tuple[np.ndarray, np.ndarray]:
        data = self.data.tobytes()
        both = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(self.first.tolist(), (self.first + self.windows + WIDTH - 1).tolist())])
        pairs = np.frombuffer(both, np.uint64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def by_bucket(self, use: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Bucket, and numbers of the distinct stretches in ``use``, rising."""
        cut = np.flatnonzero(np.diff(self.bucket[use])) + 1
        for part in np.split(use, cut) if len(use) else ():
            yield int(self.bucket[part[0]]), part

    def bytes_of(self, numbers: np.ndarray) -> bytes:
        at = self.chosen[numbers]
        return b"".join([self.data[a:b].tobytes() for a, b in zip(self.first[at].tolist(), (self.first[at] + self.windows[at] + WIDTH - 1).tolist())])

    def window_digests(self, number: int) -> list[bytes]:
        at = self.chosen[number]
        first, data = int(self.first[at]), self.data
        return [hashlib.blake2b(data[i:i + WIDTH], digest_size=16).digest() for i in range(first, first + int(self.windows[at]))]


def _send(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, payload in row_values(batches, "block", "payload"):
            own = Stretches(from_payload(payload)["text"], buckets)
            rows = [(b, part) for b, part in own.by_bucket(np.arange(len(own.chosen)))]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([b for b, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()),
                "keys": pa.array([own.key[own.chosen[p]].astype(np.uint32).tobytes() for _, p in rows], pa.binary()),
                "digests": pa.array([np.stack([own.high[p], own.low[p]], 1).tobytes() for _, p in rows], pa.binary()),
                "twice": pa.array([own.twice[p].tobytes() for _, p in rows], pa.binary())})

    return run


def answered(groups: pa.Table, split: int) -> pa.Table:
    """What each sender is told about each of its stretches. The copy that is compared is the first sender's."""
    keys = [np.frombuffer(x, np.uint32) for x in groups["keys"].to_pylist()]
    sizes = np.array([len(k) for k in keys])
    key = np.concatenate(keys)
    digest = np.concatenate([np.frombuffer(x, np.uint64) for x in groups["digests"].to_pylist()]).reshape(-1, 2)
    twice = np.concatenate([np.frombuffer(x, bool) for x in groups["twice"].to_pylist()])
    order = np.lexsort((digest[:, 1], digest[:, 0], key))
    key, digest, twice = key[order], digest[order], twice[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key.copy()
    new[1:] |= (digest[1:] != digest[:-1]).any(1)
    opens, key_opens = np.flatnonzero(new), np.flatnonzero(new_key)
    again = np.add.reduceat(1 + twice.astype(np.int64), opens) > 1
    kinds = np.add.reduceat(new.astype(np.int64), key_opens)
    again = np.repeat(again, np.diff(np.append(opens, len(key))))
    kinds = np.repeat(kinds, np.diff(np.append(key_opens, len(key))))
    marks = np.where(again, REPEATED, np.where(kinds > split, WIDE, np.where(kinds > 1, COMPARED, UNIQUE)))
    marks[new & again & (kinds > 1)] = SHOWN
    marks[new & again & (kinds > split)] = REPEATED_WIDE
    out = np.empty(len(order), np.uint8)
    out[order] = marks
    parts = np.split(out, np.cumsum(sizes)[:-1])
    return pa.table({"block": groups["block"], "bucket": groups["bucket"], "marks": pa.array([p.tobytes() for p in parts], pa.binary())})


def _show(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of the stretches that are compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, payload, marks in row_values(batches, "block", "payload", "marks"):
            state = exchange.received(marks)
            if not ((state == SHOWN) | (state == COMPARED)).any():
                continue
            own = Stretches(from_payload(payload)["text"], buckets)
            for bucket, part in own.by_bucket(np.flatnonzero((state == SHOWN) | (state == COMPARED))):
                at = own.chosen[part]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([bucket], pa.int32()), "block": pa.array([block], pa.int64()), "keys": pa.array([own.key[at].tobytes()], pa.binary()),
                    "windows": pa.array([own.windows[at].astype(np.int32).tobytes()], pa.binary()), "asks": pa.array([(state[part] == COMPARED).tobytes()], pa.binary()), "data": pa.array([own.bytes_of(part)], pa.binary())})

    return run


class Suffixes:
    """Suffixes of a byte string, compared over ``width`` bytes; each has as many."""

    def __init__(self, data: bytes, width: int = WIDTH):
        self.raw, self.width = data, width
        self.data = np.frombuffer(data, np.uint8)
        n = len(self.data)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray((n + 1,), ">u8", padded, strides=(1,)).astype(np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[self.data] * powers(_BASE, n), dtype=np.uint64)])
        self.back = powers(_BASE_INVERSE, n + 1)

    def _same(self, x: np.ndarray, y: np.ndarray, n) -> np.ndarray:
        return (self.sums[x + n] - self.sums[x]) * self.back[x] == (self.sums[y + n] - self.sums[y]) * self.back[y]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at ``x`` and ``y`` share, ``width`` at most, by binary search on hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.width - 1, np.int64)
        high[self._same(x, y, self.width)] = self.width
        low[high == self.width] = self.width
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_] + 1) // 2
            good = self._same(x[open_], y[open_], middle)
            low[open_[good]] = middle[good]
            high[open_[~good]] = middle[~good] - 1
        return low

    def compared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at ``x`` is smaller than, equal to, or greater than that at ``y``, by hashes."""
        shared = self.extension(x, y)
        differ = shared < self.width
        a, b = self.data[np.where(differ, x + shared, 0)].astype(np.int16), self.data[np.where(differ, y + shared, 0)].astype(np.int16)
        return np.where(differ, np.sign(a - b), 0)

    def compared_by_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
        for offset in range(0, self.width, 8):
            last = min(8, self.width - offset)
            a, b = self.eight[x[open_] + offset] >> np.uint64(64 - 8 * last), self.eight[y[open_] + offset] >> np.uint64(64 - 8 * last)
            out[open_[a < b]], out[open_[a > b]] = -1, 1
            open_ = open_[a == b]
        return out

    def sorted(self, starts: np.ndarray) -> np.ndarray:
        """``starts`` in the order of their suffixes: runs of one 16-byte prefix are merge sorted, all runs at once."""
        first, second = self.eight[starts], self.eight[np.minimum(starts + 8, len(self.eight) - 1)]
        order = np.lexsort((second, first))
        starts, first, second = starts[order], first[order], second[order]
        new = np.ones(len(starts), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        opens = np.flatnonzero(new)
        size = np.diff(np.append(opens, len(starts)))
        base, size = np.repeat(opens, size), np.repeat(size, size)
        width = 1
        while len(at := np.flatnonzero(size > width)):
            starts[at] = self._merged(starts, at, base[at], size[at], width)
            width *= 2
        return starts

    def _merged(self, starts: np.ndarray, at: np.ndarray, base: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """Each neighbouring pair of sorted pieces of ``width`` becomes one: a suffix moves by its rank in the other piece."""
        local = at - base
        piece = local // width
        other = (piece ^ 1) * width
        low, high = np.minimum(other, size), np.minimum(other + width, size)
        begin, later = low.copy(), piece % 2 == 1
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            sign = self.compared(starts[base[open_] + middle], starts[at[open_]])
            before = (sign < 0) | ((sign == 0) & later[open_])
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]
        goes = base + piece // 2 * 2 * width + local - piece * width + low - begin
        out = np.empty(len(at), starts.dtype)
        out[np.searchsorted(at, goes)] = starts[at]
        return out

    def repeated(self, starts: np.ndarray) -> np.ndarray:
        """Marks the suffixes that another one equals."""
        marks = np.zeros(len(starts), bool)
        if len(starts) < 2:
            return marks
        ordered = self.sorted(starts)
        sign = self.compared_by_bytes(ordered[:-1], ordered[1:])
        if (sign > 0).any():
            ordered = np.array(sorted(starts.tolist(), key=lambda s: self.raw[s:s + self.width]), np.int64)
            sign = self.compared_by_bytes(ordered[:-1], ordered[1:])
        place = np.empty(len(self.data) + 1, np.int64)
        place[starts] = np.arange(len(starts))
        marks[place[ordered[:-1][sign == 0]]] = True
        marks[place[ordered[1:][sign == 0]]] = True
        return marks


def _compare(groups: pa.Table) -> pa.Table:
    """For each sender a byte for each window of the stretches it asked about: 1 if the window is elsewhere too."""
    keys = [np.frombuffer(x, np.uint64) for x in groups["keys"].to_pylist()]
    sender = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    key = np.concatenate(keys)
    windows = np.concatenate([np.frombuffer(x, np.int32) for x in groups["windows"].to_pylist()]).astype(np.int64)
    asks = np.concatenate([np.frombuffer(x, bool) for x in groups["asks"].to_pylist()])
    data, _ = texts_buffer(groups["data"])
    first = np.cumsum(windows + WIDTH - 1) - (windows + WIDTH - 1)
    answers: list[np.ndarray] = [np.empty(0, bool)] * len(key)
    order = np.argsort(key, kind="stable")
    upto = np.cumsum((windows + WIDTH - 1)[order])
    # Pieces of whole minimizers, of about SORT_BYTES each: windows of different minimizers are never equal.
    edge = np.append(np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0])), len(order))
    low = 0
    while low < len(order):
        done = upto[low - 1] if low else 0
        high = edge[max(np.searchsorted(edge, low, side="right"), np.searchsorted(edge, np.searchsorted(upto, done + SORT_BYTES), side="right") - 1)]
        part = order[low:high]
        texts = Suffixes(b"".join([data[a:b].tobytes() for a, b in zip(first[part].tolist(), (first + windows + WIDTH - 1)[part].tolist())]))
        begin = np.cumsum(windows[part] + WIDTH - 1) - (windows[part] + WIDTH - 1)
        sizes = windows[part]
        starts = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        for stretch, marks in zip(part.tolist(), np.split(texts.repeated(starts), np.cumsum(sizes)[:-1])):
            answers[stretch] = marks
        low = high
    asked = [b"".join([answers[i].tobytes() for i in np.flatnonzero(asks & (sender == s)).tolist()]) for s in range(len(keys))]
    return pa.table({"block": groups["block"], "bucket": groups["bucket"], "marks": pa.array(asked, pa.binary())})


def _wide_windows(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows of stretches whose minimizer too many others share, each digest of a block once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, payload, marks in row_values(batches, "block", "payload", "marks"):
            state = exchange.received(marks)
            numbers = np.flatnonzero((state == WIDE) | (state == REPEATED_WIDE))
            if not len(numbers):
                continue
            own = Stretches(from_payload(payload)["text"], buckets)
            count: dict[bytes, int] = {}
            for number in numbers.tolist():
                for digest in own.window_digests(number):
                    count[digest] = count.get(digest, 0) + 1
            pairs = np.frombuffer(b"".join(count), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(np.full(len(pairs), block)), "high": pa.array(pairs[:, 0]), "low": pa.array(pairs[:, 1]), "n": pa.array(list(count.values()), pa.int64())})

    return run


def _cut(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for payload, marks, compared, wide in row_values(batches, "payload", "marks", "compared", "wide"):
            rows = from_payload(payload)
            state, answers = exchange.received(marks), exchange.received(compared)
            data, at = texts_buffer(rows["text"])
            gone = np.zeros(len(data), bool)
            if state.any():
                own = Stretches(rows["text"], buckets)
                gone = removed(own, state, answers, {(w["high"], w["low"]) for w in wide or ()})
            yield _finished(rows, data, at, gone)

    return run


def removed(own: Stretches, state: np.ndarray, answers: np.ndarray, wide: set[tuple[int, int]]) -> np.ndarray:
    """Marks the bytes under repeated windows."""
    change = np.zeros(len(own.data) + 1, np.int64)
    told = state[own.number]
    whole = (told == REPEATED) | (told == SHOWN) | (told == REPEATED_WIDE)
    np.add.at(change, own.first[whole], 1)
    np.subtract.at(change, (own.first + own.windows + WIDTH - 1)[whole], 1)
    # A stretch that is compared or wide stands in its block once, so its number has one place.
    at = own.chosen[np.flatnonzero(state == COMPARED)]
    sizes = own.windows[at]
    places = (np.repeat(own.first[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()))[answers > 0]
    spots = [places]
    for number in np.flatnonzero(state == WIDE).tolist():
        pairs = np.frombuffer(b"".join(own.window_digests(number)), np.int64).reshape(-1, 2).tolist()
        spots.append(int(own.first[own.chosen[number]]) + np.flatnonzero([tuple(p) in wide for p in pairs]))
    places = np.concatenate(spots)
    np.add.at(change, places, 1)
    np.subtract.at(change, places + WIDTH, 1)
    return np.cumsum(change[:-1]) > 0


def _finished(rows: pa.Table, data: np.ndarray, at: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    n = np.diff(at)
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    begins = at[:-1][n > 0]
    starts[begins] = gone[begins]
    sums, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(starts)])
    left = data[~gone]
    ends = (at - sums[at]).astype(np.int64)
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(left))]).cast(pa.binary())
    added = [kept, pa.array(n), pa.array(sums[at[1:]] - sums[at[:-1]]), pa.array(spans[at[1:]] - spans[at[:-1]])]
    return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in rows.columns], *added], [*rows.column_names, KEPT, N_BYTES, N_REMOVED, N_SPANS])


def _listed(marks: DataFrame, name: str) -> DataFrame:
    return marks.withColumnsRenamed({"block": f"{name}_of", "marks": name})


def deduplicated(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """``docs`` with the bytes that are left, the numbers of bytes and of removed bytes, and that of removed spans, of each row.

    A minimizer with more than ``split`` different stretches is not sorted by one task: its windows are counted by digest.
    """
    own = [c for c in docs.columns if c not in (KEPT, N_BYTES, N_REMOVED, N_SPANS)]
    docs = docs.select(*own)
    blocks = pack(docs, "suffix", *own)
    buckets = shuffle_width(blocks)
    sent = blocks.select("block", "payload").mapInArrow(_send(buckets), SENT)
    marks = stage(exchange.by_block(sent.groupBy("bucket").applyInArrow(lambda groups: answered(groups, split), ANSWER)), "suffix-marks")
    marked = blocks.join(_listed(marks, "marks"), F.col("block") == F.col("marks_of"), "left").drop("marks_of")
    shown = marked.select("block", "payload", "marks").mapInArrow(_show(buckets), SHOWN_SCHEMA)
    compared = exchange.by_block(shown.groupBy("bucket").applyInArrow(_compare, ANSWER))
    wide = stage(marked.select("block", "payload", "marks").mapInArrow(_wide_windows(buckets), "block long, high long, low long, n long"), "suffix-wide")
    again = wide.groupBy(F.col("high").alias("h"), F.col("low").alias("l")).agg(F.sum("n").alias("total")).where("total > 1")
    repeated = wide.join(again, (F.col("high") == F.col("h")) & (F.col("low") == F.col("l"))).groupBy(F.col("block").alias("wide_of")).agg(F.collect_list(F.struct("high", "low")).alias("wide"))
    told = marked.join(_listed(compared, "compared"), F.col("block") == F.col("compared_of"), "left").join(repeated, F.col("block") == F.col("wide_of"), "left")
    schema = StructType([*docs.schema.fields]).add(KEPT, BinaryType())
    for name in (N_BYTES, N_REMOVED, N_SPANS):
        schema = schema.add(name, LongType())
    return told.select("payload", "marks", "compared", "wide").mapInArrow(_cut(buckets), schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col(N_BYTES).alias("n_bytes"), F.col(N_REMOVED).alias("n_removed"), F.col(N_SPANS).alias("n_spans"), F.sha2(KEPT, 256).alias("kept_sha256"))
