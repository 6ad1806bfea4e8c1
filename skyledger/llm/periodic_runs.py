r"""Periodic runs of words: stretches that repeat a short or long phrase at least four times in a row.

Words of a block of texts become numbers, the texts one after another with a number of its own after each, so that no
repeat crosses a border. Periods up to ``SHORT`` are found by comparing the numbers with those 1, 2, .. ``SHORT`` places on.
Longer ones come from minimizers on scales that double: on the scale ``k`` every window of ``k / 2`` runs of ``k`` words
marks its smallest hash. Inside a run with a period ``q`` above ``k / 2`` and up to ``k``, the windows at ``i`` and ``i + q``
mark the same run of words, none in between is equal to it, and four periods have room for both; so neighbours among the
equal minimizers of a scale are seeds at distance ``q``. A seed is extended both ways with prefix hashes and binary search, then
compared word by word, so that a hash that collides costs time only.

Work for each scale is some passes over arrays; texts too short for a scale's periods leave before it.

Defined cases: a null text has no words; an empty table gives no rows; repeated rows are judged one by one; ties
in exponent go to the smaller start, then the smaller period. All columns of the input pass by; ``_runs`` and ``_collapsed``
replace columns of those names. A text is held whole by one task, in some ten arrays with an entry for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from skyledger.llm.common import table, text_slices
from skyledger.llm.words import SPACE, Words, mix, powers, window_hashes, words_of

#: A run has at least ``MIN_WORDS`` words and ``MIN_PERIODS`` periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Longest period that is searched by comparing words at that distance.
SHORT = 8
RUNS, COLLAPSED = "_runs", "_collapsed"
RUN_TYPE = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def word_numbers(words: Words) -> np.ndarray:
    """A number for each word, equal for equal words."""
    sizes = words.end - words.start
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    packed = words.data[~SPACE[words.data]]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64) if len(sizes) else np.empty(0, np.int64)


def joined(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts with a number of its own after each text, and where each text begins."""
    texts = len(first) - 1
    out = np.empty(len(numbers) + texts, np.int64)
    ends = first[1:] + np.arange(texts)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = numbers
    out[ends] = -1 - np.arange(texts)
    return out, first[:-1] + np.arange(texts)


def sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """The least (or greatest) of each run of ``width`` values."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = least(values[:-step], values[step:])
        reach += step
    return values


def lag_runs(numbers: np.ndarray, longest: int = SHORT) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Starts and ends of the runs of each period up to ``longest``, by comparing words at that distance."""
    sums: list[np.ndarray] = []
    for q in range(1, min(longest, len(numbers) - 1) + 1):
        same = np.zeros(len(numbers) - q + 2, np.int8)
        same[1:-1] = numbers[q:] == numbers[:-q]
        turns = np.flatnonzero(np.diff(same))
        start, end = turns[::2], turns[1::2] + q
        fits = end - start >= max(MIN_WORDS, MIN_PERIODS * q)
        start, end = start[fits], end[fits]
        smallest = np.ones(len(start), bool)
        for shorter in range(1, q):
            if q % shorter == 0:
                smallest &= sums[shorter - 1][end - shorter] - sums[shorter - 1][start] < end - shorter - start
        yield start[smallest], end[smallest], q
        sums.append(np.concatenate([[0], np.cumsum(same[1:-1], dtype=np.int64)]))


def seeds(hashes: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, and distances in (scale / 2, scale], of neighbours among equal minimizers of ``scale`` words."""
    half = scale // 2
    grams = window_hashes(hashes, scale)
    if len(grams) < half:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = sliding(grams, half, np.minimum)
    padding = np.zeros(half - 1, np.uint64)
    marked = np.flatnonzero(sliding(np.concatenate([padding, least, padding]), half, np.maximum) == grams)
    order = marked[np.argsort(grams[marked], kind="stable")]
    distance = np.diff(order)
    pairs = np.flatnonzero((grams[order[1:]] == grams[order[:-1]]) & (distance > half) & (distance <= scale))
    return order[pairs], distance[pairs]


class Extender:
    """How far two places of a sequence agree, to either side."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(_BASE, len(hashes)), dtype=np.uint64)])
        self.back = powers(_BASE_INVERSE, len(hashes) + 1)

    def _hash(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (self.sums[last] - self.sums[first]) * self.back[first]

    def _search(self, most: np.ndarray, agree) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = agree(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def right(self, place: np.ndarray, lag: np.ndarray) -> np.ndarray:
        return self._search(len(self.sums) - 1 - place - lag, lambda n: self._hash(place, place + n) == self._hash(place + lag, place + lag + n))

    def left(self, place: np.ndarray, lag: np.ndarray) -> np.ndarray:
        return self._search(place, lambda n: self._hash(place - n, place) == self._hash(place + lag - n, place + lag))


def _exact(numbers: np.ndarray, start: int, end: int, lag: int, place: int) -> tuple[int, int]:
    """The stretch around ``place`` whose words recur ``lag`` on, at most from ``start`` to ``end``, compared word by word."""
    same = numbers[start:end - lag] == numbers[start + lag:end]
    if same.all():
        return start, end
    differ = np.flatnonzero(~same) + start
    at = np.searchsorted(differ, place)
    return (int(differ[at - 1]) + 1 if at else start), (int(differ[at]) + lag if at < len(differ) else end)


def _has_period(numbers: np.ndarray, start: int, lag: int, period: int) -> bool:
    """Whether a stretch with period ``lag``, of two of them at least, has the smaller period too, a divisor of ``lag``."""
    return bool((numbers[start:start + lag] == numbers[start + period:start + period + lag]).all())


def _divided(n: int) -> list[int]:
    """``n`` divided by each of its prime factors."""
    out, rest, factor = [], n, 2
    while factor * factor <= rest:
        if rest % factor == 0:
            out.append(n // factor)
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return out + ([n // rest] if rest > 1 else [])


def seeded_runs(numbers: np.ndarray, scale: int) -> list[tuple[int, int, int]]:
    """Start, end and period of the runs whose period is in (scale / 2, scale]."""
    hashes = mix(numbers.view(np.uint64) + _BASE)
    place, lag = seeds(hashes, scale)
    if not len(place):
        return []
    extend = Extender(hashes)
    left, right = extend.left(place, lag), extend.right(place, lag)
    enough = left + right + lag >= MIN_PERIODS * lag
    found, spans = set(), np.unique(np.stack([place - left, place + right + lag, lag])[:, enough], axis=1, return_index=True)
    for (start, end, q), at in zip(spans[0].T.tolist(), np.flatnonzero(enough)[spans[1]].tolist()):
        start, end = _exact(numbers, start, end, q, int(place[at]))
        if end - start >= MIN_PERIODS * q and not any(_has_period(numbers, start, q, p) for p in _divided(q)):
            found.add((start, end, q))
    return sorted(found)


def block_runs(texts: pa.Array) -> tuple[Words, list[list[tuple[int, int, int]]]]:
    """The words of a block of texts, and for each text its runs as (start, length, period), by start, then period."""
    words = words_of(texts)
    numbers, begins = joined(word_numbers(words), words.first)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(begins))]

    def add(starts, begin_of: np.ndarray, text_of: np.ndarray) -> None:
        for start, end, q in starts:
            at = int(np.searchsorted(begin_of, start, side="right")) - 1
            out[text_of[at]].append((start - int(begin_of[at]), end - start, q))

    everything = np.arange(len(begins))
    for start, end, q in lag_runs(numbers):
        add(zip(start.tolist(), end.tolist(), [q] * len(start)), begins, everything)
    scale, count = 2 * SHORT, words.count
    while (long := np.flatnonzero(count >= MIN_PERIODS * (scale // 2 + 1))).size:
        if len(long) < len(count):
            keep = np.repeat(np.isin(everything, long), count + 1)
            part, first = numbers[keep], np.concatenate([[0], np.cumsum(count[long] + 1)])[:-1]
        else:
            part, first = numbers, begins
        add(seeded_runs(part, scale), first, long)
        scale *= 2
    return words, [sorted(runs) for runs in out]


def dropped(n_words: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks the words that a run covers after its first period."""
    change = np.zeros(n_words + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            words, found = block_runs(part.column("text"))
            kept = []
            for row, text in enumerate(part.column("text")):
                tokens = (text.as_py() or "").encode().split()
                if found[row]:
                    gone = dropped(len(tokens), found[row])
                    tokens = [t for t, g in zip(tokens, gone) if not g]
                kept.append(b" ".join(tokens).decode())
            spans = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), pa.array(kept, pa.string())], [*part.schema.names, RUNS, COLLAPSED])


def collapsed(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column ``text``), the runs of each text by start and period, and the words left when each run keeps its first period, joined by one blank."""
    own = docs.drop(RUNS, COLLAPSED)
    return own.mapInArrow(_collapse, StructType([*own.schema.fields]).add(RUNS, ArrayType(RUN_TYPE)).add(COLLAPSED, StringType()))


def _with_planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The query's input: in one text of ten, by the id's hash, the words from one place on become a repeated phrase."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for row, number in enumerate(batch.column("doc_id").to_pylist()):
            code = None if number is None else crc32(str(number).encode())
            words = texts[row].encode().split() if texts[row] and code is not None and code % 10 == 0 else []
            if words:
                rest, n = code // 10, len(words)
                at = rest % n
                phrase = words[at:at + 1 + (n - at) // (3 + rest % 8)]
                texts[row] = b" ".join(words[:at] + (phrase * -(-(n - at) // len(phrase)))[:n - at]).decode()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that are null have no planted phrase."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = collapsed(docs.mapInArrow(_with_planted, "doc_id long, text string"))
    # Of two runs, the greater exponent is decided by products of integers; ties keep the one that comes first.
    best = F.reduce(RUNS, F.lit(None).cast(RUN_TYPE), lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.concat(F.lit(""), F.array_join(F.transform(RUNS, lambda r: F.concat(F.concat_ws(",", *[r[f].cast("string") for f in RUN_TYPE.names]), F.lit("\n"))), ""))
    rows = found.withColumn("best", best).select(
        "doc_id", F.size(RUNS).cast("long").alias("n_runs"), *[F.col(f"best.{f}").alias(f) for f in RUN_TYPE.names],
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col(COLLAPSED).cast("binary"), 256).alias("collapsed_sha256"))
    return rows.withColumn("exponent_milli", F.expr("(1000 * length) div period"))
