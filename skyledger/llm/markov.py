"""A hidden Markov language model trained by Baum-Welch counts that Spark sums over partitions.

Every state has an emission of its own for each of the most frequent words (``TOP_WORDS`` of them, seen ``OWN_TIMES`` at least) and
for the end of a text. All other words are emitted through hash classes, whose number grows with the vocabulary
(``class_count``); a class emits a word by its share of the class's mass: count + 0.5, and for all unknown words of the class
together 0.5 and as much as the class has words seen once. The model so gives every text a true probability; an unknown word is
known by its class alone. ``TOP_WORDS`` and ``MOST_CLASSES`` bound what is sent to a task; the word counts stay a table.

A sequence is cut into segments of ``SEGMENT`` tokens. The product of a segment's step matrices is found for all
segments side by side, carried from segment to segment along each text, and the scaled forward and backward recursions
then run inside ``AT_ONCE`` segments at a time. That is the exact recursion, whatever the length of a text, and a long text needs
a few bytes a token besides. An iteration reads all training texts; expected counts are summed in each task, then by Spark, and
the driver gets one row for each emission. Iterations go on until one gains less than ``GAIN`` of the log likelihood.

A word's expected split over the states is drawn to the states' own shares as if by ``DRAW`` more tokens, so that a word seen
twice is not tied to one state.

Words are runs of bytes outside blank, tab, line feed, vertical tab, form feed and carriage return, A-Z lower-cased, and
are counted by a 64-bit hash. Log counts of the frequent words are sent to the tasks; all others are joined.

Defined cases: a null text is empty and has the end as its only token; a null id counts as the empty text in the fold;
repeated rows are learned and scored one by one; without training texts all words are unknown; an empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import fold, numbered_slices, stage, table
from skyledger.llm.words import SPACE, words_of

STATES, SEGMENT, AT_ONCE = 6, 256, 4096
#: A word seen less often says too little about its split over the states.
TOP_WORDS, OWN_TIMES, TASK_WORDS = 200_000, 4, 2_000_000
#: Classes are a power of two, some ``CLASS_WORDS`` distinct words to a class.
CLASS_WORDS, LEAST_CLASSES, MOST_CLASSES = 128, 1024, 1 << 18
#: Training ends when an iteration gains less than this share of the log likelihood, or after so many.
GAIN, ITERATIONS = 0.005, 50
#: Tokens that draw a word's split over the states to the states' shares, and the weight of an even row in the moves.
DRAW, EVEN = 4.0, 1.0
FOLDS, HELD_OUT = 5, 1
TOKENS_SCHEMA = "block long, ids array<long>, held array<boolean>, n_tokens array<long>, known array<long>, logs array<double>, classes binary, rare_first array<long>, rare binary"


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # one row for each frequent word, then for each class, then for the end


class Segments:
    """Sequences of classes cut into segments, longest first, so that a step works on a leading part of them."""

    def __init__(self, classes: np.ndarray, lengths: np.ndarray):
        pieces = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(SEGMENT, lengths[doc] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        self.classes, self.n_docs = classes, len(lengths)
        self.doc, self.nth, self.size = doc[order], nth[order], size[order]
        self.at = (np.cumsum(lengths) - lengths)[self.doc] + self.nth * SEGMENT
        self.active = self._active(self.size)
        self.opens = self.nth == 0
        self.first, self.rest = np.flatnonzero(self.opens), np.flatnonzero(~self.opens)
        self.levels = [np.flatnonzero(self.nth == i) for i in range(int(pieces.max()) if len(pieces) else 0)]

    @staticmethod
    def _active(size: np.ndarray) -> np.ndarray:
        return np.searchsorted(-size, -np.arange(size[0] if len(size) else 0))

    def products(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """The product of a segment's step matrices, scaled, after the start if it opens a text, and the log of the scale."""
        k = len(model.start)
        out, log = np.empty((len(self.doc), k, k)), np.zeros(len(self.doc))
        for pick, begin in ((self.first, model.start[None]), (self.rest, model.move)):
            now, scales, at, r = np.tile(begin, (len(pick), 1, 1)), np.zeros(len(pick)), self.at[pick], len(begin)
            for step, n in enumerate(self._active(self.size[pick])):
                part = now[:n] if step == 0 else (now[:n].reshape(-1, k) @ model.move).reshape(n, r, k)
                now[:n] = part * model.emit[self.classes[at[:n] + step]][:, None, :]
                if step % 8 == 7:
                    scale = now[:n].reshape(n, -1) @ np.ones(r * k)
                    now[:n] /= scale[:, None, None]
                    scales[:n] += np.log(scale)
            out[pick], log[pick] = now, scales  # an opening segment has one row, repeated
        return out, log

    def chain(self, model: Model, products: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state shares before each segment, and each text's log likelihood."""
        now, before = np.tile(model.start, (self.n_docs, 1)), np.empty((len(self.doc), len(model.start)))
        total = np.zeros(self.n_docs)
        for number, level in enumerate(self.levels):
            doc = self.doc[level]
            before[level] = now[doc]
            after = np.einsum("dk,dkl->dl", now[doc], products[level]) if number else products[level, 0]
            scale = after.sum(axis=1)
            now[doc] = after / scale[:, None]
            total[doc] += np.log(scale) + log[level]
        return before, total

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts of starts, moves and emitted classes, and the log likelihood."""
        products, log = self.products(model)
        before, total = self.chain(model, products, log)
        k = len(model.start)
        after, later = np.ones((len(self.doc), k)), np.ones((self.n_docs, k))
        for number in reversed(range(len(self.levels))):
            level = self.levels[number]
            doc = self.doc[level]
            after[level] = later[doc]
            if number:
                back = np.einsum("dkl,dl->dk", products[level], later[doc])
                later[doc] = back / back.sum(axis=1, keepdims=True)
        starts, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
        for low in range(0, len(self.doc), AT_ONCE):
            part = slice(low, low + AT_ONCE)
            self._inside(model, low, before[part], after[part], starts, moves, emitted)
        return starts, moves * model.move, emitted, float(total.sum())

    def _inside(self, model: Model, low: int, before: np.ndarray, after: np.ndarray, starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray) -> None:
        """Add the counts of the segments from ``low`` on, given the state shares before and the weights after each; a state is a row here."""
        active = np.clip(self.active - low, 0, len(before))
        active, opens, at = active[active > 0], self.opens[low:low + len(before)], self.at[low:low + len(before)]
        symbols = [self.classes[at[:n] + step] for step, n in enumerate(active)]
        emit, move, before, after = np.ascontiguousarray(model.emit.T), model.move, np.ascontiguousarray(before.T), np.ascontiguousarray(after.T)
        likely = [emit.take(s, axis=1) for s in symbols]
        forward: list[np.ndarray] = []
        for step, n in enumerate(active):
            prior = np.where(opens[:n], model.start[:, None], move.T @ before[:, :n]) if step == 0 else move.T @ forward[-1][:, :n]
            prior *= likely[step]
            prior /= prior.sum(axis=0)
            forward.append(prior)
        for step in range(len(active) - 1, -1, -1):
            n = active[step]
            share = forward[step] * after[:, :n]
            share /= share.sum(axis=0)
            ahead = likely[step] * after[:, :n]
            back = move @ ahead
            last = forward[step - 1][:, :n] if step else before[:, :n]
            ahead /= (last * back).sum(axis=0)
            if not step:
                ahead[:, opens[:n]] = 0.0
            moves += last @ ahead.T
            back /= back.sum(axis=0)
            after[:, :n] = back
            forward[step] = share
        starts += forward[0][:, opens[:active[0]]].sum(axis=1)
        owners = np.concatenate(symbols)
        for i in range(emitted.shape[1]):
            emitted[:, i] += np.bincount(owners, weights=np.concatenate([f[i] for f in forward]), minlength=len(emitted))


def _words(part: pa.RecordBatch):
    return words_of(part.column("text"), SPACE, lower=True)


def word_counts(training: DataFrame) -> DataFrame:
    """word (hash), n over all rows of ``training``; counts meet in each task before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            value, count = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(value)
            value, count = value[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            return value[first], np.add.reduceat(count, first)

        for _, part in numbered_slices(batches):
            value = _words(part).hashes()
            if len(value):
                held.append(np.unique(value, return_counts=True))
            if sum(len(v) for v, _ in held) > TASK_WORDS:
                held = [merged()]
                if len(held[0][0]) > TASK_WORDS // 2:
                    yield _pairs(*held.pop())
        if held:
            yield _pairs(*merged())

    return stage(training.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _pairs(value: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(value.view(np.int64)), "n": pa.array(count.astype(np.int64))})


@dataclass
class Top:
    words: np.ndarray
    logs: np.ndarray
    n_texts: int
    classes: int


def class_count(distinct: int) -> int:
    wanted = 1 << max(-(-distinct // CLASS_WORDS) - 1, 0).bit_length()
    return min(max(wanted, LEAST_CLASSES), MOST_CLASSES)


def _classes(value: np.ndarray, classes: int) -> np.ndarray:
    return ((value >> np.uint64(40)) & np.uint64(classes - 1)).astype(np.int64)


def _encode(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Emission sequences, the log counts of frequent words, and the other words of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for block, part in numbered_slices(batches):
            words = _words(part)
            value, of, n = words.hashes(), words.text_of(), part.num_rows
            at = np.minimum(np.searchsorted(top.words, value), max(len(top.words) - 1, 0))
            frequent = top.words[at] == value if len(top.words) else np.zeros(len(value), bool)
            known = np.bincount(of[frequent], minlength=n) + (top.n_texts > 0)
            logs = np.bincount(of[frequent], weights=top.logs[at[frequent]] if len(top.words) else None, minlength=n).astype(float)
            emissions = np.where(frequent, at, len(top.words) + _classes(value, top.classes)).astype(np.uint32)
            emissions = np.insert(emissions, words.first[1:], len(top.words) + top.classes)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "ids": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), "held": pa.array([part.column("held").to_pylist()], pa.list_(pa.bool_())),
                "n_tokens": pa.array([words.count + 1], pa.list_(pa.int64())), "known": pa.array([known], pa.list_(pa.int64())), "logs": pa.array([logs], pa.list_(pa.float64())),
                "classes": pa.array([zlib.compress(emissions.tobytes(), 1)], pa.binary()),
                "rare_first": pa.array([np.searchsorted(of[~frequent], np.arange(n + 1))], pa.list_(pa.int64())), "rare": pa.array([value[~frequent].tobytes()], pa.binary())})

    return run


def _sequences(row: dict, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    classes, lengths = np.frombuffer(zlib.decompress(row["classes"]), np.uint32), np.array(row["n_tokens"], np.int64)
    if keep is None:
        return classes, lengths
    return classes[np.repeat(keep, lengths)], lengths[keep]


def _expect(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over a task's texts, as 32-bit floats: a row for each emission, then starts, moves and the log likelihood."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.start)
        starts, moves, emitted, total = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), 0.0
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                classes, lengths = _sequences(one, ~np.array(one["held"], bool))
                if len(lengths):
                    a, b, c, d = Segments(classes, lengths).expected(model)
                    starts, moves, emitted, total = starts + a, moves + b, emitted + c, total + d
        used = np.flatnonzero(emitted.sum(axis=1))
        key = np.concatenate([used, [-1], -2 - np.arange(k), [-2 - k]])
        rows = np.concatenate([emitted[used], starts[None], moves, np.full((1, k), total)])
        for low in range(0, len(key), 65_536):
            part = slice(low, low + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array(key[part].astype(np.int32)), *[pa.array(rows[part, i].astype(np.float32)) for i in range(k)]], ["key", *[f"s{i}" for i in range(k)]])

    return run


def first_model(shares: np.ndarray, states: int = STATES) -> Model:
    """Sticky moves, and unigram shares bent by fixed noise so that the states can part."""
    noise = np.exp(np.random.Generator(np.random.PCG64(7)).normal(0, 0.7, (len(shares), states)))
    emit = shares[:, None] * noise
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def next_model(starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray, shares: np.ndarray) -> Model:
    states = emitted.sum(axis=0) / emitted.sum()
    emit = shares[:, None] * (emitted + DRAW * states) / (emitted.sum(axis=1, keepdims=True) + DRAW)
    start, move = starts + EVEN / len(starts), moves + EVEN / len(starts)
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(tokens: DataFrame, shares: np.ndarray, gain: float = GAIN, iterations: int = ITERATIONS) -> tuple[Model, list[float]]:
    """The model learned from all training texts, and the log likelihood before each iteration."""
    model, history = first_model(shares), []
    k = len(model.start)
    for _ in range(iterations):
        shared = tokens.sparkSession.sparkContext.broadcast(model)
        partial = tokens.select("held", "n_tokens", "classes").mapInArrow(_expect(shared), ", ".join(["key int", *[f"s{i} float" for i in range(k)]]))
        found = partial.groupBy("key").agg(*[F.sum(F.col(f"s{i}").cast("double")).alias(f"s{i}") for i in range(k)]).toArrow()  # a row for each emission and a few
        shared.unpersist()
        key, rows = found["key"].to_numpy(), np.column_stack([found[f"s{i}"].to_numpy() for i in range(k)]) if found.num_rows else np.empty((0, k))
        emitted = np.zeros(model.emit.shape)
        emitted[key[key >= 0]] = rows[key >= 0]
        if not len(key) or not emitted.sum():
            break
        place = {int(x): rows[i] for i, x in zip(np.flatnonzero(key < 0), key[key < 0])}
        history.append(float(place[-2 - k][0]))
        model = next_model(place[-1], np.array([place[-2 - i] for i in range(k)]), emitted, shares)
        if len(history) > 1 and history[-1] - history[-2] < gain * abs(history[-2]):
            break
    return model, history


def _likelihood(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mass = shared.value
        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                classes, lengths = _sequences(row)
                segments, n = Segments(classes, lengths), len(lengths)
                _, log = segments.chain(model, *segments.products(model))
                within = np.add.reduceat(mass[classes], np.cumsum(lengths) - lengths) if n else np.empty(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths),
                     pa.array(row["known"], pa.int64()), pa.array(row["logs"], pa.float64()), pa.array(log / np.log(10) - within)],
                    ["block", "row", "doc_id", "held_out", "n_tokens", "known", "logs", "classed"])

    return run


def _rare(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each word that is not frequent, with what it adds to a text's score if it is unknown."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown = shared.value  # one for each class
        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                value, first = np.frombuffer(row["rare"], np.uint64), np.array(row["rare_first"])
                of = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(len(value), row["block"])), "row": pa.array(of), "rare_word": pa.array(value.view(np.int64)), "if_unknown": pa.array(unknown[_classes(value, len(unknown))])})

    return run


def scored(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; learned from the rows outside ``held_out``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held"), "text")
    counts = word_counts(rows.where("not held"))
    n_texts = rows.where("not held").count()
    summary = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    distinct, total = summary[0] + (n_texts > 0), summary[1] + n_texts
    top = counts.where(F.col("n") >= OWN_TIMES).orderBy(F.desc("n"), "word").limit(TOP_WORDS).toArrow()  # at most TOP_WORDS rows
    words = top["word"].to_numpy().astype(np.int64).view(np.uint64)
    order, n_classes = np.argsort(words), class_count(distinct)
    held = Top(words[order], np.log10(top["n"].to_numpy()[order] + 0.5), n_texts, n_classes)
    own = len(held.words)
    # Classes hold what is not among the frequent words. ``word`` holds the unsigned hash's bits; the class is bits 40 and on of them.
    in_class = F.shiftrightunsigned("word", 40).bitwiseAND(F.lit(n_classes - 1))
    by_class = counts.groupBy(in_class.alias("class")).agg(F.sum(F.col("n") + 0.5).alias("mass"), F.count_if(F.col("n") == 1).alias("once")).toArrow()
    unseen, mass = np.full(n_classes, 0.5), np.zeros(own + n_classes + 1)
    unseen[by_class["class"].to_numpy()] += by_class["once"].to_numpy()
    mass[:own] = top["n"].to_numpy()[order] + 0.5
    mass[own + by_class["class"].to_numpy()] = by_class["mass"].to_numpy()
    mass[own:-1] += unseen - np.bincount(_classes(held.words, n_classes), weights=mass[:own], minlength=n_classes)
    mass[-1] = n_texts + 0.5
    tokens = stage(rows.mapInArrow(_encode(spark.sparkContext.broadcast(held)), TOKENS_SCHEMA), "tokens")
    model, _ = train(tokens, mass / mass.sum())
    within = np.log10(mass)
    within[:own] = within[-1] = 0.0
    likely = tokens.select("block", "ids", "held", "n_tokens", "known", "logs", "classes").mapInArrow(
        _likelihood(spark.sparkContext.broadcast((model, within))), "block long, row int, doc_id long, held_out boolean, n_tokens long, known long, logs double, classed double")
    rare = tokens.select("block", "rare_first", "rare").mapInArrow(_rare(spark.sparkContext.broadcast(np.log10(unseen))), "block long, row int, rare_word long, if_unknown double")
    joined = rare.join(counts, F.col("rare_word") == F.col("word"), "left")
    rare_sums = joined.groupBy(F.col("block").alias("b"), F.col("row").alias("r")).agg(
        F.count("n").alias("rare_known"), F.sum(F.log10(F.col("n") + 0.5)).alias("rare_logs"), F.sum(F.when(F.col("n").isNull(), F.col("if_unknown"))).alias("unknown_logs"))
    every = likely.join(rare_sums, (F.col("block") == F.col("b")) & (F.col("row") == F.col("r")), "left")
    known = F.col("known") + F.coalesce("rare_known", F.lit(0))
    word_logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    unknown = F.col("n_tokens") - known
    end_log = float(np.log10(n_texts + 0.5))
    base = word_logs + unknown * F.log10(F.lit(0.5)) + (F.lit(end_log) if n_texts else F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + 0.5 * (distinct + 1))))
    score = F.col("classed") + F.coalesce("rare_logs", F.lit(0.0)) + F.coalesce("unknown_logs", F.lit(0.0))
    return every.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents"), fold("doc_id", FOLDS) == HELD_OUT)
