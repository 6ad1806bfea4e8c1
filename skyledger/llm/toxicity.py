"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Terms are words (A-Z lower-cased, letters and digits) and the first four and five bytes of longer words. The examples
are at most ``MAX_EXAMPLES`` labelled documents of each label, those with the smallest id hash, and every term of theirs
is indexed. A term weighs its idf over all documents times sqrt(1 + chi-squared) of its split between the labels, so that
none is lost and words that tell nothing do not drown the others. Examples have unit length over their whole texts. A
text's own length scales all its similarities alike, so neither order nor vote depends on it, nor on terms that no
example has.

The at most ``DENSE_TERMS`` terms of most examples are rows of a matrix, multiplied for many texts at once. The others are
an inverted index whose postings are cut into blocks of examples, each with the largest weight in it. The matrix alone
gives a lower bound of the least of the ``NEAREST`` similarities; a search bounds every block from above by its largest
weights and reads those that can reach it: nothing is left out, similarities have single precision.

Votes are weighted by similarity and by how many labelled rows an example stands for. The share of toxic votes is
calibrated by the examples themselves, each searched without itself, through a monotone step table.

Defined cases: a null text is empty; a text without a term of any example has no neighbour and gets the toxic share of such
examples; an id with several labels counts as toxic if one of them is 1, a null label or id is left out; without
labels all scores are 0; repeated rows are scored one by one; an empty table gives no rows. Other columns pass by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from skyledger.llm.common import fold, stage, table, text_slices
from skyledger.llm.words import NOT_ALNUM, mix, texts_buffer, words_of

MAX_EXAMPLES = 4000
#: A term of more than one in ``DENSE_SHARE`` examples is a matrix row, for at most so many terms.
DENSE_TERMS, DENSE_SHARE = 2048, 16
PREFIXES = (4, 5)
NEAREST, BLOCK, STEPS = 15, 512, 20
#: Texts that meet the matrix at once.
TEXTS = 128
FOLDS, HELD_OUT = 5, 0
_TAG = np.uint64(0xA24BAED4963EE407)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all texts, and the index of each one's text."""
    words = words_of(texts, NOT_ALNUM, lower=True)
    of = words.text_of()
    (_, whole), *cuts = words.cut_hashes((0, *PREFIXES))
    return np.concatenate([whole, *(mix(x ^ _TAG) for _, x in cuts)]), np.concatenate([of, *(of[long] for long, _ in cuts)])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            value, _ = terms_of(pa.concat_arrays([batch.column("text").slice(row, 1)]))
            seen, count = np.unique(value, return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "example": batch.column("example").slice(row, 1), "terms": pa.array([seen.tobytes()], pa.binary()), "n": pa.array([count.astype(np.int32).tobytes()], pa.binary())})


class Places:
    """Where hashes are among sorted distinct ``terms``: the first bits of a hash name a short run of terms that is looked through."""

    def __init__(self, terms: np.ndarray):
        self.terms, bits = terms, len(terms).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.opens = np.append(np.searchsorted(terms, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(terms)).astype(np.int32)

    def of(self, value: np.ndarray) -> np.ndarray:
        """The place of each value, -1 if it is no term."""
        run = (value >> self.shift).astype(np.int32)
        at, last, left = self.opens[run], self.opens[run + 1], None
        place = np.full(len(value), -1, np.int32)
        while True:
            more = np.flatnonzero(at < last)
            if not len(more):
                return place
            at, last, value, left = at[more], last[more], value[more], more if left is None else left[more]
            hit = self.terms[at] == value
            place[left[hit]] = at[hit]
            at, last = at + 1, np.where(hit, 0, last)


def _known(places: Places, value: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term number and count of the indexed terms of each text."""
    place = places.of(value)
    known = place >= 0
    pairs, count = np.unique(of[known] * len(places.terms) + place[known], return_counts=True)
    return *np.divmod(pairs, max(len(places.terms), 1)), count


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """How many rows of ``docs`` hold each of ``terms``, and how many rows there are."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, held = Places(shared.value), np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            held[-1] += batch.num_rows
            for part in text_slices(batch):
                if len(shared.value):
                    held[:-1] += np.bincount(_known(places, *terms_of(part.column("text")))[1], minlength=len(shared.value))
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": pa.array(used.astype(np.int64)), "n": pa.array(held[used])})

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the examples
    out = np.zeros(len(terms) + 1, np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out[:-1], int(out[-1])


@dataclass
class Index:
    """Examples in blocks; postings sorted by (term, example). ``idf`` has all of a term's weight.

    Only the postings are sent to the tasks. What is made from them there: the places of the terms, the matrix rows of
    frequent ones, and the cells of all others, one for each term and block.
    """

    terms: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    held: np.ndarray  # postings of each term
    example: np.ndarray
    weight: np.ndarray
    prior: float = 0.0
    edges: np.ndarray = field(default_factory=lambda: np.empty(0))
    levels: np.ndarray = field(default_factory=lambda: np.empty(0))

    def prepared(self) -> Index:
        """With the places, the matrix and the cells."""
        if hasattr(self, "dense"):
            return self
        self.places = Places(self.terms)
        often = np.argsort(-self.held, kind="stable")[:DENSE_TERMS]
        often = often[self.held[often].astype(np.int64) * DENSE_SHARE > len(self.ids)]
        self.dense_row, dense = np.full(len(self.terms), -1, np.int32), np.zeros((len(often), len(self.ids)), np.float32)
        self.dense_row[often] = np.arange(len(often))
        row = np.repeat(self.dense_row, self.held)
        thin = row < 0
        dense[row[~thin], self.example[~thin]] = self.weight[~thin]
        self.thin_example, self.thin_weight = self.example[thin], self.weight[thin]
        term, block = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.held)[thin], self.thin_example.astype(np.int32) // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        opens = np.flatnonzero(new)
        self.term_cells = np.searchsorted(term[opens], np.arange(len(self.terms) + 1)).astype(np.int32)
        self.cell_block, self.cell_first = block[opens], np.append(opens, len(term)).astype(np.int32)
        self.cell_most = np.maximum.reduceat(self.thin_weight, opens) if len(opens) else np.empty(0, np.float32)
        self.dense = dense
        return self

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place of each text's terms, term numbers, unit weights."""
        value, of = terms_of(texts)
        n = len(texts)
        if not len(self.terms):
            return np.zeros(n + 1, np.int64), np.empty(0, np.int64), np.empty(0)
        text, term, count = _known(self.prepared().places, value, of)
        weight = (1 + np.log(count)) * self.idf[term]
        length = np.sqrt(np.bincount(text, weights=weight * weight, minlength=n))
        return np.searchsorted(text, np.arange(n + 1)), term, weight / length[text]

    def searched(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, leave_out: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text of ``vectors`` the numbers and similarities of the nearest examples, best first, ties to the lower number."""
        self.prepared()
        for low in range(0, len(first) - 1, TEXTS):
            high = min(low + TEXTS, len(first) - 1)
            at = slice(first[low], first[high])
            text = np.repeat(np.arange(high - low), np.diff(first[low:high + 1]))
            yield from self._nearest(text, term[at], weight[at], high - low, None if leave_out is None else leave_out[low:high])

    def nearest(self, term: np.ndarray, weight: np.ndarray, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The same for one text."""
        return next(iter(self.prepared()._nearest(np.zeros(len(term), np.int64), term, weight, 1, np.array([leave_out]))))

    def _nearest(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int, leave_out: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What the matrix gives is a lower bound of each similarity, so the best of it rule out blocks before any posting is read."""
        if not len(self.ids):
            yield from ((np.empty(0, np.int64), np.empty(0)) for _ in range(texts))
            return
        row = self.dense_row[term]
        asked = np.zeros((texts, len(self.dense)), np.float32)
        asked[text[row >= 0], row[row >= 0]] = weight[row >= 0]
        n, blocks = len(self.ids), -(-len(self.ids) // BLOCK)
        total = np.zeros((texts, blocks * BLOCK), np.float32)
        total[:, :n] = asked @ self.dense
        if leave_out is not None:
            out = np.flatnonzero(leave_out >= 0)
            total[out, leave_out[out]] = -np.inf
        floor = np.maximum(np.partition(total, -NEAREST, axis=1)[:, -NEAREST], 0) - 1e-5 if total.shape[1] >= NEAREST else np.zeros(texts)
        text, term, weight = text[row < 0], term[row < 0], weight[row < 0].astype(np.float32)
        cells, of = _ranges(self.term_cells[term], self.term_cells[term + 1])
        most = np.maximum(total.reshape(texts, blocks, BLOCK).max(2), 0)
        bound = np.bincount(text[of] * blocks + self.cell_block[cells], weights=self.cell_most[cells] * weight[of], minlength=texts * blocks).reshape(texts, blocks) + most
        open_ = (bound > 0) & (bound >= floor[:, None])
        first, first_cell = np.searchsorted(text, np.arange(texts + 1)), np.searchsorted(text[of], np.arange(texts + 1))
        for i in range(texts):
            at = slice(first_cell[i], first_cell[i + 1])
            self._read(total[i], term[first[i]:first[i + 1]], weight[first[i]:first[i + 1]], cells[at], weight[of[at]], open_[i])
            # Whatever is below the floor is none of the nearest; closed blocks hold nothing above it.
            near = np.flatnonzero((total[i, :n] >= floor[i]) & (total[i, :n] > 0))
            found = np.round(total[i, near], 6)
            if len(near) > NEAREST:
                enough = found >= np.partition(found, -NEAREST)[-NEAREST]
                near, found = near[enough], found[enough]
            best = np.lexsort((near, -found))[:NEAREST]
            yield near[best], found[best].astype(np.float64)

    def _read(self, total: np.ndarray, term: np.ndarray, weight: np.ndarray, cells: np.ndarray, share: np.ndarray, open_: np.ndarray) -> None:
        """Add a text's postings in the open blocks to ``total``: cell by cell, or all of each term where most blocks are open,
        as then one run of postings for each term is read faster."""
        if 2 * open_.sum() >= len(open_):
            first = self.cell_first[self.term_cells[term]]
            size = self.cell_first[self.term_cells[term + 1]] - first
            place = np.arange(size.sum())
            place += np.repeat(first - np.cumsum(size) + size, size)
            at, held = self.thin_example[place], self.thin_weight[place]
            held *= np.repeat(weight, size)
        else:
            use = open_[self.cell_block[cells]]
            cells, share = cells[use], share[use]
            place, of = _ranges(self.cell_first[cells], self.cell_first[cells + 1])
            at, held = self.thin_example[place], self.thin_weight[place] * share[of]
        total += np.bincount(at, weights=held, minlength=len(total))

    def vote(self, near: np.ndarray, found: np.ndarray) -> float:
        share = found * self.votes[near]
        return float(share[self.labels[near] == 1].sum() / share.sum())

    def calibrated(self, raw: float) -> float:
        return float(self.levels[np.searchsorted(self.edges, raw, side="right")]) if len(self.levels) else raw


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``first[i]:last[i]``, and the range of each."""
    size = last - first
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of], of


def build_index(vectors: pa.Table, terms: np.ndarray, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, votes: np.ndarray) -> Index:
    """``vectors``: example, term (their numbers), weight. Examples with like terms get neighbouring numbers, so that blocks differ."""
    example, term, weight = (vectors[c].to_numpy() for c in ("example", "term", "weight"))
    lead = np.full(len(ids), len(terms))
    strongest = np.lexsort((term, -weight, example))
    seen, first = np.unique(example[strongest], return_index=True)
    lead[seen] = term[strongest[first]]
    del strongest
    order = np.lexsort((ids, lead, labels))
    number = np.empty(len(ids), np.int32)
    number[order] = np.arange(len(ids))
    example = number[example]
    length = np.sqrt(np.bincount(example, weights=weight * weight, minlength=len(ids)))
    weight = (weight / length[example]).astype(np.float32)
    sort = np.lexsort((example, term))
    return Index(terms, idf, ids[order], labels[order], votes[order], np.bincount(term, minlength=len(terms)).astype(np.int32),
                 example[sort].astype(np.min_scalar_type(max(len(ids), 1))), weight[sort])


def monotone(raw: np.ndarray, label: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner borders and levels of a rising step table of the toxic share, smoothed by one vote of the overall share."""
    step = np.minimum((raw * STEPS).astype(int), STEPS - 1)
    all_votes, toxic = (np.bincount(step, weights=w, minlength=STEPS) for w in (votes, votes * label))
    overall = toxic.sum() / max(all_votes.sum(), 1e-9)
    pools: list[list[float]] = []
    for i in range(STEPS):
        pools.append([toxic[i], all_votes[i], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t, a, n = pools.pop()
            pools[-1] = [pools[-1][0] + t, pools[-1][1] + a, pools[-1][2] + n]
    levels = np.concatenate([np.full(int(n), (t + overall) / (a + 1)) for t, a, n in pools])
    return np.arange(1, STEPS) / STEPS, levels


def chi_squared(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Of each term: ``a`` of the ``n1`` toxic and ``b`` of the ``n0`` other examples hold it."""
    return (a * (n0 - b) - b * (n1 - a)) ** 2 * float(n0 + n1) / ((a + b) * (n0 + n1 - a - b) * float(max(n1, 1)) * float(max(n0, 1)) + 1e-9)


def learn(docs: DataFrame, labels: DataFrame) -> Index:
    """Index and calibration from the labelled rows of ``docs`` outside the held-out fold."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    usable = marked.where(fold("doc_id", FOLDS) != HELD_OUT).select(F.col("doc_id").alias("of"), (F.col("label") > 0).cast("int").alias("label"))
    present = docs.where("doc_id is not null").select("doc_id").distinct().join(usable, F.col("doc_id") == F.col("of")).select("of", "label")
    present = stage(present, "toxic-labels")
    totals = {r["label"]: r["count"] for r in present.groupBy("label").count().collect()}
    parts = [present.where(F.col("label") == x).orderBy(F.xxhash64("of"), "of").limit(MAX_EXAMPLES) for x in (0, 1)]
    chosen = stage(parts[0].unionByName(parts[1]), "toxic-chosen")  # at most 2 * MAX_EXAMPLES ids, so the broadcast is bounded
    texts = docs.select(F.col("doc_id").cast("long").alias("example"), "text").join(F.broadcast(chosen), F.col("example") == F.col("of"))
    texts = texts.groupBy("example").agg(F.min("text").alias("text"))
    held = texts.mapInArrow(_term_counts, "example long, terms binary, n binary").toArrow()  # at most 2 * MAX_EXAMPLES rows
    roster = chosen.orderBy("of").toArrow()
    ids, label = roster["of"].to_numpy().astype(np.int64), roster["label"].to_numpy()
    taken = np.bincount(label, minlength=2) if len(label) else np.zeros(2, int)
    (value, at), (n, _) = texts_buffer(held["terms"]), texts_buffer(held["n"])
    example = np.repeat(np.searchsorted(ids, held["example"].to_numpy()).astype(np.int32), np.diff(at) // 8)
    terms, term = np.unique(value.view(np.uint64), return_inverse=True)
    term, tf = term.astype(np.int32), 1 + np.log(n.view(np.int32), dtype=np.float32)
    del held, value, n
    df, n_docs = document_frequencies(docs, terms)
    toxic = np.bincount(term, weights=label[example], minlength=len(terms))
    weight_of = (np.log((1 + n_docs) / (1 + df)) + 1) * np.sqrt(1 + chi_squared(toxic, np.bincount(term, minlength=len(terms)) - toxic, *taken[::-1]))
    vectors = pa.table({"example": example, "term": term, "weight": tf * weight_of[term]})
    del example, term, tf
    votes = np.array([totals.get(int(x), 0) / max(taken[x], 1) for x in label], float)
    index = build_index(vectors, terms, weight_of, ids, label, votes)
    del vectors
    _calibrate(index, texts)
    return index


def _calibrate(index: Index, texts: DataFrame) -> None:
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        number = {int(x): i for i, x in enumerate(known.ids)}
        for batch in batches:
            for part in text_slices(batch):
                leave_out = np.array([number[x] for x in part.column("example").to_pylist()], np.int64)
                raw = [known.vote(near, found) if len(near) else -1.0 for near, found in known.searched(*known.vectors(part.column("text")), leave_out)]
                yield pa.RecordBatch.from_pydict({"example": part.column("example"), "raw": pa.array(raw, pa.float64())})

    found = texts.select("example", "text").mapInArrow(search, "example long, raw double").toArrow()  # at most 2 * MAX_EXAMPLES rows
    shared.destroy()
    at = np.searchsorted(np.sort(index.ids), found["example"].to_numpy()) if found.num_rows else np.empty(0, int)
    number = np.argsort(index.ids)[at]
    raw, label, votes = found["raw"].to_numpy(), index.labels[number], index.votes[number]
    none = raw < 0
    index.prior = float((votes * label)[none].sum() / (votes[none].sum() + 1)) if none.any() else 0.0
    if (~none).any():
        index.edges, index.levels = monotone(raw[~none], label[~none], votes[~none])


def _score(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in text_slices(batch):
                score, evidence = np.full(part.num_rows, index.prior), []
                for row, (near, found) in enumerate(index.searched(*index.vectors(part.column("text")))):
                    if len(near):
                        score[row] = index.calibrated(index.vote(near, found))
                    evidence.append(index.ids[near[:3]].tolist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score), pa.array(evidence, pa.list_(pa.int64()))], [*part.schema.names, "_score", "_evidence"])

    return run


def scored(docs: DataFrame, index: Index) -> DataFrame:
    """``docs`` (with a column ``text``) and ``_score``, ``_evidence``: the ids of the three nearest examples."""
    schema = docs.drop("_score", "_evidence").schema.add("_score", "double").add("_evidence", ArrayType(LongType()))
    return docs.drop("_score", "_evidence").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(index)), schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    index = learn(docs, table(spark, folder, "labels"))
    rows = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    return scored(rows, index).select("doc_id", "held_out", F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_evidence").alias("evidence"))
