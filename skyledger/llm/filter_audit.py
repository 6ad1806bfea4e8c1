r"""Audit of how quality filters interact, over every order in which they can be applied.

Each document has a mask of the filters it fails. A mask maps to big integers with one field for each step of each order,
600 for five filters: whether the document is kept after the step, removed by it, redundant (fails, but is gone), or
fails nothing else. Documents are counted by (part, mask, labels) in map tasks first; a part's integers, each times
its count, are then summed, and the fields of the sums are the answers for all orders at once. A field has 64 bits and every
count fits a ``long``, so no field runs into the next.

Texts are compared by SHA-256 over the whole table. A document whose text a smaller doc_id has fails the last filter.

Defined cases: a null text is empty; a null source is the part named by the empty string; a null doc_id is
smaller than none, has no smaller one and has no label; rows that repeat the smallest doc_id of a text all pass; of several
labels of one doc_id the largest counts, a null label is none; an empty table has no parts and gives no rows. Only
doc_id, source and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import stage, table, text_slices
from skyledger.llm.words import texts_buffer, words_of

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
MARKS = b"#$%&*|"
FIELD_BYTES = 8
#: What is counted: the field of a step, from the mask, the bit of its filter and the bits of the filters before it.
OUTCOMES = {
    "kept": lambda mask, own, before: not mask & (before | own),
    "removed": lambda mask, own, before: bool(mask & own) and not mask & before,
    "redundant": lambda mask, own, before: bool(mask & own) and bool(mask & before),
    "unique_fails": lambda mask, own, before: mask == own,
}
#: Counts over rows with one label; ``removed`` is their outcome.
LOSSES = {"good_lost": "good", "toxic_lost": "toxic"}
COUNTS = [*OUTCOMES, *LOSSES, "shapley"]

_UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
_MARK = np.isin(np.arange(256), list(MARKS))
_STARTS = (np.arange(256) & 0xC0) != 0x80
FACTS = "doc_id long, part string, text_hash binary, mask int"
AUDIT = f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}"


def distinct_in_text(keys: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """How many different keys each text has."""
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return np.bincount(of[new], minlength=texts)


def text_masks(texts: pa.Array) -> np.ndarray:
    """The bits of the filters that each text fails by itself: all but the last."""
    words = words_of(texts)
    data, at = texts_buffer(texts)

    def per_text(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks)])
        return sums[at[1:]] - sums[at[:-1]]

    n = words.count
    fails = [
        n < MIN_WORDS, 100 * distinct_in_text(words.hashes(), words.text_of(), len(n)) < DISTINCT_PERCENT * n,
        100 * per_text(_UPPER[data]) > UPPER_PERCENT * per_text(_STARTS[data]), per_text(_MARK[data]) > 0]
    return sum(f.astype(np.int32) << bit for bit, f in enumerate(fails))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            keep = [part.column(c) for c in ("doc_id", "part", "text_hash")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(text_masks(part.column("text")), pa.int32())], ["doc_id", "part", "text_hash", "mask"])


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, text_hash, mask without the last filter, n: equal rows are one, ``n`` their number."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_hash"), text.alias("text"))
    return stage(rows.mapInArrow(_facts, FACTS).groupBy("doc_id", "part", "text_hash", "mask").agg(F.count("*").alias("n")), "audit-facts")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``; rows without an id skip the join, so they make no hot key."""
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    known = rows.where("doc_id is not null").join(marked.where("is_good or is_toxic"), F.col("doc_id") == F.col("of"), "left")
    none = rows.where("doc_id is null").select("*", *[F.lit(None).cast("boolean").alias(c) for c in ("is_good", "is_toxic")])
    return known.drop("of").unionByName(none).select(*rows.columns, F.coalesce("is_good", F.lit(False)).alias("good"), F.coalesce("is_toxic", F.lit(False)).alias("toxic"))


def counted(rows: DataFrame) -> DataFrame:
    """part, mask with the last filter, good, toxic, n.

    Rows of one text are first counted by part and labels in the map tasks, together with their smallest id and its number of
    rows. What meets for one text is so at most four rows for each part, however many documents share it.
    """
    own = ["text_hash", "part", "mask", "good", "toxic"]
    alike = rows.groupBy(*own).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("first_n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("none_n"))
    alike = stage(alike, "audit-texts")
    least = alike.groupBy(F.col("text_hash").alias("of")).agg(F.min("first").alias("least"))
    passes = F.coalesce("none_n", F.lit(0)) + F.when(F.col("first") == F.col("least"), F.col("first_n")).otherwise(0)
    last = F.lit(1 << FILTERS.index("E"))
    both = F.array(F.struct(F.col("mask").alias("mask"), passes.alias("n")), F.struct(F.col("mask").bitwiseOR(last).alias("mask"), (F.col("n") - passes).alias("n")))
    split = alike.join(least, F.col("text_hash") == F.col("of")).select("part", "good", "toxic", F.explode(both).alias("one")).where("one.n > 0")
    return split.groupBy("part", F.col("one.mask").alias("mask"), "good", "toxic").agg(F.sum("one.n").alias("n"))


def steps() -> list[tuple[str, int, int, int]]:
    """Order, step, bit of the step's filter and bits of the filters before, in the order of the fields."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for number, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            out.append((order, number, own, before))
            before |= own
    return out


def packed(outcome: str) -> list[int]:
    """For each mask the integer whose fields hold the outcome of all steps."""
    plan = steps()
    return [sum(1 << 8 * FIELD_BYTES * field for field, (_, _, own, before) in enumerate(plan) if OUTCOMES[outcome](mask, own, before)) for mask in range(1 << len(FILTERS))]


def unpacked(total: int, fields: int) -> np.ndarray:
    """The fields of a sum of packed integers."""
    return np.frombuffer(total.to_bytes(FIELD_BYTES * fields, "little"), "<i8")


def _audit(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's rows, at most one for each mask and pair of labels."""
    plan, wide = steps(), {name: packed(name) for name in OUTCOMES}
    orders, numbers, own = [p[0] for p in plan], [p[1] for p in plan], np.array([p[2] for p in plan])
    for batch in groups:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            sums = {name: sum(c["n"] * wide[name][c["mask"]] for c in counts) for name in OUTCOMES}
            sums |= {name: sum(c["n"] * wide["removed"][c["mask"]] for c in counts if c[label]) for name, label in LOSSES.items()}
            columns = {name: unpacked(total, len(plan)) for name, total in sums.items()}
            by_filter = np.zeros(1 << len(FILTERS), np.int64)
            np.add.at(by_filter, own, columns["removed"])
            columns["shapley"] = by_filter[own]
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(plan)), "filter_order": pa.array(orders), "step": pa.array(numbers, pa.int32()), **{c: pa.array(columns[c], pa.int64()) for c in COUNTS}})


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step with the counts in ``COUNTS``."""
    parts = counted(with_labels(facts(docs), labels)).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("counts"))
    return parts.mapInArrow(_audit, AUDIT)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return audited(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
least AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
good AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < {MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
    FROM d JOIN least USING (text) LEFT JOIN good USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letter a, letter b, letter c, letter d, letter e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM orders, range(1, 6) AS t(step)),
counted AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN good AND mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN toxic AND mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS toxic_lost
    FROM c, steps GROUP BY ALL)
SELECT part, filter_order, step, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in COUNTS if c != 'shapley')}, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted"""
