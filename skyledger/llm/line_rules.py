r"""Quality rules with cross-document line frequency.

A line is normalised to its words, A-Z lower-cased, joined by one space, and hashed. For each host (here the source)
the documents that hold a line are counted, however often one of them repeats it; copies of a document are documents.
Lines of more than ``LINE_DOCS`` documents, whatever the size of the host, are taken out, and a document is rejected if
too little is left of it.

Defined cases: a null text is empty; a null source is a host of its own; repeated rows are judged one by one and
equally; a line without a word is no line; an empty table gives no rows. Only doc_id, source and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import stage, table, text_slices
from skyledger.llm.words import SPACE, full_windows, mix, run_hash, texts_buffer, window_hashes, words_of

#: A line is above the limit if more documents of its host hold it.
LINE_DOCS = 5
#: What is left of a document must be ``MIN_WORDS`` words, as any document, and this many percent of its words.
LEFT_PERCENT = 30
#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_STARTS = ~((np.arange(256) & 0xC0) == 0x80)
SCHEMA = ("doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, lines array<struct<hash: long, words: int>>")


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _salted(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    return mix(keys ^ mix(group.astype(np.uint64) + np.uint64(1)))


def measure(ids: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row for each text: the base counts, and hash and words of each line that has a word."""
    n = len(texts)
    words = words_of(texts)
    data, at = texts_buffer(texts)
    of = words.text_of()

    def per_text(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks)])
        return sums[at[1:]] - sums[at[:-1]]

    hashes = words.hashes()
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= WINDOW:
        ok = np.flatnonzero(full_windows(words.first, WINDOW))
        hits = ok[repeated(_salted(window_hashes(hashes, WINDOW)[ok], of[ok]))]
        np.add.at(covered, hits, 1)
        np.subtract.at(covered, hits + WINDOW, 1)
    in_repeat = np.cumsum(covered[:-1]) > 0

    newline = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([at[:-1], newline + 1]), kind="stable")
    # A text's end is also its last line's end; lines are [start, end) with the newline left out.
    line_end = np.sort(np.concatenate([at[1:], newline]), kind="stable")
    if n:
        # Empty texts and newlines at a border give equal numbers, so starts and ends are paired text by text.
        per = per_text(data == 10) + 1
        line_of = np.repeat(np.arange(n), per)
    else:
        line_of = np.empty(0, np.int64)
    lower = words_of(texts, lower=True)
    first_word, last_word = np.searchsorted(words.start, line_start), np.searchsorted(words.start, line_end)
    full = last_word > first_word
    line_of, line_start, line_end, first_word, last_word = (x[full] for x in (line_of, line_start, line_end, first_word, last_word))
    raw = words.__class__(words.data, line_start, line_end, np.zeros(1, np.int64)).hashes() if len(line_start) else np.empty(0, np.uint64)
    key = _salted(raw, line_of)
    order = np.lexsort((np.arange(len(key)), key))
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    norm = run_hash(lower.hashes(), first_word, last_word)
    sizes = (last_word - first_word).astype(np.int32)
    lines = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.bincount(line_of, minlength=n))]).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(norm.view(np.int64)), pa.array(sizes)], ["hash", "words"]))
    columns = {
        "doc_id": ids, "source": sources, "n_words": words.count,
        "word_chars": per_text(~SPACE[data] & _STARTS[data]), "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_of[again], minlength=n), "n_repeat_words": np.bincount(of[in_repeat], minlength=n)}
    arrays = [x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in columns.values()]
    return pa.RecordBatch.from_arrays([*arrays, lines], [*columns, "lines"])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            yield measure(*part.columns)


def judged(docs: DataFrame) -> DataFrame:
    """One row for each document: the base counts, ``removed_words``, ``base_failed`` and ``kept``."""
    measured = docs.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(_measure, SCHEMA)
    rows = stage(measured.withColumn("row", F.monotonically_increasing_id()), "line-rules")
    lines = rows.select("row", "source", F.explode("lines").alias("line")).select("row", "source", "line.hash", "line.words")
    # A document's repeated lines are one before they are counted, so the count needs no shuffle but that of partial sums.
    held = rows.select("source", F.explode(F.array_distinct("lines.hash")).alias("hash")).groupBy("source", "hash").agg(F.count("*").alias("docs"))
    above = held.where(F.col("docs") > LINE_DOCS).select(F.col("source").alias("of"), F.col("hash").alias("line"))
    gone = lines.join(above, F.col("source").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("line")), "left_semi")
    gone = gone.groupBy(F.col("row").alias("at")).agg(F.sum("words").alias("gone"))
    out = rows.drop("lines").join(gone, F.col("row") == F.col("at"), "left").withColumn("removed_words", F.coalesce("gone", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < MIN_WORDS) | (100 * left < LEFT_PERCENT * F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORD = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM d)),
sized AS (SELECT rid, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY rid),
runs AS (SELECT rid, pos, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS run
    FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, run) AS n FROM runs WHERE run IS NOT NULL),
hit AS (SELECT rid, count(DISTINCT pos + i) AS n FROM twice, range(5) AS t(i) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, source, text, line, row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS nth, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws
    FROM (SELECT rid, source, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT rid, source, text, string_split(text, chr(10)) AS ls FROM d))),
lined AS (SELECT *, array_to_string(ws, ' ') AS norm FROM l WHERE len(ws) > 0),
dups AS (SELECT rid, count(*) AS n FROM lined WHERE nth > 1 GROUP BY rid),
above AS (SELECT source, norm FROM lined GROUP BY source, norm HAVING count(DISTINCT rid) > {LINE_DOCS}),
gone AS (SELECT rid, sum(len(ws)) AS n FROM lined a JOIN above b ON a.source IS NOT DISTINCT FROM b.source AND a.norm = b.norm GROUP BY rid),
f AS (SELECT doc_id, coalesce(s.n, 0) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(u.n, 0) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words, CAST(coalesce(g.n, 0) AS BIGINT) AS removed
    FROM d LEFT JOIN sized s USING (rid) LEFT JOIN dups u USING (rid) LEFT JOIN hit h USING (rid) LEFT JOIN gone g USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
    AND NOT (removed > 0 AND (n_words - removed < {MIN_WORDS} OR 100 * (n_words - removed) < {LEFT_PERCENT} * n_words)) AS kept FROM f"""
