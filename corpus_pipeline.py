"""From raw documents to a mixed training corpus: five stages, each written as a table and read again.

1. Documents that the nearest labelled examples call toxic go. 2. Of each group of near copies one document stays.
3. Passages of 20 words or more that an earlier document has are cut out; a document of which nothing is left goes.
4. Documents with a window of a benchmark item go. 5. Sources are mixed to target weights; ``copies`` tells how often a
document is taken.

A text that nothing is cut from is passed on unchanged; of a cut one the kept words are joined by a blank and ``n_chars``
is counted again. Nulls, empty texts, repeated rows and empty tables are treated as each operator states.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import mixing, phrase_index, prefix_tree, repeats, toxicity
from skyledger.llm.common import discard, forget, grouped, stage, table

Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def step(function: Step) -> Step:
    """A stage's working tables are deleted when the next stage begins: by then its result is written."""
    @functools.wraps(function)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, "pipeline")
        with grouped("pipeline"):
            return function(spark, docs, sf_dir)

    return run_step


@step
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, index).where(F.col("_score") < 0.5).select(*docs.columns)


@step
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return prefix_tree.one_of_each(docs)


@step
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = repeats.deduplicated(docs)
    removed, words = F.col(repeats.N_REMOVED), F.col(repeats.N_WORDS)
    changed = {"text": F.when(removed > 0, F.col(repeats.KEPT)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(removed > 0, F.length(repeats.KEPT).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.where((removed == 0) | (removed < words)).withColumns(changed).select(*docs.columns)


@step
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrase_index.clean(docs, table(spark, sf_dir, "benchmark"))


@step
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", one_of_near_copies),
    ("repeated passages", without_repeats),
    ("benchmark passages", without_benchmark),
    ("source mix", mixed_sources),
]

#: The toxicity model is not a statement in SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    forget(spark, "pipeline")
    return docs
