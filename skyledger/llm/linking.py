"""Connected components of a table of links, by turns of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import stage


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("high", "low") % 2**40)).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns a, b. Returns node, component (the smallest node that it reaches) for all nodes in a link.

    Each turn joins every node's links with its smallest neighbour, written as a table first, so that a node with very
    many links is split by Spark's skew handling. The number of turns grows with the logarithm of a chain's length.
    """
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "links")
    seen = _print(now)
    while True:
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(now.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = stage(both.groupBy(F.col("u").alias("of")).agg(F.least(F.min("v"), F.first("u")).alias("m")), "links-least")
        large = stage(both.where("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("high"), F.col("m").alias("low")).distinct(), "links-large")
        lowest = stage(large.groupBy(F.col("high").alias("of")).agg(F.min("low").alias("m")), "links-lowest")
        small = large.join(lowest, F.col("high") == F.col("of"))
        pulled = small.where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low")).unionByName(lowest.select(F.col("of").alias("high"), F.col("m").alias("low")))
        now = stage(pulled.distinct(), "links")
        if (after := _print(now)) == seen:
            break
        seen = after
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
