"""Attach a one-row result to every row of a table without a join, and pair rows of one table by their id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.session import stage


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row of ``df``. More than one row is an error at run time."""
    packed = row.select(F.struct(*row.columns).alias("one")).scalar()
    held = df.withColumn("_one", packed)
    return held.select(*df.columns, *[F.col("_one")[c].alias(c) for c in row.columns])


def pair_rows(left: DataFrame, whole: DataFrame, keep: list[str], other: list[str], identity: str = "flight_id") -> DataFrame:
    """``keep`` of the rows of ``left`` joined by id to ``other`` of the rows of ``whole``.

    ``left`` holds rows of ``whole`` and has its columns, so a row whose id no other row has is its own partner and stays
    where it is; only rows whose id repeats (told by its digest) are joined. Rows without an id have no partner.
    """
    mine, theirs = (df.where(F.col(identity).isNotNull()).withColumn("_digest", F.xxhash64(identity)) for df in (left, whole))
    repeated = stage(theirs.groupBy("_digest").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("_digest"))
    if repeated.isEmpty():
        return mine.select(identity, *keep, *other)
    alone = mine.join(repeated, "_digest", "left_anti").select(identity, *keep, *other)
    shared = mine.join(repeated, "_digest", "left_semi").select(identity, *keep).join(theirs.join(repeated, "_digest", "left_semi").select(identity, *other), identity)
    return alone.unionByName(shared)
