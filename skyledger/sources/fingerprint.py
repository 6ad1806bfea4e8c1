"""Content fingerprints of tables: order-independent, computed where the data lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODULUS = 1000000007
BINARY = 2.0**53


def portable_text(df: DataFrame, column: str) -> Column:
    """A value as text that other engines write alike, its length in front, so that no two rows share a text.

    Doubles are written as their whole part and two further groups of 53 binary digits: every bit down to 2^-106. Instants are in
    microseconds. From 2^62 on, and for values that are no number, the text is Spark's own.
    """
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        size = F.abs(value.cast("double"))
        near = F.when(size < 2.0**62, size)
        rest = (near - F.floor(near)) * BINARY
        digits = F.concat_ws(".", F.floor(near), F.floor(rest), F.floor((rest - F.floor(rest)) * BINARY))
        value = F.when(near.isNotNull(), F.concat(F.when(value < 0, "-").otherwise(""), digits)).otherwise(value.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(value.cast("timestamp"))
    text = value.cast("string")
    return F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("~"))


def row_digest(df: DataFrame, columns: list[str], portable: bool) -> Column:
    if not portable:
        return F.xxhash64(*columns)
    text = F.concat(*[portable_text(df, c) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fingerprint(df: DataFrame, name: str, columns: list[str] | None = None, portable: bool = False) -> DataFrame:
    """Rows, xor and modular sum of row digests. ``portable`` uses a digest other engines can compute too."""
    chosen = columns or sorted(df.columns)
    digests = df.select(row_digest(df, chosen, portable).alias("h"))
    return digests.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.bit_xor("h").alias("digest_xor"),
                       F.sum(F.pmod("h", F.lit(MODULUS))).alias("digest_sum"))


def changed_tables(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Tables whose fingerprint differs from the stored one, or that exist on one side only."""
    return current.exceptAll(stored.select(*current.columns)).select("table_name").unionByName(
        stored.select(*current.columns).exceptAll(current).select("table_name")).distinct()
