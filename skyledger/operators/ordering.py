"""Distributed ordering: ranks, running sums, equal-count bins and exact quantiles without a single-task sort.

A window over a whole table, or over one very large group, runs in one task. Here rows are range-partitioned on
(group, order) - so one hot group or one repeated value still spreads over many tasks as long as the order columns
contain an id - and written once as a table, whose small block totals give the offset of every block. Offsets are a
table too, so Spark sees how small they are and sends them to the rows; only the sort inside a block is local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import stage

BLOCK = "_block"


def _sort_key(item: str | tuple[str, bool]) -> Column:
    name, descending = item if isinstance(item, tuple) else (item, False)
    return F.col(name).desc() if descending else F.col(name).asc()


def range_blocks(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Range-partition on keys then order, and fix each row's block number by writing it."""
    columns = [F.col(k).asc() for k in keys] + [_sort_key(o) for o in order]
    return stage(df.repartitionByRange(*columns).withColumn(BLOCK, F.spark_partition_id()))


def block_offsets(blocked: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Per (key, block): the sums over all earlier blocks of the same key, and the key's grand totals.

    There is at most one row per block plus one per key, so this table stays small next to the data.
    """
    names = list(totals)
    blocks = blocked.groupBy(*keys, BLOCK).agg(*[c.alias(n) for n, c in totals.items()])
    part = Window.partitionBy(*(keys or [F.lit(1)]))
    earlier = part.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return stage(blocks.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(BLOCK).alias("_k_block"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names],
        *[F.sum(n).over(part).alias(f"_total_{n}") for n in names],
    ))


def _with_offsets(blocked: DataFrame, keys: list[str], offsets: DataFrame) -> DataFrame:
    condition = blocked[BLOCK] == offsets["_k_block"]
    for k in keys:
        condition = condition & blocked[k].eqNullSafe(offsets[f"_k_{k}"])
    return blocked.join(offsets, condition).drop("_k_block", *[f"_k_{k}" for k in keys])


def running_totals(df: DataFrame, keys: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums and grand totals: for ``{out: column}`` adds ``out`` and ``out_total``.

    ``order`` must be unique inside a key, so group equal values first.
    """
    blocked = range_blocks(df, keys, order)
    offsets = block_offsets(blocked, keys, {n: F.sum(c) for n, c in sums.items()})
    joined = _with_offsets(blocked, keys, offsets)
    window = Window.partitionBy(*keys, BLOCK).orderBy(*[_sort_key(o) for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{n}") + F.sum(c).over(window)).alias(n) for n, c in sums.items()],
        *[F.col(f"_total_{n}").alias(f"{n}_total") for n in sums],
    )


def keyed_rank(df: DataFrame, keys: list[str], order: list, out: str = "rank") -> DataFrame:
    """1-based rank inside each key, and ``{out}_size``, the number of rows of the key."""
    blocked = range_blocks(df, keys, order)
    offsets = block_offsets(blocked, keys, {"n": F.count("*")})
    joined = _with_offsets(blocked, keys, offsets)
    window = Window.partitionBy(*keys, BLOCK).orderBy(*[_sort_key(o) for o in order])
    return joined.select(
        *df.columns, (F.col("_before_n") + F.row_number().over(window)).alias(out), F.col("_total_n").alias(f"{out}_size"))


def equal_count_bins(df: DataFrame, keys: list[str], order: list, bins: int, out: str = "bin") -> DataFrame:
    """1-based bins of nearly equal size; the first ``size % bins`` bins take one extra row (as ``ntile``)."""
    ranked = keyed_rank(df, keys, order, "_rank")
    position, size = F.col("_rank") - 1, F.col("_rank_size")
    small, extra = F.floor(size / bins), size % bins
    head = extra * (small + 1)
    number = F.when(position < head, F.floor(position / (small + 1))).otherwise(extra + F.floor((position - head) / F.greatest(small, F.lit(1))))
    return ranked.select(*df.columns, (number + 1).cast("int").alias(out))


def quantile_bins(df: DataFrame, keys: list[str], order: list, bins: int, out: str = "bin") -> DataFrame:
    """1-based bins cut at linearly interpolated rank quantiles, right-closed (as a quantile cut of unique ranks)."""
    ranked = keyed_rank(df, keys, order, "_rank")
    # rank r lies in bin b when r <= 1 + (n - 1) * b / bins
    number = F.greatest(F.lit(1), F.ceil((F.col("_rank") - 1) * bins / F.greatest(F.col("_rank_size") - 1, F.lit(1)) - 1e-9))
    return ranked.select(*df.columns, number.cast("int").alias(out))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles per key from value counts, with no per-group collection.

    ``weight`` is a row count column when values are already grouped.
    """
    source = df.where(F.col(value).isNotNull())
    counts = source.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    cumulative = running_totals(counts, keys, [value], {"_upto": "_n"})
    picks = []
    for name, p in probabilities.items():
        position = (F.col("_upto_total") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        first = F.col("_upto") - F.col("_n")
        picks.append(F.max(F.when((first <= low) & (low < F.col("_upto")), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.max(F.when((first <= high) & (high < F.col("_upto")), F.col(value))).alias(f"_hi_{name}"))
        picks.append(F.max(position - low).alias(f"_f_{name}"))
    result = cumulative.groupBy(*keys).agg(*picks)
    return result.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probabilities])


def average_rank(df: DataFrame, keys: list[str], value: str, out: str, weight: str | None = None) -> DataFrame:
    """Average rank of each distinct value (ties share their mean rank): one row per (keys, value).

    ``weight`` is a row count column when values are already grouped.
    """
    counts = df.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    upto = running_totals(counts, keys, [value], {"_upto": "_n"})
    return upto.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
