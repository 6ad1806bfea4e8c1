"""Shortest-path metrics of many graphs at once, without a row for each pair of nodes.

Searches start from a batch of sources together. A source has a *lane* and a *slot*; a row is one (window, lane, node)
and holds, for the ``SLOTS`` sources of its lane, a bitmap of those that have reached the node and one column of path
counts each. A level of the search is a join along the edges and a sum of ``SLOTS`` columns with partial sums in the map tasks.
Batches of ``BATCH`` sources a window run one after another, so what is held is bounded by nodes times the batch;
each level is written as a table, so a lost executor repeats one level at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.graph import degrees, nodes, pagerank
from skyledger.operators.ordering import keyed_rank
from skyledger.session import stage

SLOTS = 16
BATCH = 1024
_COUNTS = [f"s{j}" for j in range(SLOTS)]


def numbered(edges: DataFrame, window: str) -> DataFrame:
    """``(window, node, lane, slot)``: each node as a source, numbered by name within its window."""
    ranked = keyed_rank(nodes(edges, window), [window], ["node"])
    return stage(ranked.selectExpr(f"`{window}`", "node", f"CAST((rank - 1) DIV {SLOTS} AS INT) AS lane", f"CAST((rank - 1) % {SLOTS} AS INT) AS slot"))


def _each(pattern: str) -> list[str]:
    """An expression for each slot: ``{c}`` is its column, ``{bit}`` its bit, ``{j}`` its number. Text, because Spark parses it far
    faster than Python builds the same columns one call at a time."""
    return [pattern.format(c=c, j=j, bit=1 << j) for j, c in enumerate(_COUNTS)]


def _bits(condition: str) -> str:
    return " + ".join(_each(f"IF({condition}, {{bit}}, 0)"))


def breadth_first(hops: DataFrame, sources: DataFrame, window: str) -> list[DataFrame]:
    """Frame ``d`` holds ``(window, lane, node, fresh, s0..)``: the sources first met at distance ``d`` and their numbers of shortest paths."""
    keys = [window, "lane", "node"]
    held = [f"`{k}`" for k in keys]
    own = sources.selectExpr(*held, "CAST(shiftleft(1, slot) AS INT) AS fresh", *_each("IF(slot = {j}, 1.0D, 0.0D) AS {c}"))
    levels = [own]
    while True:
        met = levels[-1].join(hops, [window, "node"]).groupBy(window, "lane", F.col("dst").alias("node")).agg(*map(F.expr, _each("SUM({c}) AS {c}")))
        # Only the bitmaps of earlier levels are read again; a source's first visit is in one level only, so what is kept never grows twice.
        seen = reduce(DataFrame.unionByName, [x.select(*keys, "fresh") for x in levels]).groupBy(*keys).agg(F.expr("BIT_OR(fresh) AS seen"))
        both = met.join(seen, keys, "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
        new = "{c} > 0 AND (seen & {bit}) = 0"
        level = stage(both.selectExpr(*held, f"{_bits(new)} AS fresh", *_each(f"IF({new}, {{c}}, 0.0D) AS {{c}}")).where("fresh <> 0"))
        if level.isEmpty():
            return levels
        levels.append(level)


def batches(edges: DataFrame, window: str, batch: int = BATCH) -> Iterator[tuple[DataFrame, DataFrame, list[DataFrame]]]:
    """For each batch of sources: the edges as ``(window, node, dst)``, the sources, and the levels of their searches."""
    hops = stage(edges.select(window, F.col("src").alias("node"), "dst"))
    sources = numbered(edges, window)
    lanes = max(1, batch // SLOTS)
    last = sources.agg(F.max("lane")).first()[0]
    for low in range(0, 0 if last is None else last + 1, lanes):
        part = sources.where((F.col("lane") >= low) & (F.col("lane") < low + lanes))
        yield hops, part, breadth_first(hops, part, window)


def _added(parts: list[DataFrame], keys: list[str], **sums: Column) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])


def into_nodes(levels: list[DataFrame], window: str) -> DataFrame:
    """``(window, node, reached, total)``: how many of the sources reach a node, itself included, and the sum of their distances."""
    met = F.bit_count("fresh")
    return _added([x.select(window, "node", met.alias("reached"), (met * d).alias("total")) for d, x in enumerate(levels)], [window, "node"], reached=F.sum("reached"), total=F.sum("total"))


def from_sources(sources: DataFrame, levels: list[DataFrame], window: str) -> DataFrame:
    """``(window, source, reached, eccentricity, distance_sum)`` of each source."""
    slots = f"explode(array({', '.join(_each('struct({j} AS slot, {c} AS n)'))})) AS one"
    parts = []
    for d, level in enumerate(levels):
        met = level.groupBy(window, "lane").agg(*map(F.expr, _each("COUNT_IF((fresh & {bit}) <> 0) AS {c}")))
        parts.append(met.selectExpr(f"`{window}`", "lane", slots).where("one.n > 0").select(window, "lane", "one.slot", "one.n", F.lit(d).alias("d")))
    sums = _added(parts, [window, "lane", "slot"], reached=F.sum("n"), eccentricity=F.max("d"), distance_sum=F.sum(F.col("n") * F.col("d")))
    return sources.join(sums, [window, "lane", "slot"]).select(window, F.col("node").alias("source"), "reached", "eccentricity", "distance_sum")


def through_nodes(hops: DataFrame, levels: list[DataFrame], window: str) -> DataFrame:
    """``(window, node, passed)``: shortest paths of the sources that run through a node, each weighted by its share.

    Shares are summed back from the deepest level; a level hands ``(1 + own) / paths`` to the one before.
    """
    keys = [window, "lane", "node"]
    held = [f"`{k}`" for k in keys]
    back = hops.select(window, F.col("dst").alias("node"), F.col("node").alias("prior"))
    share = levels[-1].selectExpr(*held, *_each("IF({c} > 0, 1 / {c}, 0.0D) AS {c}"))
    found = []
    for level in reversed(levels[1:-1]):
        passed = share.join(back, [window, "node"]).groupBy(window, "lane", F.col("prior").alias("node")).agg(*map(F.expr, _each("SUM({c}) AS p{j}")))
        own = level.join(passed, keys, "left").selectExpr(*held, *_each("{c}"), *_each("coalesce({c} * p{j}, 0.0D) AS p{j}"))
        share = stage(own.selectExpr(*held, f"{' + '.join(_each('p{j}'))} AS passed", *_each("IF({c} > 0, (1 + p{j}) / {c}, 0.0D) AS {c}")))
        found.append(share.select(window, "node", "passed"))
    if not found:
        return levels[0].select(window, "node", F.lit(0.0).alias("passed")).limit(0)
    return _added(found, [window, "node"], passed=F.sum("passed"))


def reach(edges: DataFrame, window: str, batch: int = BATCH) -> DataFrame:
    """``(window, source, reached, eccentricity, distance_sum)`` for every node as a source."""
    parts = [from_sources(sources, levels, window) for _, sources, levels in batches(edges, window, batch)]
    return reduce(DataFrame.unionByName, parts) if parts else nodes(edges, window).selectExpr(window, "node AS source", "0L AS reached", "0 AS eccentricity", "0L AS distance_sum")


def centrality(edges: DataFrame, window: str, between: bool = True, batch: int = BATCH) -> DataFrame:
    """``(window, node, closeness, betweenness)`` of one search from every node.

    Closeness comes from distances into a node, (r - 1) / sum of distances, scaled by (r - 1) / (n - 1); directed
    betweenness is divided by (n - 1)(n - 2). Without ``between`` the way back is left out.
    """
    near, passed = [], []
    for hops, _, levels in batches(edges, window, batch):
        near.append(into_nodes(levels, window))
        if between:
            passed.append(through_nodes(hops, levels, window))
    every = nodes(edges, window)
    size = every.groupBy(window).agg(F.count("*").alias("n"))
    if not near:
        return every.select(window, "node", F.lit(0.0).alias("closeness"), *([F.lit(0.0).alias("betweenness")] if between else []))
    sums = _added(near, [window, "node"], reached=F.sum("reached"), total=F.sum("total"))
    others = F.col("reached") - 1
    close = F.when(F.col("total") > 0, others / F.col("total") * (others / (F.col("n") - 1))).otherwise(0.0).alias("closeness")
    if not between:
        return sums.join(size, window).select(window, "node", close)
    held = sums.join(_added(passed, [window, "node"], passed=F.sum("passed")), [window, "node"], "left").join(size, window)
    scale = (F.col("n") - 1.0) * (F.col("n") - 2.0)
    return held.select(window, "node", close, F.when(F.col("n") > 2, F.coalesce("passed", F.lit(0.0)) / scale).otherwise(0.0).alias("betweenness"))


def node_metrics(edges: DataFrame, window: str) -> DataFrame:
    """Degrees, concentration, betweenness, closeness and PageRank of every node in every window."""
    edges = stage(edges)
    keys = [window, "node"]
    return degrees(edges, window).join(centrality(edges, window), keys).join(pagerank(edges, window), keys)
