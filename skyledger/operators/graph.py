"""Route graphs as edge tables, for many windows (years, months, days) at once.

Every function keeps the window as a key, so no loop over windows is needed. Iterations are joins along edges; each
round is checkpointed, so a lost executor repeats one round at most. Shortest-path metrics are in ``paths``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.values import normalise_code, ratio
from skyledger.session import cut_lineage


def route_edges(df: DataFrame, window: str, origin: str = "origin", destination: str = "destination") -> DataFrame:
    """Validated directed edges ``(window, src, dst, weight)``: blank ends, self-loops and rows without a window left out."""
    clean = df.select(F.col(window), normalise_code(F.col(origin)).alias("src"), normalise_code(F.col(destination)).alias("dst"))
    valid = clean.where(F.col(window).isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return valid.groupBy(window, "src", "dst").agg(F.count("*").alias("weight"))


def edge_problems(edges: DataFrame) -> DataFrame:
    """One row: edges that must not exist (blank end, self-loop, non-positive or fractional weight, duplicate)."""
    keys = [c for c in edges.columns if c != "weight"]
    counted = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.min("weight").alias("low"), F.max(F.col("weight") % 1).alias("part"))
    blank = F.col("src").isNull() | (F.trim("src") == "") | F.col("dst").isNull() | (F.trim("dst") == "")

    def count(c):
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    return counted.agg(count(blank).alias("blank_ends"), count(F.col("src") == F.col("dst")).alias("self_loops"), count(F.col("low") <= 0).alias("non_positive"),
                       count(F.col("part") != 0).alias("fractional"), count(F.col("n") > 1).alias("duplicates"))


def nodes(edges: DataFrame, window: str) -> DataFrame:
    return edges.select(window, F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame, window: str) -> DataFrame:
    """In/out degree, weighted degrees and route concentration (HHI) per node, from one grouping of both edge ends.

    HHI = sum(w^2) / (sum w)^2, so no second pass is needed; a side without routes has HHI 0.
    """
    ends = F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    w = F.col("weight")
    out = edges.select(window, "weight", ends.alias("e")).groupBy(window, "e.node").agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.sum(w * F.col("e.i")).alias("weighted_in"), F.sum(w * F.col("e.o")).alias("weighted_out"),
        F.sum(w.cast("double") * w * F.col("e.i")).alias("_i2"), F.sum(w.cast("double") * w * F.col("e.o")).alias("_o2"))

    def hhi(square: str, total: str):
        return F.coalesce(F.col(square) / F.nullif(F.col(total).cast("double") * F.col(total), F.lit(0.0)), F.lit(0.0))

    return out.select(window, "node", "in_degree", "out_degree", "weighted_in", "weighted_out", hhi("_o2", "weighted_out").alias("outgoing_hhi"), hhi("_i2", "weighted_in").alias("incoming_hhi"))


def graph_summary(edges: DataFrame, window: str) -> DataFrame:
    """Nodes, edges, weight and density E / (N (N - 1)) per window."""
    sizes = nodes(edges, window).groupBy(window).agg(F.count("*").alias("node_count"))
    totals = edges.groupBy(window).agg(F.count("*").alias("edge_count"), F.sum("weight").alias("scheduled_flights"))
    n = F.col("node_count")
    return totals.join(sizes, window).select(window, "node_count", "edge_count", "scheduled_flights", F.coalesce(ratio(F.col("edge_count"), n * (n - 1)), F.lit(0.0)).alias("density"))


def weak_components(edges: DataFrame, window: str) -> DataFrame:
    """Smallest node name of the weakly connected component of every node.

    Each round takes the smallest label among neighbours and then the label of that label, so long chains need a
    logarithmic number of rounds rather than one per step.
    """
    both = cut_lineage(edges.select(window, F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
                       .select(window, "e.src", "e.dst").distinct())
    labels = cut_lineage(both.groupBy(window, F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")))
    while True:
        offered = both.join(labels.select(window, F.col("node").alias("dst"), "label"), [window, "dst"]).groupBy(window, F.col("src").alias("node")).agg(F.min("label").alias("_near"))
        near = labels.join(offered, [window, "node"]).select(window, "node", F.col("label").alias("_old"), F.least("label", "_near").alias("_low"))
        jump = labels.select(window, F.col("node").alias("_low"), F.col("label").alias("_root"))
        moved = cut_lineage(near.join(jump, [window, "_low"]).select(window, "node", "_old", F.least("_low", "_root").alias("label")))
        changed = moved.where(F.col("label") != F.col("_old")).limit(1).count()
        labels = moved.select(window, "node", "label")
        if not changed:
            return labels


def strong_components(edges: DataFrame, window: str) -> DataFrame:
    """Smallest node name of the strongly connected component of every node, by trimming and colouring.

    A round first takes off nodes without an edge in or out among those left: each is a component. Then every node gets
    the smallest name that reaches it (its colour), and what a colour's own node is reached from within the colour is its
    component, whose smallest name that node has. A round costs a pass over the edges left for each step of the longest
    path that a name travels; edges between colours are never looked at again.
    """
    alive = cut_lineage(edges.select(window, "src", "dst").distinct())
    found = []
    rest = cut_lineage(nodes(edges, window))
    while not alive.isEmpty():
        alive, rest, alone = _trimmed(alive, rest, window)
        found.append(alone)
        if alive.isEmpty():
            break
        colours = _spread(alive, rest.select(window, "node", F.col("node").alias("label")), window)
        both = alive.join(colours.withColumnsRenamed({"node": "src", "label": "_from"}), [window, "src"]).join(colours.withColumnsRenamed({"node": "dst", "label": "_to"}), [window, "dst"])
        inside = cut_lineage(both.where(F.col("_from") == F.col("_to")).select(window, "src", "dst"))
        done = _reached_back(inside, colours, window)
        found.append(done)
        names = done.select(window, "node")
        rest = cut_lineage(rest.join(names, [window, "node"], "left_anti"))
        alive = cut_lineage(inside.join(names.withColumnRenamed("node", "src"), [window, "src"], "left_anti").join(names.withColumnRenamed("node", "dst"), [window, "dst"], "left_anti"))
    return reduce(DataFrame.unionByName, [*found, rest.select(window, "node", F.col("node").alias("label"))])


def _trimmed(alive: DataFrame, rest: DataFrame, window: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges and nodes left when no node lacks an edge in or out, and the nodes taken off, each its own label."""
    alone = []
    while True:
        ends = alive.select(window, F.col("src").alias("node")).intersect(alive.select(window, F.col("dst").alias("node")))
        kept = cut_lineage(rest.join(ends, [window, "node"], "left_semi"))
        gone = cut_lineage(rest.join(kept, [window, "node"], "left_anti"))
        if gone.isEmpty():
            return alive, rest, reduce(DataFrame.unionByName, alone) if alone else gone.select(window, "node", F.col("node").alias("label"))
        alone.append(gone.select(window, "node", F.col("node").alias("label")))
        rest = kept
        alive = cut_lineage(alive.join(kept.withColumnRenamed("node", "src"), [window, "src"], "left_semi").join(kept.withColumnRenamed("node", "dst"), [window, "dst"], "left_semi"))


def _spread(alive: DataFrame, labels: DataFrame, window: str) -> DataFrame:
    """The smallest label that reaches each node along the edges. Only nodes whose label fell send it on."""
    labels = cut_lineage(labels.withColumn("_moved", F.lit(True)))
    while True:
        sent = labels.where("_moved").select(window, F.col("node").alias("src"), "label").join(alive, [window, "src"]).groupBy(window, F.col("dst").alias("node")).agg(F.min("label").alias("_near"))
        fell = F.coalesce(F.col("_near") < F.col("label"), F.lit(False))
        labels = cut_lineage(labels.join(sent, [window, "node"], "left").select(window, "node", F.when(fell, F.col("_near")).otherwise(F.col("label")).alias("label"), fell.alias("_moved")))
        if labels.where("_moved").isEmpty():
            return labels.select(window, "node", "label")


def _reached_back(inside: DataFrame, colours: DataFrame, window: str) -> DataFrame:
    """Nodes that a colour's own node is reached from along edges inside the colour."""
    front = cut_lineage(colours.where(F.col("node") == F.col("label")))
    parts, open_ = [front], cut_lineage(colours.where(F.col("node") != F.col("label")))
    while True:
        before = inside.join(front.select(window, F.col("node").alias("dst")), [window, "dst"], "left_semi").select(window, F.col("src").alias("node")).distinct()
        front = cut_lineage(open_.join(before, [window, "node"], "left_semi"))
        if front.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(front)
        open_ = cut_lineage(open_.join(front, [window, "node"], "left_anti"))


def pagerank(edges: DataFrame, window: str, alpha: float = 0.85, tolerance: float = 1e-6, max_iterations: int = 100) -> DataFrame:
    """Weighted PageRank by power iteration; a dangling node spreads its rank evenly.

    A window stops changing once its total change is below N * tolerance. Every iteration is checkpointed, so the plan
    does not grow with the number of iterations.
    """
    total = edges.groupBy(window, "src").agg(F.sum("weight").alias("_t"))
    moves = cut_lineage(edges.join(total, [window, "src"]).select(window, F.col("src").alias("node"), "dst", (F.col("weight") / F.col("_t")).alias("p")))
    every = nodes(edges, window)
    size = every.groupBy(window).agg(F.count("*").alias("n"))
    sources = total.select(window, F.col("src").alias("node"), F.lit(False).alias("dangling"))
    start = every.join(size, window).join(sources, [window, "node"], "left").select(
        window, "node", "n", F.coalesce("dangling", F.lit(True)).alias("dangling"), (1.0 / F.col("n")).alias("rank"), F.lit(False).alias("done"))
    ranks = cut_lineage(start)
    for _ in range(max_iterations):
        ranks = cut_lineage(_pagerank_step(ranks, moves, window, alpha, tolerance))
        if ranks.where(~F.col("done")).isEmpty():
            return ranks.select(window, "node", F.col("rank").alias("pagerank"))
    raise ValueError(f"PageRank did not converge in {max_iterations} iterations")


def _pagerank_step(ranks: DataFrame, moves: DataFrame, window: str, alpha: float, tolerance: float) -> DataFrame:
    sent = moves.join(ranks.select(window, "node", "rank"), [window, "node"]).groupBy(window, F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("_in"))
    loose = ranks.groupBy(window).agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("_loose"))
    merged = ranks.join(sent, [window, "node"], "left").join(loose, window)
    fresh = alpha * (F.coalesce("_in", F.lit(0.0)) + F.col("_loose") / F.col("n")) + (1 - alpha) / F.col("n")
    merged = merged.select(window, "node", "n", "dangling", "rank", "done", F.when(F.col("done"), F.col("rank")).otherwise(fresh).alias("_new"))
    change = merged.groupBy(window).agg((F.sum(F.abs(F.col("_new") - F.col("rank"))) < F.max("n") * tolerance).alias("_stop"))
    return merged.join(change, window).select(window, "node", "n", "dangling", F.col("_new").alias("rank"), (F.col("done") | F.col("_stop")).alias("done"))


def exposure(routes: DataFrame, metrics: DataFrame, summary: DataFrame, window: str) -> DataFrame:
    """Per window: route totals, airport appearances and their top-10 share, metric distribution, rates and reconciliation.

    ``routes`` has one row per (window, origin, destination) with outcome counts, so everything here is small.
    """
    counts = ("scheduled", "cancelled_flights", "diverted_flights", "completed", "severe")
    totals = routes.groupBy(window).agg(*[F.sum(c).alias(c) for c in counts], F.count("*").alias("route_count"))
    ends = F.explode(F.array("origin", "destination"))
    appearances = routes.select(window, ends.alias("airport"), "scheduled").groupBy(window, "airport").agg(F.sum("scheduled").alias("n"))
    order = Window.partitionBy(window).orderBy(F.desc("n"), "airport")
    airports = appearances.withColumn("_r", F.row_number().over(order)).groupBy(window).agg(
        F.count("*").alias("airport_count"), F.sum("n").alias("airport_appearances"), F.sum(F.when(F.col("_r") <= 10, F.col("n"))).alias("top_10_appearances"))
    distribution = metrics.groupBy(window).agg(
        F.count("*").alias("metric_airports"), F.avg("betweenness").alias("mean_betweenness"), F.max("betweenness").alias("max_betweenness"),
        F.avg("outgoing_hhi").alias("mean_outgoing_hhi"), F.max("pagerank").alias("max_pagerank"))
    joined = summary.join(totals, window).join(airports, window).join(distribution, window)
    agree = ((F.col("scheduled_flights") == F.col("scheduled")) & (F.col("edge_count") == F.col("route_count")) & (F.col("node_count") == F.col("airport_count"))
             & (F.col("node_count") == F.col("metric_airports")) & (F.col("airport_appearances") == 2 * F.col("scheduled")))
    return joined.select(
        "*", ratio(F.col("top_10_appearances"), F.col("airport_appearances")).alias("top_10_share"), ratio(F.col("cancelled_flights"), F.col("scheduled")).alias("cancellation_rate"),
        ratio(F.col("diverted_flights"), F.col("scheduled")).alias("diversion_rate"), ratio(F.col("severe"), F.col("completed")).alias("severe_rate"), agree.alias("reconciles"))


def regime_comparison(exposure_rows: DataFrame, metrics: DataFrame, window: str, reference: int, partial: int) -> DataFrame:
    """Median and p90 metrics per window and changes against a reference window (points, percent); volume changes are
    left empty for the partial window. Medians are over airports of one window, a small bounded list."""
    from skyledger.operators.attach import attach_row

    spread = metrics.groupBy(window).agg(
        F.median("betweenness").alias("median_betweenness"), F.percentile("betweenness", 0.9).alias("p90_betweenness"), F.median("pagerank").alias("median_pagerank"),
        F.median("outgoing_hhi").alias("median_outgoing_hhi"))
    base_columns = ("cancellation_rate", "severe_rate", "density", "scheduled", "edge_count")
    base = exposure_rows.where(F.col(window) == reference).select(*[F.col(c).alias(f"_{c}") for c in base_columns])
    held = attach_row(exposure_rows.join(spread, window), base)
    whole = F.col(window) != partial
    return held.select(
        window, "cancellation_rate", "severe_rate", "density", "median_betweenness", "p90_betweenness", "median_pagerank", "median_outgoing_hhi",
        ((F.col("cancellation_rate") - F.col("_cancellation_rate")) * 100).alias("cancellation_change_pp"), ((F.col("severe_rate") - F.col("_severe_rate")) * 100).alias("severe_change_pp"),
        (F.col("density") - F.col("_density")).alias("density_change"),
        F.when(whole, (F.col("scheduled") / F.col("_scheduled") - 1) * 100).alias("volume_change_pct"), F.when(whole, (F.col("edge_count") / F.col("_edge_count") - 1) * 100).alias("route_change_pct"))


def busiest_subgraph(edges: DataFrame, window: str, airports: int, routes: int) -> DataFrame:
    """The busiest airports over all windows, then the busiest routes among them per window; ties by name."""
    ends = F.explode(F.array("src", "dst"))
    traffic = edges.select(ends.alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("n"))
    kept = F.broadcast(traffic.orderBy(F.desc("n"), "node").limit(airports).select("node"))
    inside = edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    order = Window.partitionBy(window).orderBy(F.desc("weight"), "src", "dst")
    return inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= routes)


def centrality_outcomes(routes: DataFrame, metrics: DataFrame, window: str, minimum: int) -> DataFrame:
    """Origin outcomes next to same-window centrality, with a support flag and a flight-count agreement flag."""
    origin = routes.groupBy(window, F.col("origin").alias("node")).agg(*[F.sum(c).alias(c) for c in ("scheduled", "cancelled_flights", "completed", "severe")])
    joined = origin.join(metrics, [window, "node"], "left")
    return joined.select(
        "*", ratio(F.col("severe"), F.col("completed")).alias("severe_rate"), ratio(F.col("cancelled_flights"), F.col("scheduled")).alias("cancellation_rate"),
        (F.col("completed") >= minimum).alias("supported"), (F.col("weighted_out") == F.col("scheduled")).alias("flights_agree"))
