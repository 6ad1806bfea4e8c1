"""Rolling past-only route graphs: degrees and concentration of every node in the days before a day.

The graph of a window is a multiset of edges. An edge enters it on the day after its flights and leaves it when the window has passed,
so the count of an edge is a running sum over its own change days, and what a change does to the degree, flights and
squared counts of its two nodes is a difference that is summed for each (node, day). Nothing is recomputed for a day on
which nothing changed, and no window of edges is ever built.

Flights become one row for each (edge, day) first: the rows of a hot edge or node are bounded by twice the days, times its edges
before the sums. All state is whole numbers, so the differences are exact however long they run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.values import ratio

WIDTHS = (7, 30, 90)
STATE = ("out_degree", "in_degree", "out_flights", "in_flights", "out_squares", "in_squares")


def edge_changes(flights: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """width, origin, destination, day, ``before`` and ``after``: each edge's count in the window, on the days on which it changes."""
    daily = flights.where("origin is not null and destination is not null and day is not null").groupBy("origin", "destination", "day").agg(F.count("*").alias("n"))
    steps = [F.struct(F.lit(w).alias("width"), (F.col("day") + shift).alias("on"), (F.col("n") * sign).alias("change")) for w in widths for shift, sign in ((1, 1), (w + 1, -1))]
    moved = daily.select("origin", "destination", F.inline(F.array(*steps))).groupBy("width", "origin", "destination", F.col("on").alias("day")).agg(F.sum("change").alias("change"))
    order = Window.partitionBy("width", "origin", "destination").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum("change").over(order)
    return moved.select("width", "origin", "destination", "day", (after - F.col("change")).alias("before"), after.alias("after")).where("before <> after")


def node_changes(changes: DataFrame) -> DataFrame:
    """What the changes of a day do to the state of each node. An edge from a node to itself counts on both sides."""
    degree = (F.col("after") > 0).cast("long") - (F.col("before") > 0).cast("long")
    flights, squares = F.col("after") - F.col("before"), F.col("after") * F.col("after") - F.col("before") * F.col("before")

    def side(node: str, leaving: bool) -> Column:
        own, none = (degree, flights, squares), (F.lit(0).cast("long"),) * 3
        out, into = (own, none) if leaving else (none, own)
        return F.struct(F.col(node).alias("node"), *[c.alias(n) for n, c in zip(STATE, (x for pair in zip(out, into) for x in pair))])

    both = changes.select("width", "day", F.inline(F.array(side("origin", True), side("destination", False))))
    return both.groupBy("width", "node", "day").agg(*[F.sum(c).alias(c) for c in STATE])


def rolling_graph(flights: DataFrame, targets: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """For each distinct (node, day) of ``targets`` and each width: the node's degrees, flights and concentration of the ``width`` days before.

    ``flights`` has ``origin``, ``destination`` and ``day`` (a day number); rows that lack one of them are no edges, and neither are targets that
    lack node or day. ``out_hhi`` and ``in_hhi`` are the sums of squared route shares, null without flights; ``has_history`` tells
    whether the node had any flight in the window. The day itself and later ones are never looked at.
    """
    asked = targets.select("node", "day").where("node is not null and day is not null").distinct()
    asked = asked.select("node", "day", F.explode(F.array(*[F.lit(w) for w in widths])).alias("width"), F.lit(1).alias("_asked"))
    both = node_changes(edge_changes(flights, widths)).unionByName(asked, allowMissingColumns=True)
    both = both.groupBy("width", "node", "day").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATE], F.max("_asked").alias("_asked"))
    upto = Window.partitionBy("width", "node").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    state = both.select("width", "node", "day", "_asked", *[F.sum(c).over(upto).alias(c) for c in STATE]).where("_asked = 1")

    def hhi(side: str) -> Column:
        total = F.col(f"{side}_flights").cast("double")
        return ratio(F.col(f"{side}_squares").cast("double"), total * total).alias(f"{side}_hhi")

    return state.select("node", "day", "width", *STATE[:4], hhi("out"), hhi("in"), (F.col("out_flights") + F.col("in_flights") > 0).alias("has_history"))
