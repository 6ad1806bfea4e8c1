"""Rotation links: which leg of one aircraft followed which, why a link is not usable, and the delay carried along a chain.

The legs of a tail are ordered by actual arrival, or by scheduled arrival where there is none; each leg's candidate is the leg just
before it. A candidate that fails a rule is kept with the first reason that holds. Legs joined by eligible links make a chain,
along which delays add up.

Rows are range-partitioned on (tail, arrival), so a tail with a third of all legs is spread over many blocks. What crosses a block
border - the last leg, the sums of an open chain - is a table with one row for each (tail, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators.ordering import BLOCK, range_blocks
from skyledger.session import stage

SEVERE = 120
ELIGIBLE = "eligible"
#: Reasons in the order in which they are tried.
REASONS = ("no_tail", "no_time", "first_leg", "prior_cancelled", "prior_diverted", "prior_no_arrival", "no_departure",
           "airport_unknown", "airport_mismatch", "turnaround_negative", "turnaround_short", "turnaround_long")
LEG_COLUMNS = ("leg_id", "tail", "origin", "destination", "departure_at", "planned_arrival_at", "arrived_at", "asked_at", "arr_delay", "cancelled", "diverted")


def previous_row(blocked: DataFrame, key: str, order: list[str], columns: list[str], out: str) -> DataFrame:
    """Adds ``out``, a struct of the ``columns`` of the row before in the key's order, null for the first."""
    of_row, by = F.struct(*columns), F.struct(*order)
    ends = blocked.groupBy(key, BLOCK).agg(F.max_by(of_row, by).alias("_end"))
    blocks = Window.partitionBy(key).orderBy(BLOCK)
    ends = stage(ends.select(F.col(key).alias("_of"), F.col(BLOCK).alias("_in"), F.lag("_end").over(blocks).alias("_end")))
    inside = Window.partitionBy(key, BLOCK).orderBy(*order)
    rows = blocked.withColumn(out, F.lag(of_row).over(inside)).withColumn("_opens", F.row_number().over(inside) == 1)
    joined = rows.join(ends, (F.col(key) == F.col("_of")) & (F.col(BLOCK) == F.col("_in")), "left")
    return joined.withColumn(out, F.when(F.col("_opens"), F.col("_end")).otherwise(F.col(out))).drop("_of", "_in", "_end", "_opens")


def totals_since(blocked: DataFrame, key: str, order: list[str], start: str, sums: dict[str, Column]) -> DataFrame:
    """Running sums in the key's order that begin anew at each row whose ``start`` is true, that row included.

    Inside a block the sums are local; the rows before a block's first start also get what the key's earlier blocks left open.
    """
    names = list(sums)
    inside = Window.partitionBy(key, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    piece = Window.partitionBy(key, BLOCK, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn("_piece", F.sum(F.col(start).cast("int")).over(inside)).withColumns({n: F.sum(c).over(piece) for n, c in sums.items()})
    ends = local.groupBy(key, BLOCK).agg(F.max("_piece").alias("_starts"), F.max_by(F.struct(*names), F.struct(*order)).alias("_open"))
    blocks = Window.partitionBy(key).orderBy(BLOCK)
    open_ = Window.partitionBy(key, "_run").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_run", F.sum((F.col("_starts") > 0).cast("int")).over(blocks.rowsBetween(Window.unboundedPreceding, 0)))
    left = ends.select(key, BLOCK, F.struct(*[F.sum(f"_open.{n}").over(open_).alias(n) for n in names]).alias("_left"))
    left = stage(left.select(F.col(key).alias("_of"), F.col(BLOCK).alias("_in"), F.lag("_left").over(blocks).alias("_left")))
    joined = local.join(left, (F.col(key) == F.col("_of")) & (F.col(BLOCK) == F.col("_in")), "left")
    carried = {n: F.when(F.col("_piece") == 0, F.col(n) + F.coalesce(F.col(f"_left.{n}"), F.lit(0))).otherwise(F.col(n)) for n in names}
    return joined.withColumns(carried).drop("_piece", "_of", "_in", "_left")


def _reason(least: int, most: int) -> Column:
    """The first reason against the link to ``_prior``; ``eligible`` if there is none."""
    prior, turn = (lambda name: F.col(f"_prior.{name}")), F.col("departure_at") - F.col("_prior.arrived_at")
    tests = {
        "first_leg": F.col("_prior").isNull(), "prior_cancelled": prior("cancelled"), "prior_diverted": prior("diverted"), "prior_no_arrival": prior("arrived_at").isNull(),
        "no_departure": F.col("departure_at").isNull(), "airport_unknown": prior("destination").isNull() | F.col("origin").isNull(),
        "airport_mismatch": prior("destination") != F.col("origin"), "turnaround_negative": turn < 0, "turnaround_short": turn < least, "turnaround_long": turn > most,
    }
    return F.coalesce(*[F.when(tests[r], F.lit(r)) for r in REASONS if r in tests], F.lit(ELIGIBLE))


def rotation_links(legs: DataFrame, least: int, most: int) -> DataFrame:
    """One row for each row of ``legs`` (``LEG_COLUMNS``; times in UTC seconds, flags boolean) with the link to the leg before it.

    ``link_status`` is ``eligible`` or the first of ``REASONS``. An eligible link has ``prior_leg_id`` and ``turnaround`` (seconds,
    from ``least`` to ``most``). ``prior_known`` tells whether the prior leg had landed when the prediction is made; only then
    ``prior_delay``, ``prior_severe`` and ``delay_growth`` are given. ``chain_leg`` counts the legs of a chain, ``chain_delay`` sums
    their late minutes, ``cascade_depth`` counts the severe legs in a row up to this one.

    Tails are compared without blanks around them and in upper case; an empty one is none. Null flags count as false, a null delay adds
    nothing and is not severe. Legs without tail or any arrival time are kept, without link and chain. Repeated rows are legs of their
    own; rows alike in all of ``LEG_COLUMNS`` follow each other in any order.
    """
    tail = F.upper(F.trim("tail"))
    clean = legs.select(*[c for c in LEG_COLUMNS if c not in ("tail", "cancelled", "diverted")], F.when(tail != "", tail).alias("tail"),
                        *[F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in ("cancelled", "diverted")])
    clean = clean.withColumn("ordered_at", F.coalesce("arrived_at", "planned_arrival_at"))
    usable = F.col("tail").isNotNull() & F.col("ordered_at").isNotNull()
    # All columns take part, so that an id that is used twice has one order.
    order = ["ordered_at", "leg_id", *[c for c in LEG_COLUMNS if c not in ("tail", "leg_id")]]
    blocked = range_blocks(clean.where(usable), ["tail"], order)
    prior = previous_row(blocked, "tail", order, ["leg_id", "destination", "arrived_at", "arr_delay", "cancelled", "diverted"], "_prior")
    linked = prior.withColumn("link_status", _reason(least, most))
    late, severe = F.greatest(F.coalesce("arr_delay", F.lit(0.0)), F.lit(0.0)), F.coalesce(F.col("arr_delay") >= SEVERE, F.lit(False))
    linked = stage(linked.withColumns({"_late": late, "_severe": severe, "_starts": F.col("link_status") != ELIGIBLE}))
    chained = totals_since(linked, "tail", order, "_starts", {"chain_leg": F.lit(1), "chain_delay": F.col("_late")})
    # A leg that is not severe opens a row of severe legs that its own zero does not count to.
    chained = chained.withColumn("_calm", F.col("_starts") | ~F.col("_severe"))
    chained = totals_since(stage(chained), "tail", order, "_calm", {"cascade_depth": F.col("_severe").cast("int")})
    eligible = F.col("link_status") == ELIGIBLE
    known = eligible & F.coalesce(F.col("_prior.arrived_at") <= F.col("asked_at"), F.lit(False))
    found = chained.select(
        "leg_id", "tail", "link_status", F.when(eligible, F.col("_prior.leg_id")).alias("prior_leg_id"), F.when(eligible, F.col("departure_at") - F.col("_prior.arrived_at")).alias("turnaround"),
        known.alias("prior_known"), F.when(known, F.col("_prior.arr_delay")).alias("prior_delay"), F.when(known, F.col("_prior.arr_delay") >= SEVERE).alias("prior_severe"),
        F.when(known, F.col("arr_delay") - F.col("_prior.arr_delay")).alias("delay_growth"), "chain_leg", "chain_delay", "cascade_depth")
    why = F.when(F.col("tail").isNull(), "no_tail").otherwise("no_time")
    rest = clean.where(~usable).select("leg_id", "tail", why.alias("link_status"), F.lit(False).alias("prior_known"))
    return found.unionByName(rest, allowMissingColumns=True)


def link_coverage(links: DataFrame, by: list[str]) -> DataFrame:
    """For each group the legs, candidate and eligible links, links with a known prior outcome, excluded legs for each reason, and rates."""
    candidate = ~F.col("link_status").isin("no_tail", "no_time", "first_leg")
    counts = links.groupBy(*by).agg(
        F.count("*").alias("legs"), F.count_if(candidate).alias("candidate_links"), F.count_if(F.col("link_status") == ELIGIBLE).alias("eligible_links"),
        F.count_if(F.col("prior_known")).alias("known_links"), *[F.count_if(F.col("link_status") == r).alias(r) for r in REASONS])
    return counts.withColumns({"eligible_share": F.col("eligible_links") / F.col("legs"), "known_share": F.col("known_links") / F.nullif("eligible_links", F.lit(0))})
