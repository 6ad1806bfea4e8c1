"""Mixing sources to target weights with hash-threshold histograms.

Each document has a fixed 60-bit hash of its id. A source's target is split into whole copies and a rest; the rest is
filled with the documents whose hash is at or below the source's cut. Cuts come from histograms: words are summed by
(source, hash bucket), the bucket that holds the budget is found, and only that bucket is split again, until it holds
one hash value. Nothing is sorted but the few thousand buckets of a source, and the cuts nest: a larger budget keeps
what a smaller one kept.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null id hashes as the
empty text; rows with equal ids share a hash and are taken together; an empty table gives no rows. Other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.common import stage, table

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12


def hash_of(key: str):
    """The first 60 bits of the MD5 of the id as text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, hash: all that the mix needs to know of a document."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hash_of("doc_id").alias("hash"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target: ``share`` of all words dealt by weight, no source above ``most`` times its words.

    A source is full when its limit for each unit of weight is at most the level that the others would get; the level
    is read off running sums over the sources in that order. One row for each source meets in one task.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)) + 1)
    dealt = by_source.withColumn("weight", weight).withColumn("top", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onwards, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    ranked = dealt.withColumn("level", level).withColumn("open", F.col("top") / F.col("weight") > F.col("level"))
    final = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("top") / F.col("weight"))).over(everything)
    return ranked.withColumn("final", final).select("source", "source_size", F.when(F.col("open"), F.col("final") * F.col("weight")).otherwise(F.col("top")).alias("target"))


def cuts(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, copies, cut: every document is taken ``copies`` times, and once more if hash <= cut."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("copies", copies).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    state = stage(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("done", F.col("left") <= 0).withColumn("cut", F.lit(-1).cast("long")), "mix-level")
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        inside = sizes.withColumnRenamed("source", "of").join(state.where("not done"), F.col("of").eqNullSafe(F.col("source")))
        inside = inside.where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        bars = inside.groupBy("of", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.first("left").alias("budget"))
        running = bars.withColumn("upto", F.sum("words").over(Window.partitionBy("of").orderBy("bucket")))
        edge = running.groupBy("of").agg(
            F.min_by(F.struct("bucket", "words", "upto", "low", "high"), F.when(F.col("upto") > F.col("budget"), F.col("bucket"))).alias("edge"),
            F.max("high").alias("all_high"))
        last = F.col("edge.low") == F.col("edge.high")
        over, under = F.col("edge.upto") - F.col("left"), F.col("left") - (F.col("edge.upto") - F.col("edge.words"))
        ended = F.col("done") | F.col("of_missing") | F.col("edge.bucket").isNull() | last
        cut = (F.when(F.col("done") | F.col("of_missing"), F.col("cut")).when(F.col("edge.bucket").isNull(), F.col("all_high"))
               .when(last & (over < under), F.col("edge.high")).when(last, F.col("edge.low") - 1).otherwise(F.col("cut")))
        left = F.when(ended, F.col("left")).otherwise(F.col("left") - (F.col("edge.upto") - F.col("edge.words")))
        joined = state.join(edge.withColumn("seen", F.lit(True)), F.col("of").eqNullSafe(F.col("source")), "left").withColumn("of_missing", F.col("seen").isNull())
        state = stage(joined.select("source", "source_size", "target", "copies", left.alias("left"), F.coalesce("edge.bucket", "prefix").alias("prefix"), ended.alias("done"), cut.alias("cut")), "mix-level")
        if state.where("not done").isEmpty():
            break
    return state.select("source", "source_size", "target", "copies", "cut")


def mix_plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The measured documents, and the cuts of their sources."""
    sizes = stage(measured(docs), "mix-sizes")
    return sizes, cuts(sizes, targets(sizes))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes at least once, with a column ``copies``, which replaces one of that name.

    A document is joined as one struct, so none of its columns can clash with those of the plan.
    """
    _, plan = mix_plan(docs)
    own = [c for c in docs.columns if c != "copies"]
    rows = docs.select(F.struct(*own).alias("doc"), F.col("source").alias("doc_source"), hash_of("doc_id").alias("doc_hash"))
    taken = F.col("copies") + (F.col("doc_hash") <= F.col("cut")).cast("long")
    found = rows.join(plan, F.col("doc_source").eqNullSafe(F.col("source"))).withColumn("copies", taken).where("copies > 0")
    return found.select(*[F.col("doc").getField(c).alias(c) for c in own], "copies")


def query(spark: SparkSession, folder: str) -> DataFrame:
    sizes, plan = mix_plan(table(spark, folder, "documents"))
    plan = plan.withColumnRenamed("source", "of")
    taken = F.col("size") * (F.col("copies") + (F.col("hash") <= F.col("cut")).cast("long"))
    return sizes.join(plan, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix_sql(documents: str = "documents") -> str:
    """A row for each document with copies ``n``; the sum over documents in hash order meets the rest of the target."""
    return f"""
sized AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash FROM {documents}),
by_source AS (SELECT source, CAST(sum(size) AS DOUBLE) AS total FROM sized GROUP BY source),
weighed AS (SELECT *, 2 * total AS top, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM by_source),
levels AS (SELECT *, top / weight AS ratio, ((SELECT sum(total) FROM by_source) * 1.5 - coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goals AS (SELECT source, total, CASE WHEN ratio > level THEN (SELECT min_by(level, ratio) FROM levels WHERE ratio > level) * weight ELSE top END AS target FROM levels),
rests AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS whole FROM goals),
ranked AS (SELECT s.*, total, target, whole, target - whole * total AS rest,
    sum(size) OVER (PARTITION BY s.source ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY s.source, hash) AS own FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source),
mixed AS (SELECT *, whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END AS n FROM ranked)"""


SQL = f"WITH {mix_sql()} SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, target, CAST(size * n AS BIGINT) AS taken FROM mixed"
