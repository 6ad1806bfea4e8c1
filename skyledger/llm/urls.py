"""URL rules and an exact block list kept as a Bloom filter cascade, in DataFrame operations only.

Level 1 holds the listed keys. Those other keys of the corpus that level 1 lets through are held by level 2, those
listed keys that level 2 lets through by level 3, and so on until no key is wrong. The universe is every distinct key of
the corpus, so the answer is exact for each of them. A key's answer is the parity of the first level that lacks it:
reading bits of arrays, no join.

A level's bits are one array of 64-bit words for each shard of the key space, ``MAX_WORDS`` words in all; they reach
the rows as a scalar subquery, whose size that bound limits. A list that needs more bits than that is split into as
many passes as needed, each holding one shard of the keys, and rows take the answer of the pass of their shard.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; its key is empty and
not listed. Repeated rows and keys give equal answers; empty tables give no rows and no levels; only the columns named
here are read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import stage, table

#: host suffix, path prefix, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Words of 64 bits that one pass may send with the plan: 4 MiB.
MAX_WORDS = 1 << 19
HASHES_FIRST, HASHES_LATER = 6, 1
#: A host is listed when at least this many of its pages, and this share of them, carry a tracking query.
LIST_PAGES, LIST_SHARE = 3, 0.2


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.substring_index(F.regexp_extract(url, r"(?s)://(.*)$", 1), "#", 1)
    rest = F.substring_index(rest, "?", 1)
    raw = F.substring_index(rest, "/", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(rest.substr(F.length(raw) + 1, F.length(rest) + 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, prefix, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(suffix + prefix)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * 64 + i), key), F.lit(bits)) for i in range(hashes)]


def _bit(words: Column, position: Column) -> Column:
    return F.getbit(F.get(words, F.shiftrightunsigned(position, 6).cast("int")), F.pmod(position, F.lit(64)).cast("int")) == 1


def _filter_words(keys: DataFrame, level: int, hashes: int, bits: int) -> DataFrame:
    """One row, ``words``: the level's bits. Its parts are as many as ``bits`` allows, whatever the number of keys."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, hashes, bits))).alias("at"))
    zero = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    one = at.select(F.shiftrightunsigned("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
    whole = zero.unionByName(one).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def _bits_for(keys: int, hashes: int) -> int:
    return max(1024, 64 * math.ceil(keys * hashes / math.log(2) / 64))


class Cascade:
    """Levels of a filter, each ``(level, hashes, bits, shard, shards, one-row table of words)``."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        """``listed`` and ``universe`` have one column ``key``; the universe holds every key that will be asked."""
        both = universe.select("key").distinct().join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left")
        keys = stage(both.select("key", F.coalesce("listed", F.lit(False)).alias("listed")).where("key is not null"), "cascade-keys")
        counts = keys.groupBy("listed").count().collect()  # two rows at most
        n = {r["listed"]: r["count"] for r in counts}
        self.shards = max(1, math.ceil(sum(_bits_for(x, h) for x, h in ((n.get(True, 0), HASHES_FIRST), (n.get(False, 0), HASHES_LATER))) / 64 / MAX_WORDS))
        self.levels: list[list[tuple[int, int, int, DataFrame]]] = []
        for shard in range(self.shards):
            self.levels.append(self._build(keys.where(self._shard(F.col("key")) == shard)))

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.shards))

    def _build(self, keys: DataFrame) -> list[tuple[int, int, int, DataFrame]]:
        inside, outside, levels = keys.where("listed"), keys.where("not listed"), []
        while (n := inside.count()) > 0:
            level, hashes = len(levels), HASHES_LATER if levels else HASHES_FIRST
            bits = _bits_for(n, hashes)
            words = stage(_filter_words(inside, level, hashes, bits), "cascade-level")
            levels.append((level, hashes, bits, words))
            wrong = stage(outside.where(_held(words, F.col("key"), level, hashes, bits)), "cascade-wrong")
            inside, outside = wrong, inside
        return levels

    def answer(self, key: Column, shard: int) -> Column:
        """Whether ``key`` is listed, exact for each key of the universe that belongs to the shard; null is not listed."""
        levels = self.levels[shard]
        answer = F.lit(len(levels) % 2 == 1)
        for level, hashes, bits, words in reversed(levels):
            answer = F.when(_held(words, key, level, hashes, bits), answer).otherwise(F.lit(level % 2 == 1))
        return F.coalesce(answer, F.lit(False)) & key.isNotNull()

    def with_answer(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with the answer in ``name``. More than one shard: one staged pass for each, so that no plan holds two."""
        if self.shards == 1:
            return rows.withColumn(name, self.answer(F.col(key), 0))
        of = F.coalesce(self._shard(F.col(key)), F.lit(0))
        parts = [stage(rows.where(of == i).withColumn(name, self.answer(F.col(key), i)), "cascade-pass") for i in range(self.shards)]
        return reduce(DataFrame.unionByName, parts)


def _held(words: DataFrame, key: Column, level: int, hashes: int, bits: int) -> Column:
    """Whether the level's filter lets the key through."""
    array = words.scalar()
    return reduce(Column.__and__, [_bit(array, p) for p in _positions(key, level, hashes, bits)])


def judged(pages: DataFrame, cascade: Cascade, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict: the longest rule decides, else the cascade's answer for the host."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    listed = F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))
    answered = cascade.with_answer(split, "host", "_listed")
    return answered.select("page_id", "host", "path", name.alias("rule"), F.coalesce(says, listed).alias("verdict"))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """Hosts that a crawl would list: a good part of their pages carries a tracking query."""
    host, _ = host_and_path(F.col("url"))
    tracked = F.coalesce(F.col("url").contains("utm_source="), F.lit(False)).cast("long")
    by_host = pages.select(host.alias("key"), tracked.alias("tracked")).groupBy("key").agg(F.sum("tracked").alias("tracked"), F.count("*").alias("n"))
    return by_host.where((F.col("key") != "") & (F.col("tracked") >= LIST_PAGES) & (F.col("tracked") >= LIST_SHARE * F.col("n"))).select("key")


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    host, _ = host_and_path(F.col("url"))
    return judged(pages, Cascade(listed_hosts(pages), pages.select(host.alias("key"))))


SQL = rf"""
WITH split AS (SELECT page_id, url, coalesce(split_part(split_part(regexp_extract(url, '(?s)://(.*)$', 1), '#', 1), '?', 1), '') AS rest FROM pages),
parts AS (SELECT page_id, url, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM split),
listed AS (SELECT host FROM parts WHERE host <> '' GROUP BY host HAVING sum(CASE WHEN contains(url, 'utm_source=') THEN 1 ELSE 0 END) >= {LIST_PAGES} AND sum(CASE WHEN contains(url, 'utm_source=') THEN 1 ELSE 0 END) >= {LIST_SHARE}::DOUBLE * count(*)),
rules(suffix, prefix, says) AS (VALUES {", ".join(str(r) for r in RULES)}),
best AS (SELECT host, path, max_by(suffix || prefix, length(suffix) + length(prefix)) AS rule, max_by(says, length(suffix) + length(prefix)) AS says
    FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, prefix) GROUP BY host, path)
SELECT page_id, p.host, p.path, b.rule, coalesce(says, CASE WHEN p.host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path"""
