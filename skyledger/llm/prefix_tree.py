"""Near-duplicate documents by an exact Jaccard join of word-shingle sets in prefix trees.

A set holds the distinct five-word shingles of a document, as 64-bit hashes. Equal sets are one class; only the first
document of a class is compared. Two sets link if 100 * intersection >= 75 * union.

1. In hash order, linked sets share several of their smallest shingles; a class whose smallest shingles are not found often
   enough in other documents links with nothing. 2. For the rest it is asked which of all their shingles other classes
   have; others cannot be in an intersection, and a class with too few shared ones links with nothing. 3. Shingles now have
   a global order, the most common first. A class is filed under its rarest ones, as many as the similarity demands;
   classes that meet there form candidate clusters. 4. A cluster's sets are stored in trees in that order, so sets share
   the overlaps of their common beginnings; a probe walks a tree and leaves a branch when what remains in it, or in the
   probe, cannot reach the overlap needed. Clusters are cut into chunks of at most ``CHUNK`` shingles. First a few hubs of
   each cluster probe all its chunks; every class that is then not in the cluster's largest component probes all chunks
   too. Classes that stay unprobed are linked with each other already, so no component is lost, and no
   more pairs are looked at than that.

Defined cases: a text without words has an empty set, links with nothing and is its own component; fewer than five words
are one shingle; null ids come last and get the smallest id of their component, null if all are; rows with equal ids are
rows of their own; an empty table gives no rows. Only doc_id and text are read to link; all columns pass ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm import exchange
from skyledger.llm.common import from_payload, pack, row_values, shuffle_width, stage, table
from skyledger.llm.linking import components
from skyledger.llm.words import mix, run_hash, window_hashes, words_of

SHINGLE = 5
#: 100 * intersection >= 75 * union, so 7 * intersection >= 3 * (sum of sizes).
HUBS, CHUNK = 16, 1 << 20
SET_SCHEMA = "block long, ids binary, sizes binary, first binary, shingles binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def needed(size: np.ndarray) -> np.ndarray:
    """The least overlap that a set of this size has with any set it links with."""
    return -(-3 * size // 4)


def extra(size: np.ndarray) -> np.ndarray:
    """How many of its smallest shingles a set is asked to share."""
    return np.maximum(1, size // 8)


class Sets:
    """The shingle sets of a block's texts: ``values[first[i]:first[i + 1]]`` in rising order."""

    def __init__(self, texts: pa.Array):
        words = words_of(texts, lower=True)
        hashes, count, begin = words.hashes(), words.count, words.first[:-1]
        n = np.where(count >= SHINGLE, count - SHINGLE + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[row]
        value = window_hashes(hashes, SHINGLE)[place] if len(place) else np.empty(0, np.uint64)
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        if len(short):
            value = np.concatenate([value, run_hash(hashes, begin[short], begin[short] + count[short])])
            row = np.concatenate([row, short])
        order = np.argsort(value)
        order = order[np.argsort(row[order], kind="stable")]
        value, row = value[order], row[order]
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        self.values, self.row = value[keep], row[keep]
        self.first = np.searchsorted(self.row, np.arange(len(n) + 1))
        self.size = np.diff(self.first)

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that do not depend on the order of a set."""
        out = []
        for salt in (_ODD, np.uint64(0xC2B2AE3D27D4EB4F)):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.values * salt + np.uint64(1)), dtype=np.uint64)])
            out.append(sums[self.first[1:]] - sums[self.first[:-1]])
        return out[0], out[1]

    def smallest(self) -> np.ndarray:
        """Marks the shingles by which a set is looked for in hash order."""
        length = self.size - needed(self.size) + extra(self.size)
        return np.arange(len(self.values)) - self.first[self.row] < length[self.row]


def row_ids(block: int, n: int) -> np.ndarray:
    """Numbers of a block's rows: task, block in the task, row. A block has at most ``BLOCK_ROWS`` rows, below 2 ** 14."""
    return ((block >> 32) << 40) + ((block & 0xFFFFFFFF) << 14) + np.arange(n, dtype=np.int64)


def block_of(number):
    return F.shiftright(number, 40) * F.lit(1 << 32) + F.shiftright(number, 14).bitwiseAND(F.lit((1 << 26) - 1))


def _slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, payload in row_values(batches, "block", "payload"):
        rows = from_payload(payload)
        sets = Sets(rows["text"])
        one, two = sets.signatures()
        yield pa.RecordBatch.from_arrays(
            [pa.array(row_ids(block, rows.num_rows)), rows["doc_id"].combine_chunks().cast(pa.int64()), pa.array(sets.size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
            ["id", "doc_id", "n", "sig1", "sig2"])


def _send(block: int, values: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    keys, bucket, order = exchange.distinct(values, buckets)
    count = np.unique(values, return_counts=True)[1][order] if len(values) else np.empty(0, int)
    yield from exchange.sent(block, keys, bucket, (count > 1).astype(np.uint8))


def _send_smallest(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, payload in row_values(batches, "block", "payload"):
            sets = Sets(from_payload(payload)["text"])
            yield from _send(block, sets.values[sets.smallest()], buckets)

    return run


def _marks_of(values: np.ndarray, marks, buckets: int) -> np.ndarray:
    """The mark of each value, repeated values included."""
    keys, _, _ = exchange.distinct(values, buckets)
    got = exchange.received(marks)
    order = np.argsort(keys)
    return got[order][np.searchsorted(keys[order], values)] if len(keys) else np.empty(0, np.uint8)


def _survivors(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The whole sets of those first documents of a class that may link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, payload, marks, firsts in row_values(batches, "block", "payload", "marks", "firsts"):
            sets = Sets(from_payload(payload)["text"])
            small = np.flatnonzero(sets.smallest())
            shared = _marks_of(sets.values[small], marks, buckets) > 0
            often = np.bincount(sets.row[small[shared]], minlength=len(sets.size))
            keep = np.zeros(len(sets.size), bool)
            keep[np.array(firsts or [], int)] = True
            keep &= (sets.size > 0) & (often >= extra(needed(sets.size)))
            if keep.any():
                rows = np.flatnonzero(keep)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block]), "ids": pa.array([row_ids(block, len(keep))[rows].tobytes()], pa.binary()), "sizes": pa.array([sets.size[rows].astype(np.int64).tobytes()], pa.binary()),
                    "first": pa.array([np.concatenate([[0], np.cumsum(sets.size[rows])]).astype(np.int64).tobytes()], pa.binary()), "shingles": pa.array([sets.values[keep[sets.row]].tobytes()], pa.binary())})

    return run


def _send_all(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, shingles in row_values(batches, "block", "shingles"):
            yield from _send(block, np.frombuffer(shingles, np.uint64), buckets)

    return run


def _order(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each class's shared shingles in the global order, as numbers that sort so; classes with too few of them go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, first, shingles, marks in row_values(batches, "ids", "sizes", "first", "shingles", "marks"):
            value, first = np.frombuffer(shingles, np.uint64), np.frombuffer(first, np.int64)
            often = _marks_of(value, marks, buckets).astype(np.uint64)
            key = (np.uint64(255) - often) << np.uint64(56) | value >> np.uint64(8)
            out = []
            for number, size, a, b in zip(np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), first[:-1], first[1:]):
                own = np.unique(key[a:b][often[a:b] > 0])
                if len(own) >= needed(size):
                    out.append((int(number), int(size), len(own), own.tobytes()))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], ["class", "n", "size", "keys"])

    return run


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each class, one of which any set that it links with has among its own."""
    for batch in batches:
        owner, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for number, n, size, packed in zip(*(batch.column(c).to_pylist() for c in ("class", "n", "size", "keys"))):
            # Unshared shingles are rarer than all others and take their part of the n - needed + 1.
            length = int(n - needed(np.int64(n)) + 1 - (n - size))
            keys.append(np.frombuffer(packed, np.uint64)[size - length:])
            owner.append(np.full(length, number))
        yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys).view(np.int64)), "class": pa.array(np.concatenate(owner))})


class Tree:
    """Sets as paths of a tree with unbranched stretches drawn together; a set is a rising array."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        paths = [s.astype(">u8").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=paths.__getitem__)
        self.member = np.array(order)
        flat = np.concatenate([sets[i] for i in order]) if sets else np.empty(0, np.uint64)
        self.known, self.place = np.unique(flat, return_inverse=True)
        length = np.array([len(sets[i]) for i in order], np.int64)
        base = np.cumsum(length) - length
        parent, start, end, rep, terminal, stack = [-1], [0], [0], [0], [], [0]
        for i, at in enumerate(order):
            common = 0
            if i:
                before, now = sets[order[i - 1]], sets[at]
                shorter = min(len(before), len(now))
                other = np.flatnonzero(before[:shorter] != now[:shorter])
                common = int(other[0]) if len(other) else shorter
            last = -1
            while end[stack[-1]] > common:
                last = stack.pop()
            if end[stack[-1]] < common:
                parent.append(stack[-1])
                start.append(end[stack[-1]])
                end.append(common)
                rep.append(rep[last])
                parent[last], start[last] = len(parent) - 1, common
                stack.append(len(parent) - 1)
            if len(sets[at]) > common or not i:
                parent.append(stack[-1])
                start.append(common)
                end.append(len(sets[at]))
                rep.append(i)
                stack.append(len(parent) - 1)
            terminal.append(stack[-1])
        self.parent, self.end, self.terminal = np.array(parent), np.array(end), np.array(terminal)
        first = base[np.array(rep)] if len(base) else np.zeros(1, np.int64)
        self.first, self.last = first + np.array(start), first + self.end
        self.sizes = np.asarray(sizes, np.int64)[self.member] if len(order) else np.empty(0, np.int64)
        n = len(parent)
        self.smallest, self.longest = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        np.minimum.at(self.smallest, self.terminal, self.sizes)
        np.maximum.at(self.longest, self.terminal, length)
        level = np.zeros(n, np.int64)
        rising = np.argsort(self.end, kind="stable")
        for node in rising[::-1]:
            if (up := parent[node]) >= 0:
                self.smallest[up] = min(self.smallest[up], self.smallest[node])
                self.longest[up] = max(self.longest[up], self.longest[node])
        for node in rising:
            if parent[node] >= 0:
                level[node] = level[parent[node]] + 1
        self.levels = [np.flatnonzero(level == i) for i in range(1, int(level.max()) + 1)]

    def linked(self, probe: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the sets that a set of ``size`` shingles, of which ``probe`` are shared ones, links with."""
        marks = np.zeros(len(self.known) + 1, np.int64)
        at = np.searchsorted(self.known, probe)
        marks[at[self.known[np.minimum(at, len(self.known) - 1)] == probe]] = 1
        overlap, alive = np.zeros(len(self.parent), np.int64), np.zeros(len(self.parent), bool)
        alive[0] = True
        for nodes in self.levels:
            nodes = nodes[alive[self.parent[nodes]]]
            if not len(nodes):
                break
            run = self.last[nodes] - self.first[nodes]
            ahead = np.cumsum(run) - run
            spread = np.arange(int(run.sum())) + np.repeat(self.first[nodes] - ahead, run)
            got = overlap[self.parent[nodes]] + np.add.reduceat(marks[self.place[spread]], ahead)
            overlap[nodes] = got
            here = self.known[self.place[self.last[nodes] - 1]]
            left = np.minimum(self.longest[nodes] - self.end[nodes], len(probe) - np.searchsorted(probe, here, side="right"))
            alive[nodes] = 7 * (got + left) >= 3 * (size + self.smallest[nodes])
        hit = alive[self.terminal] & (7 * overlap[self.terminal] >= 3 * (size + self.sizes))
        return self.member[hit]


def _probe(members: pa.Table, probes: pa.Table) -> pa.Table:
    """Links of the probes with the members of their own clusters, in one chunk of one or several clusters."""
    a, b = [], []
    cluster = members["cluster"].to_numpy()
    asked = probes["cluster"].to_numpy() if probes.num_rows else np.empty(0, np.int64)
    own, others = members["class"].to_numpy(), probes["class"].to_numpy() if probes.num_rows else None
    for number in np.unique(asked):
        at = np.flatnonzero(cluster == number) if len(cluster) else []
        if not len(at):
            continue
        tree = Tree([np.frombuffer(members["keys"][int(i)].as_buffer(), np.uint64) for i in at], members["n"].to_numpy()[at])
        for i in np.flatnonzero(asked == number):
            found = own[at[tree.linked(np.frombuffer(probes["keys"][int(i)].as_buffer(), np.uint64), int(probes["n"][int(i)].as_py()))]]
            found = found[found != others[i]]
            a.append(np.full(len(found), others[i]))
            b.append(found)
    none = [np.empty(0, np.int64)]
    return pa.table({"a": np.concatenate(a or none).astype(np.int64), "b": np.concatenate(b or none).astype(np.int64)})


GROUP = ("single", "key", "chunk", "part")


def _links(members: DataFrame, probes: DataFrame, bins: int) -> DataFrame:
    """Every probe against every chunk of its cluster; parts of many probes meet copies of a chunk."""
    parts = probes.groupBy(F.col("cluster").alias("of")).agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("parts"))
    asked = probes.join(parts, F.col("cluster") == F.col("of")).drop("of")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("class", F.lit(2)), F.col("parts"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = members.join(parts, F.col("cluster") == F.col("of")).drop("of").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def grouped(rows: DataFrame) -> DataFrame:
        single = (F.col("chunks") == 1) & (F.col("parts") == 1)
        key = F.when(single, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster"))
        return rows.select("class", "n", "keys", "cluster", single.alias("single"), key.cast("long").alias("key"), F.col("chunk").cast("int").alias("chunk"), F.col("part").cast("int").alias("part"))

    return stage(grouped(held).groupBy(*GROUP).cogroup(grouped(asked).groupBy(*GROUP)).applyInArrow(_probe, "a long, b long"), "tree-links")


def _candidates(blocks: DataFrame, firsts: DataFrame) -> DataFrame:
    """class, n, size, keys of all classes that may link with another."""
    buckets = shuffle_width(blocks)
    marks = exchange.shared(blocks.select("block", "payload").mapInArrow(_send_smallest(buckets), exchange.SENT_SCHEMA)).withColumnRenamed("block", "b1")
    joined = blocks.join(marks, F.col("block") == F.col("b1")).join(firsts, F.col("block") == F.col("b2")).select("block", "payload", "marks", "firsts")
    sets = stage(joined.mapInArrow(_survivors(buckets), SET_SCHEMA), "tree-sets")
    marks = exchange.shared(sets.select("block", "shingles").mapInArrow(_send_all(buckets), exchange.SENT_SCHEMA)).withColumnRenamed("block", "b1")
    ordered = sets.join(marks, F.col("block") == F.col("b1")).select("ids", "sizes", "first", "shingles", "marks")
    return stage(ordered.mapInArrow(_order(buckets), "class long, n long, size long, keys binary"), "tree-ordered")


def _joined(candidates: DataFrame, bins: int) -> DataFrame:
    """node, component over the classes that link with another."""
    filed = stage(candidates.select("class", "n", "size", "keys").mapInArrow(_filed, "key long, class long"), "tree-filed")
    centres = stage(filed.groupBy(F.col("key").alias("of")).agg(F.min("class").alias("centre"), F.count("*").alias("k")).where("k > 1").drop("k"), "tree-centres")
    meeting = filed.join(centres, F.col("key") == F.col("of")).select(F.col("class").alias("a"), F.col("centre").alias("b")).distinct()
    clusters = components(meeting).withColumnRenamed("component", "cluster")
    placed = candidates.select("class", "n", "size").join(clusters, F.col("class") == F.col("node")).drop("node")
    placed = stage(placed, "tree-placed")
    totals = placed.groupBy(F.col("cluster").alias("of")).agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("classes"))
    placed = stage(placed.join(totals, F.col("cluster") == F.col("of")).drop("of").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")), "tree-placed")
    sets = candidates.select(F.col("class").alias("own"), "keys")
    members = stage(placed.join(sets, F.col("class") == F.col("own")).drop("own"), "tree-members")
    probing = members.toDF(*members.columns)  # the same table under other attributes, to meet itself
    first = Window.partitionBy("cluster").orderBy((F.col("n") - F.col("size")) / F.col("n"), "class")
    hubs = placed.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= HUBS).select(F.col("class").alias("hub"))
    links = _links(members, probing.join(hubs, F.col("class") == F.col("hub"), "left_semi"), bins)
    parts = stage(placed.join(components(links), F.col("class") == F.col("node"), "left").select("class", "cluster", "classes", F.coalesce("component", "class").alias("component")), "tree-parts")
    sizes = parts.where(F.col("classes") > HUBS).groupBy("cluster", "component").agg(F.count("*").alias("k"))
    main = stage(sizes.groupBy(F.col("cluster").alias("of")).agg(F.max_by("component", F.struct("k", "component")).alias("main")), "tree-main")
    rest = parts.join(main, F.col("cluster") == F.col("of")).where("component <> main").select(F.col("class").alias("left_over"))
    more = _links(members, probing.join(rest, F.col("class") == F.col("left_over"), "left_semi"), bins)
    return components(links.unionByName(more))


def linked(docs: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The packed blocks of ``docs``, and for each row: id (its place in them), doc_id, n, class, component (a class)."""
    blocks = pack(docs, "tree", *columns)
    slim = stage(blocks.select("block", "payload").mapInArrow(_slim, "id long, doc_id long, n long, sig1 long, sig2 long"), "tree-slim")
    classes = stage(slim.where("n > 0").groupBy(F.col("sig1").alias("s1"), F.col("sig2").alias("s2"), F.col("n").alias("m")).agg(F.min("id").alias("class")), "tree-classes")
    firsts = classes.groupBy(block_of(F.col("class")).alias("b2")).agg(F.collect_list(F.col("class").bitwiseAND(F.lit((1 << 14) - 1)).cast("int")).alias("firsts"))
    candidates = _candidates(blocks, firsts)
    groups = stage(_joined(candidates, shuffle_width(blocks)), "tree-groups")
    classed = slim.join(classes, (F.col("sig1") == F.col("s1")) & (F.col("sig2") == F.col("s2")) & (F.col("n") == F.col("m")), "left")
    rows = classed.join(groups, F.col("class") == F.col("node"), "left")
    return blocks, stage(rows.select("id", "doc_id", "n", F.coalesce("class", "id").alias("class"), F.coalesce("component", "class", "id").alias("component")), "tree-rows")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, null last, then the first in store."""
    blocks, rows = linked(docs, *docs.columns)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("first"))
    chosen = first.groupBy(block_of(F.col("first.id")).alias("of")).agg(F.collect_list(F.col("first.id").bitwiseAND(F.lit((1 << 14) - 1)).cast("int")).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for payload, keep in row_values(batches, "payload", "keep"):
            yield from from_payload(payload).take(pa.array(sorted(keep))).combine_chunks().to_batches()

    return blocks.join(chosen, F.col("block") == F.col("of")).select("payload", "keep").mapInArrow(run, docs.schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    _, rows = linked(table(spark, folder, "documents"), "doc_id", "text")
    least = stage(rows.groupBy(F.col("component").alias("of")).agg(F.min("doc_id").alias("component_id")), "tree-least")
    return rows.join(least, F.col("component") == F.col("of")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 5], ' ') AS run FROM d, LATERAL (SELECT unnest(range(greatest(len(ws) - 4, 1))) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON d.doc_id = c.a"""
