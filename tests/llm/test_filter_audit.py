"""The audit of filter interactions against SQL and against applying the filters document by document."""

from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from skyledger.llm import filter_audit
from tests.compare import compare

LONG = " ".join(f"w{i}" for i in range(220))
DOCS = [
    (1, LONG, "s"), (2, LONG, "s"), (2, LONG, "s"), (3, LONG + " $", "s"), (4, "A" * 30 + " " + LONG, "t"), (5, "a " * 300, "t"), (6, None, "t"), (7, "", None), (8, None, ""),
    (None, LONG, "s"), (None, LONG + " $", "u"), (9, "A # A", "s"), (1, "other words", "s"), (10, "A|" * 400, None), (11, "é" * 40 + "A", "s"), (12, "x " * 199 + "y", "s"), (13, "word " * 50_000, "s")]
LABELS = [(1, 1, 0), (1, 0, None), (2, 1, 1), (5, None, 1), (9, 0, 1), (None, 1, 1), (99, 1, 1), (13, 1, None)]


@pytest.mark.parametrize("rows", [DOCS, []])
def test_audit_is_that_of_the_sql(spark, tmp_path, rows):
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in ("part", "mask", "n", "of", "good", "text_hash")})
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("is_good", F.lit("x")).write.parquet(f"{tmp_path}/labels.parquet")
    connection = duckdb.connect()
    for name in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    ok, text = compare(filter_audit.query(spark, str(tmp_path)), connection, filter_audit.SQL)
    assert ok, text


def test_audit_by_hand(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    good, toxic = {1, 2, 13}, {2, 5, 9}

    def fails(doc_id, text):
        words = (text or "").split()
        out = {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * sum("A" <= x <= "Z" for x in text or "") > 2 * len(text or "") else set()
        out |= {"D"} if set("#$%&*|") & set(text or "") else set()
        return out | ({"E"} if doc_id is not None and any(d is not None and d < doc_id and (t or "") == (text or "") for d, t, _ in DOCS) else set())

    want = {}
    for part in {s or "" for _, _, s in DOCS}:
        rows = [(d, fails(d, t)) for d, t, s in DOCS if (s or "") == part]
        every = {}
        for order in map("".join, permutations("ABCDE")):
            left = list(rows)
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                want[part, order, step] = [len(left), len(gone), sum(name in f for _, f in rows) - len(gone), sum(f == {name} for _, f in rows), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                every[name] = every.get(name, 0) + len(gone)
        for key, row in want.items():
            if key[0] == part:
                row.append(every[key[1][key[2] - 1]])
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in filter_audit.audited(docs, labels).collect()}
    assert got == want


def test_fields_do_not_overflow():
    """A count near the largest long leaves its neighbours alone."""
    most = 2**63 - 1
    for outcome in filter_audit.OUTCOMES:
        for mask, wide in enumerate(filter_audit.packed(outcome)):
            fields = filter_audit.unpacked(most * wide, len(filter_audit.steps()))
            assert set(fields.tolist()) <= {0, most}
            assert [f > 0 for f in fields.tolist()] == [filter_audit.OUTCOMES[outcome](mask, own, before) for _, _, own, before in filter_audit.steps()]
