"""Line rules, source mix and URL cascade on small tables with nulls, ties and clashing columns; SQL states the results."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.llm import line_rules, mixing, urls
from tests.compare import compare


def duck(name, rows, columns):
    connection = duckdb.connect()
    frame = pd.DataFrame(rows, columns=columns).astype(object).where(lambda x: x.notna(), None)
    kinds = {"doc_id": "BIGINT", "page_id": "BIGINT"}
    connection.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {kinds.get(c, 'VARCHAR')}' for c in columns)})")
    if rows:
        connection.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", frame.values.tolist())
    return connection


def save(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("size", F.lit(1)).withColumn("kept", F.lit("x")).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


BOILER = "all rights reserved by the owners of this site today"
DOCS = [
    *[(i, f"{BOILER}\nown {i}\n{BOILER if i % 2 else 'x'}", "s") for i in range(12)],
    *[(100 + i, f"{BOILER.upper()}  \n  ", "s") for i in range(3)], (200, None, "s"), (201, "", None), (202, " \n\t", None), (203, "a b c d e " * 9, "t"), (203, "a b c d e " * 9, "t"),
    (None, "Ä#b $c\r\nÄ#b $c\r\n\nÄ#b $c\r\nÄ#b $c", None), (205, "one two three four five six seven eight nine ten|", None), (206, "w " * 3000, "u"),
]


@pytest.mark.parametrize("rows", [DOCS, []])
def test_line_rules(spark, tmp_path, rows):
    folder = save(spark, tmp_path, "documents", rows, "doc_id long, text string, source string")
    ok, text = compare(line_rules.query(spark, folder), duck("documents", rows, ["doc_id", "text", "source"]), line_rules.SQL)
    assert ok, text


def test_depleted_documents_are_rejected(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    rows = {r["doc_id"]: r for r in line_rules.judged(docs).collect()}
    assert rows[0]["removed_words"] == 11 and not rows[0]["kept"] and not rows[0]["base_failed"]
    assert rows[205]["kept"]


@pytest.mark.parametrize("rows", [DOCS, [(1, "a b", None)], [(1, None, "s"), (2, "", "s")], []])
def test_mix(spark, tmp_path, rows):
    folder = save(spark, tmp_path, "documents", rows, "doc_id long, text string, source string")
    ok, text = compare(mixing.query(spark, folder), duck("documents", rows, ["doc_id", "text", "source"]), mixing.SQL)
    assert ok, text
    assert sorted(map(str, mixing.query(spark, folder).collect())) == sorted(map(str, mixing.query(spark, folder).collect()))


def test_a_line_in_many_copies_is_repeated(spark):
    """A thousand exact copies are a thousand documents, and a large host does not raise the limit."""
    copy = "the same page that was copied over and over again by everyone\nwith its second line of more than a few words"
    rows = [(i, copy, "hot") for i in range(1000)] + [(2000 + i, f"page {i} of the hot host says something of its own here {i}\nfooter of six pages only" if i < 6 else f"page {i} of the hot host has eleven words of its own", "hot") for i in range(400)]
    rows += [(5000 + i, copy, "cold") for i in range(5)]
    found = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in line_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(found[i] == (22, False) for i in range(1000)) and all(found[5000 + i] == (0, True) for i in range(5))
    assert all(found[2000 + i] == ((5, True) if i < 6 else (0, True)) for i in range(400))


@pytest.mark.parametrize("name", ["_cut", "_of", "_whole", "_taken", "copies", "cut", "target", "doc", "doc_hash", "source_size"])
def test_mixed_keeps_clashing_columns(spark, name):
    docs = spark.createDataFrame([(i, "w " * (i % 7), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string").withColumn(name, F.lit("own"))
    rows = mixing.mixed(docs).collect()
    assert rows and rows[0].__fields__ == ["doc_id", "text", "source", *([name] if name != "copies" else []), "copies"]
    assert name == "copies" or {r[name] for r in rows} == {"own"}


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string").withColumn("copies", F.lit("own"))
    rows = mixing.mixed(docs).collect()
    assert {r["copies"] for r in rows} <= {1, 2} and rows[0].__fields__ == ["doc_id", "text", "source", "copies"]


PAGES = [
    (1, "http://A.Example.ORG/es/1?x"), (2, "https://example.org/en/17#f"), (3, "http://x.org"), (4, None), (5, "nothing"), (6, "http://w.com/fr/"), (7, "http://w.com/de/://y"), (8, "http://notorg/"),
    (9, "http://HOST/a?utm_source=f"), (10, "http://host/b?utm_source=f"), (11, "http://host?utm_source=g"), (12, "http://other/"), (12, "http://other/"), (None, "http://host#utm_source="), (13, "://"), (14, "http:///p"), (15, "http://org/\n"),
]


@pytest.mark.parametrize("rows", [PAGES, []])
def test_urls(spark, tmp_path, rows):
    folder = save(spark, tmp_path, "pages", rows, "page_id long, url string")
    ok, text = compare(urls.query(spark, folder), duck("pages", rows, ["page_id", "url"]), urls.SQL)
    assert ok, text


@pytest.mark.parametrize("words", [1 << 19, 64])
def test_cascade_is_exact(spark, monkeypatch, words):
    monkeypatch.setattr(urls, "MAX_WORDS", words)
    keys = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where(F.crc32("key") % 4 == 0)
    cascade = urls.Cascade(listed, keys.unionByName(keys.limit(10)))
    assert (cascade.shards > 1) == (words == 64) and len(cascade.levels[0]) > 1
    assert cascade.with_answer(keys, "key", "in").where(F.col("in") != (F.crc32("key") % 4 == 0)).count() == 0
