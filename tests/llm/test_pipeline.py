"""Each stage of the pipeline on its predecessor's rows, against plain Python."""


import pytest

import corpus_pipeline
from tests.llm.test_phrase_index import brute as hits
from tests.llm.test_prefix_tree import brute as components
from tests.llm.test_repeats import brute as kept

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs, out = corpus_pipeline.table(spark, FOLDER, "documents"), []
    for name, step in corpus_pipeline.STAGES:
        rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
        docs = corpus_pipeline.stage(step(spark, docs, FOLDER), "test")
        out.append((rows, sorted(docs.collect(), key=lambda r: r["doc_id"])))
    return out


def test_toxic_documents_go(spark, tables):
    before, after = tables[0]
    toxic = {r["doc_id"] for r in corpus_pipeline.table(spark, FOLDER, "labels").collect() if r["toxic"] == 1}
    left = {r["doc_id"] for r in after}
    clean = {r["doc_id"] for r in before} - toxic
    assert len(clean & left) >= 0.98 * len(clean)
    assert set(after) <= set(before)


def test_one_of_near_copies(tables):
    before, after = tables[1]
    found = components([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == {d for d, (n, c) in found.items() if n == 0 or c == d}
    assert set(after) <= set(before)


def test_repeats(tables):
    before, after = tables[2]
    want = {}
    for row, (n, gone, text) in zip(before, kept([(r["doc_id"], r["text"]) for r in before])):
        if gone == 0 or gone < n:
            want[row["doc_id"]] = (row["text"], row["n_chars"]) if gone == 0 else (text, len(text))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after} == want


def test_benchmark(spark, tables):
    before, after = tables[3]
    items = [(r["item_id"], r["text"]) for r in corpus_pipeline.table(spark, FOLDER, "benchmark").collect()]
    found = hits([(r["doc_id"], r["text"]) for r in before], items)
    assert set(after) == {r for r in before if found[r["doc_id"]][1] == 0}


def test_mix(tables):
    before, after = tables[4]
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in before}
    sources = sorted({r["source"] for r in before})
    total = {s: sum(size[r["doc_id"]] for r in before if r["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    goal, open_, left = {}, set(sources), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] <= level * weight[s]}
        if not full:
            goal |= {s: level * weight[s] for s in open_}
            break
        goal |= {s: 2 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    taken = dict.fromkeys(sources, 0)
    for row in after:
        assert 1 <= row["copies"] <= 2
        taken[row["source"]] += row["copies"] * size[row["doc_id"]]
    for s in sources:
        assert abs(taken[s] - goal[s]) <= max(size[r["doc_id"]] for r in before if r["source"] == s)
    assert after[0].__fields__ == [*before[0].__fields__, "copies"]


def test_run_is_the_stages(spark, tables):
    assert sorted(corpus_pipeline.run(spark, FOLDER).collect(), key=lambda r: r["doc_id"]) == tables[-1][1]
