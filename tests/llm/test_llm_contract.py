"""Registered queries against their SQL, and the pipeline against a plain computation."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks import compare as tool
from conftest_llm import WORDS, linked_groups, shingles
from vitrina.llm.queries import LLM_QUERIES, LLM_SQL

SMALL = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in sorted(LLM_QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_query(spark, monkeypatch, name):
    monkeypatch.setitem(tool.REGISTERED, name, LLM_QUERIES[name])
    monkeypatch.setitem(tool.ORACLE, name, LLM_SQL[name])
    assert tool.compare(spark, tool.connect(SMALL), name, SMALL).startswith("ok")


@pytest.mark.parametrize("name, rows", [("op5_token_counts", 200), ("op6_quality", 200), ("op8_mixing", 200), ("op10_extraction", 50), ("op12_token_files", 200)])
def test_whole_tables(spark, name, rows):
    found = LLM_QUERIES[name](spark, SMALL)
    assert found.select(found.columns[0]).distinct().count() == rows


def test_pages_of_the_table(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in LLM_QUERIES["op10_extraction"](spark, SMALL).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()} if name != "packing" else {}
        rows_before = docs.collect()
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), "stage")
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(before[r.doc_id] == r for r in docs.collect())
        kept = [r.doc_id for r in docs.collect()]
        if name == "language":
            assert len(kept) > 0.97 * len(before)
        if name == "quality":
            labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            good = [i for i in before if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
            assert sum(i in kept for i in good) > 0.97 * len(good)
            assert not [i for i in kept if i in labels and labels[i].toxic == 1]
        if name == "near duplicates":
            ordered = sorted(before)
            groups = linked_groups([shingles(before[i].text) for i in ordered])
            assert sorted(kept) == sorted({ordered[g] for g in groups})
        if name == "mixing":
            sizes = {}
            for r in rows_before:
                sizes[r.source] = sizes.get(r.source, 0) + len(WORDS.findall(r.text))
            assert max(kept.count(i) for i in set(kept)) <= 3
            total = sum(len(WORDS.findall(r.text)) for r in docs.collect())
            assert abs(total - sum(sizes.values())) < 0.15 * sum(sizes.values())
        if name == "packing":
            assert docs.agg(F.sum("length")).first()[0] >= len(rows_before)
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert corpus_pipeline.run(spark, SMALL).count() == seen[-1]
