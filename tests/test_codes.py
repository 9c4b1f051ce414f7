import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrina.functions.encoders import HashingEncoder
from vitrina.operators import codes
from vitrina.plans.catalog import query_table, vectors
from vitrina.plans.search import encode_queries, hybrid_search
from vitrina.session import scratch_dir


def test_recall_on_stored_vectors_and_texts(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = vectors(spark, sf_dir).select("id", "v")
    index = codes.build_codes(rows, scratch_dir(spark, "codes"))
    stored = index.recall(rows.withColumnRenamed("id", "query_id"), 10, exclude_self=True).first()
    texts = index.recall(encode_queries(query_table(spark, sf_dir), HashingEncoder(64)), 10).first()
    print(stored, texts)
    assert stored.n_queries == rows.count() and min(stored.recall, texts.recall) >= 0.9
    assert max(stored.bytes_share, texts.bytes_share) <= 0.2


def test_scores_are_exact_and_ordered(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(400, 10))
    m[7] = m[3]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())] + [(900, None)], "id long, v array<double>")
    path = scratch_dir(spark, "codes")
    codes.build_codes(rows, path)
    index = codes.read_codes(spark, path)
    units = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
    asked = spark.createDataFrame([(i, v) for i, v in enumerate((m[:5] * 2).tolist())] + [(9, None)], "query_id long, v array<double>")
    # All rows survive, so the search is exact.
    found = [(r.query_id, r["rank"], r.id) for r in index.search(asked, 6, kept=400).collect()]
    scores = np.round(units[:5] @ units.T, 10)
    expected = [(q, r + 1, int(j)) for q in range(5) for r, j in enumerate(np.lexsort((np.arange(400), -scores[q]))[:6])]
    assert sorted(found) == sorted(expected)
    # Codes alone are read before the survivors' vectors.
    plan = index.decoded()._jdf.queryExecution().executedPlan().toString()
    assert "code" in plan and "ReadSchema: struct<id:bigint,code:binary>" in plan


def test_few_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "id long, v array<double>")
    index = codes.build_codes(rows, scratch_dir(spark, "codes"))
    assert [r.id for r in index.search(rows.withColumnRenamed("id", "query_id"), 3, exclude_self=True).orderBy("query_id").collect()] == [2, 1]
    with pytest.raises(ValueError, match="no vectors"):
        codes.build_codes(rows.limit(0), scratch_dir(spark, "codes"))


def test_hybrid_search_with_codes(spark):
    texts = ["leche entera", "pan de molde", "agua con gas", "queso curado"]
    encoder = HashingEncoder(32)
    encode = encoder.open()
    rows = [(i, t, None, v) for i, (t, v) in enumerate(zip(texts, encode(texts).tolist()))]
    items = spark.createDataFrame(rows, "id long, product_name string, product_description string, e array<double>")
    index = codes.build_codes(items.select("id", F.col("e").alias("v")), scratch_dir(spark, "codes"))
    asked = spark.createDataFrame([(1, "queso curado"), (2, "agua")], "query_id long, text string")
    plain, coded = (hybrid_search(asked, items, "e", encoder, 3, index=i).vector for i in (None, index))
    key = lambda r: (r.query_id, r["rank"], r.id)
    assert sorted(map(key, plain.collect())) == sorted(map(key, coded.collect()))
