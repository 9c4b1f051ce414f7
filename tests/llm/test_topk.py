import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrina.llm import topk


def brute_force(rows, k):
    vectors = []
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors.append((vec_id, [int(np.floor(1024 * float(x))) for x in v]))
    asked = {}
    for vec_id, v in vectors:
        if vec_id % 10 == 0:
            asked[vec_id] = min(asked.get(vec_id, v), v)
    out = set()
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("bins, block", [(1024, 4096), (4, 2)])
def test_equals_brute_force(spark, bins, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-3, 4, 3) / 8]) for i in range(150)]
    rows += [(200 + i, [0.125, 0.25, -0.5]) for i in range(40)]  # ties at every place
    rows += [(300, None), (310, [None, 1.0, 1.0]), (320, [float("nan"), 1.0, 1.0]), (330, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(340, []), (350, [1.0]), (351, [2.0]), (400, [0.5, 0.5, 0.5]), (400, [0.25, 0.5, 0.5]), (401, [9.0, 9.0, 9.0]), (401, [9.0, 9.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("score", F.lit(1)).repartition(4)
    vectors = topk.quantized(frame)
    found = topk.top_k(vectors.where("vec_id % 10 = 0"), vectors, k=10, bins=bins, block_queries=block)
    got = [tuple(r) for r in found.collect()]
    expected = brute_force(rows, 10)
    assert set(got) == expected and len(got) == len([1 for _ in got])
    assert found.columns == ["query_id", "rank", "vec_id", "score"]


def test_empty(spark):
    none = topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    some = topk.quantized(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"))
    assert topk.top_k(none, some).count() == 0
    assert topk.top_k(some, none).count() == 0
    assert topk.top_k(some, some).count() == 0
