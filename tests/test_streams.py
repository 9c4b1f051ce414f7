"""Streams of items past blocks of queries: the rows of all products."""

import numpy as np
import pytest

from vitrina.operators import ann, codes, similarity, streams
from vitrina.session import scratch_dir

N, D, K = 5000, 12, 4


@pytest.fixture(scope="module")
def matrix():
    m = np.random.default_rng(8).normal(size=(N, D)).astype(np.float32)
    # Copies tie exactly.
    m[10:40] = m[3]
    m[4000:4010] = m[77]
    return m


@pytest.fixture(scope="module")
def rows(spark, matrix):
    made = spark.createDataFrame([(i, v) for i, v in enumerate(matrix.tolist())] + [(N + 5, None)], "id long, v array<float>")
    made.write.parquet(path := scratch_dir(spark, "rows"))
    return spark.read.parquet(path)


def exact(matrix, exclude, allowed=None):
    units = matrix.astype(float) / (np.linalg.norm(matrix.astype(float), axis=1, keepdims=True) + 1e-8)
    scores = np.round(units @ units.T, 10)
    if exclude:
        np.fill_diagonal(scores, -np.inf)
    if allowed is not None:
        scores[~allowed(units)] = -np.inf
    best = [np.lexsort((np.arange(N), -s))[:K] for s in scores]
    return [(q, r + 1, int(j)) for q, b in enumerate(best) for r, j in enumerate(b) if np.isfinite(scores[q, j])]


def listed(found, q="query_id", i="id"):
    return sorted((r[q], r["rank"], r[i]) for r in found.collect())


def test_searches_of_many_queries(spark, rows, matrix, monkeypatch):
    monkeypatch.setattr(similarity, "against", None)  # not used: nothing is copied in tiles
    monkeypatch.setattr(similarity, "within", None)
    monkeypatch.setattr(streams, "CHUNK_ROWS", 700)
    assert listed(similarity.vector_search(rows.withColumnRenamed("id", "query_id"), rows, K)) == exact(matrix, False)
    assert listed(similarity.knn_join(rows, K), "id", "neighbour_id") == exact(matrix, True)


def test_probes_of_many_queries_are_not_copied(spark, rows, matrix, monkeypatch):
    index = ann.build_cells(rows, n_cells=9)
    of = np.zeros(N, int)
    for r in index.rows.select("id", "pool").collect():
        of[r.id] = int(r.pool)
    monkeypatch.setattr(ann, "_search", None)

    def allowed(units):
        met = np.zeros((N, 9), bool)
        r, c = ann._nearest_cells(units, index.centres, 3)
        met[r, c] = True
        return met[:, of]

    found = ann.ann_knn(rows.withColumnRenamed("id", "query_id"), index, K, n_probe=3, exclude_self=True)
    assert listed(found) == exact(matrix, True, allowed)


def test_codes_of_many_queries(spark, rows, matrix, monkeypatch):
    """Codes stay codes until they reach a task, and no row is made for a query and a survivor."""
    index = codes.build_codes(rows, scratch_dir(spark, "codes"))
    asked = rows.withColumnRenamed("id", "query_id")
    decoded = index.decoded().toArrow()
    kept = 40
    told = streams.unit_rows(streams.as_matrix(decoded.column("v"), decoded.num_rows)[np.argsort(decoded.column("id").to_numpy())])
    units = streams.unit_rows(matrix.astype(float))
    near = np.round(units @ told.T, 10)
    monkeypatch.setattr(codes, "vector_search", None)
    monkeypatch.setattr(codes, "cosine", None)
    found = index.search(asked, K, kept=kept, exclude_self=True)
    expected = []
    for q in range(N):
        best = np.lexsort((np.arange(N), -near[q]))[:kept]
        best = best[best != q]
        scores = np.round(units[best] @ units[q], 10)
        expected += [(q, r + 1, int(best[j])) for r, j in enumerate(np.lexsort((best, -scores))[:K])]
    assert listed(found) == expected
    assert index.survivors(asked, 2, kept=kept).count() == N * kept
