import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrina.operators import ann, similarity
from vitrina.session import materialize


def unit(m):
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)


def frame(spark, matrix, **columns):
    rows = [(i, [float(x) for x in v], *[c[i] for c in columns.values()]) for i, v in enumerate(matrix)]
    kinds = "".join(f", {n} string" for n in columns)
    return spark.createDataFrame(rows, f"id long, v array<float>{kinds}").repartition(4)


def brute_knn(matrix, k, pool=None):
    u = unit(matrix.astype(np.float32).astype(np.float64))
    s = np.round(u @ u.T, 10)
    out = set()
    for i in range(len(s)):
        others = [j for j in range(len(s)) if j != i and (pool is None or pool[i] == pool[j])]
        others.sort(key=lambda j: (-s[i, j], j))
        out |= {(i, j, r + 1) for r, j in enumerate(others[:k])}
    return out


@pytest.fixture
def data():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8))
    m[50:90] = m[50]  # forty copies of one vector
    m[120] = 0
    return m


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 32)
    monkeypatch.setattr(similarity, "BOUND_ROWS", 16)


def test_knn_join_equals_brute_force(spark, data, small_blocks):
    got = {(r.id, r.neighbour_id, r["rank"]) for r in similarity.knn_join(frame(spark, data), 5).collect()}
    assert got == brute_knn(data, 5)


def test_knn_join_in_pools_with_a_hot_pool(spark, data, small_blocks):
    pool = ["hot" if i % 3 else f"p{i % 40}" for i in range(len(data))]
    rows = frame(spark, data, pool=pool).withColumnRenamed("pool", "city")
    got = {(r.id, r.neighbour_id, r["rank"]) for r in similarity.knn_join(rows, 4, pool=F.col("city")).collect()}
    assert got == brute_knn(data, 4, pool)


def test_fewer_rows_than_k(spark):
    got = similarity.knn_join(frame(spark, np.eye(3)), 10).collect()
    assert sorted((r.id, r.neighbour_id) for r in got) == [(i, j) for i in range(3) for j in range(3) if i != j]


@pytest.mark.parametrize("bound", [10_000, 4])
def test_vector_search_small_and_tiled_queries(spark, data, monkeypatch, bound):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(5)
    q = rng.normal(size=(20, 8))
    monkeypatch.setattr(similarity.against, "__defaults__", (False, bound))
    queries = frame(spark, q).withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.id, r["rank"]) for r in similarity.vector_search(queries, frame(spark, data), 7).collect()}
    s = np.round(unit(q.astype(np.float32).astype(float)) @ unit(data.astype(np.float32).astype(float)).T, 10)
    expected = set()
    for i in range(len(q)):
        order = sorted(range(len(data)), key=lambda j: (-s[i, j], j))[:7]
        expected |= {(i, j, r + 1) for r, j in enumerate(order)}
    assert got == expected


@pytest.mark.parametrize("bound", [10_000, 4])
def test_partner_positions(spark, data, monkeypatch, bound):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 64)
    monkeypatch.setattr(similarity.against, "__defaults__", (False, bound))
    rng = np.random.default_rng(6)
    b = data + rng.normal(size=data.shape)
    rows = frame(spark, data).withColumnRenamed("v", "a").join(frame(spark, b).withColumnRenamed("v", "b"), "id")
    got = {r.id: (r.a_to_b, r.b_to_a) for r in similarity.partner_positions(rows).collect()}
    s = np.round(unit(data.astype(np.float32).astype(float)) @ unit(b.astype(np.float32).astype(float)).T, 10)
    for i in range(len(data)):
        forward = sorted(range(len(data)), key=lambda j: (-s[i, j], j)).index(i) + 1
        back = sorted(range(len(data)), key=lambda j: (-s[j, i], j)).index(i) + 1
        assert got[i] == (forward, back)


def test_identical_sides_find_themselves_first(spark):
    m = np.random.default_rng(7).normal(size=(60, 6))
    rows = frame(spark, m).select("id", F.col("v").alias("a"), F.col("v").alias("b"))
    assert {(r.a_to_b, r.b_to_a) for r in similarity.partner_positions(rows).collect()} == {(1, 1)}


def test_pairwise_summary(spark, data):
    rows = frame(spark, data)
    got = {r.id: r for r in similarity.pairwise_similarity(rows, rows).collect()}
    u = unit(data.astype(np.float32).astype(float))
    s = u @ u.T
    for i in (0, 60, 120):
        assert got[i].n_pairs == 300
        assert got[i].mean_similarity == pytest.approx(s[i].mean(), abs=1e-9)
        assert got[i].max_similarity == pytest.approx(s[i].max(), abs=1e-9)


def test_probing_every_cell_is_exact(spark, data, small_blocks):
    rows = frame(spark, data)
    index = ann.build_cells(rows, n_cells=6)
    queries = rows.select(F.col("id").alias("query_id"), "v")
    exact = brute_knn(data, 3)
    got = ann.ann_knn(queries, index, 3, n_probe=6, exclude_self=True)
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == exact
    wanted = spark.createDataFrame([(i, j) for i, j, _ in exact], "query_id long, id long")
    few = ann.recall_against(ann.ann_knn(queries, index, 3, n_probe=2, exclude_self=True), wanted).first()
    assert 0.3 < few.recall <= 1 and few.n == len(exact)


def test_default_probes_reach_the_recall_target(spark):
    m = np.random.default_rng(21).normal(size=(600, 16))
    rows = frame(spark, m)
    index = ann.build_cells(rows)
    index = ann.CellIndex(index.centres, materialize(index.rows, "cells"))
    wanted = spark.createDataFrame([(i, j) for i, j, _ in brute_knn(m, 5)], "query_id long, id long")
    queries = rows.select(F.col("id").alias("query_id"), "v")
    recall = lambda **how: ann.recall_against(ann.ann_knn(queries, index, 5, exclude_self=True, **how), wanted).first().recall
    by_probes = ann.recall_by_probes(index, 5)
    assert by_probes[-1] == 1 and abs(recall(n_probe=4) - by_probes[3]) < 0.05
    assert recall() > 0.87 and by_probes[3] < 0.87


def test_ragged_vectors_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, v array<float>").coalesce(1)
    with pytest.raises(Exception, match="different dimensions"):
        similarity.pairwise_similarity(df, df).collect()


def test_pruned_knn_is_exact_and_skips_cells(spark, small_blocks):
    rng = np.random.default_rng(12)
    centres = np.eye(8)[rng.integers(0, 8, 400)]
    m = centres + 0.05 * rng.normal(size=(400, 8))
    m[100:140] = m[100]
    m[200] = 0
    rows = frame(spark, m, label=[str(i % 3) for i in range(400)])
    got = ann.exact_knn(rows, 5, n_cells=8).collect()
    assert {(r.id, r.neighbour_id, r["rank"]) for r in got} == brute_knn(m, 5)
    assert all(r.same == (r.id % 3 == r.neighbour_id % 3) for r in got)


@pytest.mark.parametrize("clustered", [False, True])
def test_bounded_neighbours_equal_plain_ones(spark, monkeypatch, clustered):
    from vitrina.operators import similarity as sim

    rng = np.random.default_rng(12)
    m = rng.normal(size=(700, 16))
    if clustered:
        m = rng.normal(size=(30, 16))[rng.integers(0, 30, 700)] * ([4.0] * 4 + [0.3] * 12) + 0.05 * m
    m[5] = m[6] = m[600]
    units = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
    scores = np.round(units @ units.T, 10)
    np.fill_diagonal(scores, -np.inf)
    expected = {(i, r + 1): (int(j), scores[i, j]) for i in range(700) for r, j in enumerate(np.lexsort((np.arange(700), -scores[i]))[:4])}
    monkeypatch.setattr(sim, "WIDE_ROWS", 256)
    monkeypatch.setattr(sim, "BLOCK_ROWS", 100)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "id long, v array<double>")
    found = {(r.id, r["rank"]): (r.neighbour_id, r.similarity) for r in sim.bounded_knn(rows, 4).collect()}
    assert found.keys() == expected.keys()
    assert all(found[x][0] == expected[x][0] and abs(found[x][1] - expected[x][1]) < 1e-9 for x in expected)
    # Tight clusters: the bounds leave most pairs out.
    axes = sim.principal_axes(rows)
    block = sim.Block(None, np.arange(700), units)
    monkeypatch.setattr(sim, "MOST_SCORED", 0.0 if clustered else 1.0)
    whole = sim.bounded_top_k(units, block, np.arange(700), 4, axes)
    monkeypatch.setattr(sim, "MOST_SCORED", 1.0 if clustered else 0.0)
    bounded = sim.bounded_top_k(units, block, np.arange(700), 4, axes)
    assert (whole[0] == bounded[0]).all() and (whole[1] == bounded[1]).all()


def test_bounded_neighbours_of_few_rows(spark):
    from vitrina.operators import similarity as sim

    for n in (0, 1, 2):
        rows = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(n)], "id long, v array<double>")
        assert sim.bounded_knn(rows, 4).count() == n * (n - 1)


def test_wide_tiles_copy_rows_less_and_hand_on_reduced_rows(spark, data, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(similarity, "BLOCK_ROWS", 8)
    monkeypatch.setattr(similarity.against, "__defaults__", (False, 4))
    queries = frame(spark, data).withColumnRenamed("id", "query_id")
    found = similarity.vector_search(queries, frame(spark, data), 3)
    # 300 rows are 38 blocks of 8; a row goes to 4 tiles, enough for 8 cores.
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "sequence(0, (__gr" in plan and "4 AS __gl" in plan and "4 AS __gr" in plan
    # Strips and reduction in this process: partial rows are few at any time.
    monkeypatch.setattr(similarity, "HELD_ROWS", 40)
    table = pa.table({"id": list(range(len(data))), "v": [list(map(float, x)) for x in data]})
    block, sizes = similarity.make_block(table), []

    def part(a, b):
        scores = similarity.similarities(a, b)
        r, c = similarity.top_k_rows(scores, b.ids, 3)
        sizes.append(len(a.ids))
        return pa.table({"id": a.ids[r], "other": b.ids[c], "score": scores[r, c]})

    best = similarity.best_rows("id", "other", "score", 3)
    rows = similarity.reduced((part(a, b) for b in block.strips() for a in block.strips()), best).to_pylist()
    assert max(sizes) == 8 and len(sizes) == 38 * 38 and len(rows) == 3 * len(data)
    s = np.round(unit(data) @ unit(data).T, 10)
    for i in (0, 7, 299):
        expected = sorted(range(len(data)), key=lambda j: (-s[i, j], j))[:3]
        assert [r["other"] for r in rows if r["id"] == i] == expected
    total = similarity.summed_rows(n="sum", least="min")(pa.table({"id": [1, 2, 1], "n": [1, 2, 3], "least": [5, 6, 4]}))
    assert sorted(map(tuple, (r.values() for r in total.to_pylist()))) == [(1, 4, 4), (2, 2, 6)]
