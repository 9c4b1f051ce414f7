import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrina.operators import labels, pairs
from vitrina.plans.evaluation import alignment_report, combined_report, relevance_report, search_quality_report
from vitrina.sources.writers import metrics_sink


def frame(spark, vectors, **columns):
    names = list(columns)
    rows = [(i, None if v is None else [float(x) for x in v], *[columns[n][i] for n in names]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, v array<float>" + "".join(f", {n} string" for n in names)).repartition(3)


def partition_frame(spark, a, b):
    return spark.createDataFrame([(str(x), str(y)) for x, y in zip(a, b)], "label string, cluster string")


@pytest.mark.parametrize("a,b,ari,nmi", [
    ([0, 0, 1, 1, 2], [5, 5, 3, 3, 9], 1.0, 1.0),
    ([0, 0, 1, 1], [0, 0, 1, 2], 0.5714285714, 0.8),
    ([0, 0, 0], [1, 1, 1], 1.0, 1.0),
    ([0, 1, 0, 1], [0, 0, 1, 1], -0.5, 0.0),
])
def test_agreement(spark, a, b, ari, nmi):
    row = labels.cluster_agreement(partition_frame(spark, a, b), "label", "cluster").first()
    assert row.ari == pytest.approx(ari, abs=1e-9) and row.nmi == pytest.approx(nmi, abs=1e-9)


def test_separation_guards(spark):
    two = frame(spark, [[1, 0], [0, 1]], label=["a", "b"])
    assert labels.filter_separation(two, "label").count() == 0
    one_label = frame(spark, [[1, 0], [0, 1], [1, 1]], label=["a"] * 3)
    row = labels.filter_separation(one_label, "label").first()
    assert row.inter_mean is None and row.separation is None and row.intra_mean is not None
    singles = frame(spark, [[1, 0], [0, 1], [1, 1]], label=["a", "b", None])
    assert labels.filter_separation(singles, "label").first().intra_mean is None


def test_hybrid_recall_pools(spark):
    v = [[1, 0], [0.9, 0.1], [0, 1], [1, 0.2], [0.5, 0.5], [0.4, 0.6]]
    rows = frame(
        spark, v, country=["x", "x", "x", None, None, "y"], city=["c", "c", "c", None, None, "only"],
        section=["s", "s", "t", None, None, "s"],
    )
    row = labels.hybrid_recall(rows, "country", "city", "section", ks=(1, 5)).first()
    # The lone row of a city and the row without a relevant candidate are left out;
    # null markets and null sections equal each other.
    assert row.queries_evaluated == 4 and row.avg_pool_size == pytest.approx((2 + 2 + 1 + 1) / 4)
    assert row.recall_1 == 1.0 and row.recall_5 == 1.0
    assert labels.hybrid_recall(rows.limit(2), "country", "city", "section").count() == 0
    lonely = frame(spark, v, country=list("abcdef"), city=list("abcdef"), section=["s"] * 6)
    assert labels.hybrid_recall(lonely, "country", "city", "section").count() == 0


def brute_silhouette(m, names):
    u = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
    d = 1 - u @ u.T
    names, out = np.array(names), []
    for i in range(len(m)):
        same = (names == names[i]) & (np.arange(len(m)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, names == other].mean() for other in set(names) - {names[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(40, 5)).astype(np.float32).astype(float)
    names = [f"l{i % 4}" for i in range(39)] + ["alone"]
    rows = frame(spark, m, label=names)
    assert labels.silhouette(rows, "label").first().silhouette == pytest.approx(brute_silhouette(m, names), abs=1e-9)
    assert labels.silhouette(frame(spark, m, label=["x"] * 40), "label").first().silhouette is None
    assert labels.silhouette(frame(spark, m, label=[str(i) for i in range(40)]), "label").first().silhouette is None


def test_kmeans_finds_plain_clusters_and_groups(spark):
    rng = np.random.default_rng(8)
    names = [i % 3 for i in range(60)]
    m = np.eye(3)[names] + 0.05 * rng.normal(size=(60, 3))
    rows = frame(spark, m, label=[f"l{n}" for n in names], country=["x" if i < 30 else "y" for i in range(60)])
    out = labels.kmeans_clusters(rows, "label", n_init=3)
    assert labels.ari(out, "label", "cluster").first().ari == pytest.approx(1)
    report = {r.group: r for r in labels.by_group(rows, "label", "country").collect()}
    assert set(report) == {"x", "y"} and report["x"].ari == pytest.approx(1) and report["x"].knn_1_acc == 1
    assert report["y"].samples == 30 and report["y"].unique_labels == 3


def test_kmeans_costs_no_more_than_the_library(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(21)
    centres = rng.normal(size=(12, 8))
    names = rng.integers(0, 12, 900)
    m = centres[names] + 0.6 * rng.normal(size=(900, 8))
    rows = frame(spark, m, label=[f"l{n}" for n in names], country=["x" if i % 3 else "y" for i in range(900)])
    units = rows.select(array_to_vector(labels.l2_normalize("v")).alias("features"), "country")
    found = labels.kmeans_clusters(rows, "label", "country").toPandas()
    assert len(found) == 900 and set(found.group) == {"x", "y"}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for country in ("x", "y"):
        own = found[found.group == country]
        # The stated cost is that of the rows about the means of their clusters.
        spread = sum(((unit[c.id] - unit[c.id].mean(axis=0)) ** 2).sum() for _, c in own.groupby("cluster"))
        assert own.cost.iloc[0] == pytest.approx(spread, rel=2e-3)
        part = units.where(units.country == country)
        # Ten restarts against three fits of the library: no more than their mean.
        costs = [KMeans(k=12, seed=s).fit(part).summary.trainingCost for s in range(3)]
        assert own.cost.iloc[0] <= np.mean(costs), costs


def test_centres_of_several_passes_and_edges(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(80, 4))
    rows = frame(spark, m, label=[f"l{i % 4}" for i in range(80)], country=[f"c{i % 5}" for i in range(80)])
    whole = labels.kmeans_clusters(rows, "label", "country", n_init=3).toPandas()
    monkeypatch.setattr(labels, "CENTRE_VALUES", 20)
    parts = labels.kmeans_clusters(rows, "label", "country", n_init=3).toPandas()
    assert whole.groupby("group").cost.first().to_dict() == pytest.approx(parts.groupby("group").cost.first().to_dict())
    assert labels.kmeans_clusters(rows.limit(0), "label").count() == 0
    assert labels.kmeans_clusters(rows.withColumn("label", labels.F.lit("one")), "label").count() == 0
    same = frame(spark, np.ones((9, 4)), label=[f"l{i % 3}" for i in range(9)])
    assert labels.kmeans_clusters(same, "label", n_init=2).select("id").count() == 9


def test_pair_metrics_against_numpy(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(101, 6)).astype(np.float32).astype(float)
    b = (0.5 * a + rng.normal(size=a.shape)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, list(x), list(y)) for i, (x, y) in enumerate(zip(a.tolist(), b.tolist()))], "id long, a array<float>, b array<float>")
    ua, ub = (m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8) for m in (a, b))
    roll = np.roll(np.arange(101), 1)
    cos, neg = (ua * ub).sum(1), (ua * ub[roll]).sum(1)
    euc, euc_neg = np.linalg.norm(a - b, axis=1), np.linalg.norm(a - b[roll], axis=1)
    row = pairs.pair_stats(df).first()
    assert row["count"] == 101
    for name, value in {
        "cos_pos_median": np.median(cos), "cos_pos_p95": np.percentile(cos, 95), "euc_pos_p05": np.percentile(euc, 5),
        "cos_neg_p95": np.percentile(neg, 95), "euc_neg_p05": np.percentile(euc_neg, 5), "euc_neg_mean": euc_neg.mean(),
    }.items():
        assert row[name] == pytest.approx(value, abs=1e-9)
    sep = pairs.pair_separation(df).first()
    s = ua @ ub.T
    assert sep.neg_cos_expected == pytest.approx((s.sum() - np.trace(s)) / (101 * 100), abs=1e-9)
    got = {r.direction: r for r in pairs.retrieval_metrics(df, ndcg=True).collect()}
    pos = (s > cos[:, None] + 1e-12).sum(1) + 1
    assert got["text_to_image"].mrr == pytest.approx((1 / pos).mean())
    assert got["text_to_image"].ndcg_5 == pytest.approx(np.where(pos <= 5, 1 / np.log2(1 + pos), 0).mean())
    assert pairs.pair_separation(df.where("id < 0")).count() == 0
    single = pairs.pair_separation(df.where("id = 3")).first()
    assert single["count"] == 1 and single.neg_cos_expected is None


def test_precision_and_sample(spark):
    ranking = spark.createDataFrame(
        [(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False), (2, 2, False), (2, 3, False)], "id long, rank int, same boolean"
    )
    relevant = spark.createDataFrame([(1, 2), (2, 0)], "id long, relevant long")
    row = labels.precision_map(ranking, relevant, 3).first()
    assert row.n_queries == 1 and row.precision_at_k == pytest.approx(2 / 3)
    assert row.map_at_k == pytest.approx((1 + 2 / 3) / 2)
    rows = spark.range(100).withColumn("label", F.when(F.col("id") < 90, "big"))
    counts = {r.label: r["count"] for r in labels.balanced_sample(rows, "label", 20).groupBy("label").count().collect()}
    assert counts == {"big": 20, None: 10}


@pytest.fixture(scope="module")
def products(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        e5, clip = rng.normal(size=4).tolist(), rng.normal(size=4).tolist()
        rows.append((i, "xy"[i % 2], f"c{i % 3}", f"s{i % 4}", f"Pan {i % 5}", f"k{i % 3}", e5, clip, [x + 0.1 for x in clip]))
    return spark.createDataFrame(rows, (
        "id long, country_code string, city_code string, store_name string, product_name string, collection_section string,"
        "text_emb_e5 array<float>, text_emb_clip_multi array<float>, image_emb_clip array<float>"
    )).repartition(2)


def test_reports(spark, products, tmp_path):
    quality = search_quality_report(products, limit=50)
    assert {r.scope for r in quality.collect()} == {
        "hybrid_recall", "filter_separation:collection_section", "filter_separation:store_name"
    }
    relevance = {(r.scope, r.metric): r.value for r in relevance_report(products, proxy="store_name").collect()}
    assert relevance["overall", "samples"] == 60 and ("country:x", "ari") in relevance
    alignment = {(r.scope, r.metric): r.value for r in alignment_report(products).collect()}
    assert alignment["checks", "pairs"] == 60 and alignment["retrieval:text_to_image", "mrr"] > 0.5
    mixed = alignment_report(products.withColumn("image_emb_clip", F.slice("image_emb_clip", 1, 2)))
    assert [(r.metric, r.value) for r in mixed.collect()] == [("pairs", 0.0)]
    combined = combined_report(products, "text_emb_clip_multi", "image_emb_clip", "text_emb_e5", "text_emb_clip_multi", limit=40)
    scopes = {r.scope for r in combined.collect()}
    assert {"pair_stats", "retrieval:image_to_text", "text_to_text", "labels", "clusters"} <= scopes
    path = metrics_sink(quality, str(tmp_path), "search_quality", 50, "none")
    assert path.endswith("_50") and spark.read.json(path).count() == quality.count()


def test_neighbour_shares(spark):
    m = [[math.cos(t), math.sin(t)] for t in (0, 0.1, 1.0, 1.1)]
    rows = frame(spark, m, label=["a", "a", "b", "b"])
    assert labels.knn1_accuracy(rows, "label").first().knn_1_acc == 1.0
    row = labels.label_consistency(rows, "label").first()
    assert row.label_consistency_1 == 1.0 and row.label_consistency_10 == pytest.approx(1 / 3)
    assert list(itertools.chain(row)) == [1.0, pytest.approx(1 / 3), pytest.approx(1 / 3)]


def test_neighbour_metrics_need_rows_and_labels(spark):
    m = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]
    assert labels.knn1_accuracy(frame(spark, m, label=["a", "a", "a"]), "label").count() == 0
    assert labels.label_consistency(frame(spark, m[:2], label=["a", "b"]), "label").count() == 0
    assert labels.knn1_accuracy(frame(spark, m, label=["a", "b", "a"]), "label").count() == 1
