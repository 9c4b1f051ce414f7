import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrina.operators import ordering


@pytest.fixture
def many_ranges(monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 300)


def test_dense_index_and_assign_ids(spark, many_ranges):
    df = spark.range(5000).select((F.col("id") * F.col("id") + 7).alias("key")).repartition(5)
    rows = ordering.dense_index(df, "key").orderBy("key").collect()
    assert [r.idx for r in rows] == list(range(5000))
    existing = spark.createDataFrame([(41,), (7,)], "id long")
    ids = [r.id for r in ordering.assign_ids(df, "key", existing).orderBy("key").collect()]
    assert ids == list(range(42, 5042))
    assert [r.id for r in ordering.assign_ids(df.limit(3), "key").orderBy("id").collect()] == [1, 2, 3]


def test_shift_by_one_wraps(spark, many_ranges):
    df = spark.range(2000).select((F.col("id") * 3).alias("id"), (F.col("id") * 10).alias("v")).repartition(4)
    got = [(r.id, r.p) for r in ordering.shift_by_one(df, "id", "v", "p").orderBy("id").collect()]
    assert got == [(3 * i, 10 * ((i - 1) % 2000)) for i in range(2000)]


def test_exact_percentiles_with_a_hot_value(spark, many_ranges):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=3000), np.where(rng.random(3000) < 0.4, 0.5, rng.random(3000))
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(4)
    wanted = {"a5": ("a", 0.05), "a50": ("a", 0.5), "b50": ("b", 0.5), "b95": ("b", 0.95), "b0": ("b", 0.0), "b100": ("b", 1.0)}
    row = ordering.exact_percentiles(df, wanted).first()
    data = {"a": a, "b": b}
    for name, (c, p) in wanted.items():
        assert row[name] == pytest.approx(np.percentile(data[c], 100 * p), abs=1e-12)


def test_first_n_counts_after_the_filter(spark):
    df = spark.range(20).repartition(3).where("id % 3 <> 0")
    assert [r.id for r in ordering.first_n(df, "id", 5).orderBy("id").collect()] == [1, 2, 4, 5, 7]
    assert ordering.first_n(df, "id", 0).count() == ordering.first_n(df, "id", None).count() == 13
    assert ordering.first_n(df, "id", 50).count() == 13


def test_sample_by_id(spark):
    df = spark.range(10).withColumn("v", F.when(F.col("id") % 2 == 1, F.lit(1)))
    assert [r.id for r in ordering.sample_by_id(df, 2, ["id"], ["v"]).orderBy("id").collect()] == [1, 3]


def test_first_n_over_many_ranges(spark):
    df = spark.range(20_000).selectExpr("(id * 7919) % 20011 AS k", "id AS wide").repartition(8)
    keys = sorted(r.k for r in df.collect())
    for n in (1, 2_500, 19_999, 20_000, 30_000):
        assert sorted(r.k for r in ordering.first_n(df, "k", n).collect()) == keys[:n]


def test_scratch_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from vitrina.session import scratch_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch_dir(cluster, "x")
