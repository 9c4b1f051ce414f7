import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vitrina.sources import buckets


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(i, f"name {i}", None if i % 3 else [1.0, 2.0]) for i in range(500)] + [(None, "no id", None)]
    frame = spark.createDataFrame(rows, "id long, product_name string, e array<double>")
    return buckets.write_bucketed(frame, str(tmp_path / "products"), shards=8, buckets=4)


def files(path):
    return {str(f): os.stat(f).st_mtime_ns for f in Path(path).glob("shard=*/part-*")}


def test_merge_rewrites_touched_shards_only(spark, stored):
    before = files(stored)
    assert len({f.split("shard=")[1].split("/")[0] for f in before}) == 8
    shards = {r.id: r.shard for r in buckets.bucketed(spark, stored).collect()}
    changed = [i for i in range(500) if shards[i] in (2, 5)][:20]
    new = spark.createDataFrame([(i, [float(i), 0.5]) for i in changed] + [(None, [9.0, 9.0])], "id long, e array<double>")
    buckets.merge_stored(spark, stored, new, "e")
    # Another session knows the table by its folder alone.
    spark.sql(f"DROP TABLE {buckets._name(stored)}")
    found = {r.id: r.e for r in buckets.bucketed(spark, stored).collect()}
    assert len(found) == 501 and found[None] is None
    assert all(found[i] == ([float(i), 0.5] if i in changed else None if i % 3 else [1.0, 2.0]) for i in range(500))
    after = files(stored)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("shard=")[1][0] for f in same} == set("013467") and {f.split("shard=")[1][0] for f in set(after) - same} == set("25")


def test_the_wide_side_is_not_exchanged(spark, stored):
    new = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(500)], "id long, e array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = buckets.merged_shards(spark, stored, new, "e")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange, of the new vectors; the stored side is read by buckets.
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    wide = plan[:plan.index("Bucketed: true")]
    assert "SortMergeJoin" in plan and not re.search(r"Exchange(?!.*SortMergeJoin)", wide.split("SortMergeJoin")[1], re.S)


def test_reset(spark, stored):
    buckets.reset_stored(spark, stored, "e")
    rows = buckets.bucketed(spark, stored)
    assert rows.count() == 501 and rows.where("e IS NOT NULL").count() == 0
    before = files(stored)
    buckets.reset_stored(spark, stored, "e")
    buckets.merge_stored(spark, stored, spark.createDataFrame([], "id long, e array<double>"), "e")
    assert files(stored) == before


def test_buckets_grow_with_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKET_BYTES", 2_000)
    rows = [(i, f"name {i}", None) for i in range(2_000)] + [(7, "again", None), (None, "no id", None)]
    spark.createDataFrame(rows, "id long, product_name string, e array<double>").write.parquet(str(tmp_path / "given"))
    given = spark.read.parquet(str(tmp_path / "given"))
    path = buckets.write_bucketed(given, str(tmp_path / "products"), shards=2, buckets=4)
    # What a task holds follows from its bucket, so more input means more buckets.
    assert buckets._layout(spark, path).buckets > 4
    per_bucket = spark.read.parquet(path).groupBy("shard", F.element_at(F.split(F.input_file_name(), "_"), -1)).count()
    assert per_bucket.agg(F.max("count")).first()[0] < 2_000 // 8
    buckets.merge_stored(spark, path, spark.createDataFrame([(7, [1.0]), (9, [2.0])], "id long, e array<double>"), "e")
    found = sorted((r.id, r.product_name, tuple(r.e)) for r in buckets.bucketed(spark, path).where("e IS NOT NULL").collect())
    assert found == [(7, "again", (1.0,)), (7, "name 7", (1.0,)), (9, "name 9", (2.0,))]
    assert buckets.bucketed(spark, path).count() == len(rows)
