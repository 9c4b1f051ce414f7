"""Products stored so that changed rows are updated in place.

The table is partitioned into shards by a hash of the id and bucketed by id inside. A merge
reads only the shards that changed ids fall in, joins them bucket by bucket without moving
the wide rows, and overwrites these shards; the files of all others stay as they are.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrina.operators.backfill import merge_embeddings, reset_column
from vitrina.session import SPLIT_BYTES, input_bytes, materialize

SHARDS = 64
BUCKETS = 16
# Input of one bucket, over all shards: a task sorts as much, however large the table.
BUCKET_BYTES = SPLIT_BYTES
# Sizes from here on are Spark's mark of an unknown size.
UNKNOWN_BYTES = 1 << 62
# Spark's bound of a table's buckets at its defaults.
MOST_BUCKETS = 100_000
_MODE = "spark.sql.sources.partitionOverwriteMode"


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")


def _name(path: str) -> str:
    return f"vitrina_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def write_bucketed(products: DataFrame, path: str, shards: int = SHARDS, buckets: int = BUCKETS) -> str:
    """Store products (id, ...) by shards and buckets; the folder must be new.

    A bucket is what one task writes, joins and rewrites, so large products get more than
    ``buckets``, one for each ``BUCKET_BYTES`` of the files they are read from. Rows without
    an id lie in one shard of their own kind and are never merged into.
    """
    spark = products.sparkSession
    if input_bytes(products) >= UNKNOWN_BYTES:
        products = materialize(products, "products-sized")
    buckets = max(buckets, min(-(-input_bytes(products) // BUCKET_BYTES), MOST_BUCKETS))
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    # A task per bucket, so that a shard has one file for each bucket and no more.
    rows = products.withColumn("shard", F.coalesce(_shard(shards), F.lit(0))).repartition(buckets, "id")
    rows.write.partitionBy("shard").bucketBy(buckets, "id").sortBy("id").option("path", path).format("parquet").saveAsTable(_name(path))
    spark.createDataFrame([(shards, buckets, products.schema.json())], "shards int, buckets int, columns string").coalesce(1).write.parquet(f"{path}/_layout")
    return path


def _layout(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/_layout").first()


def bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The stored products, with their shard; known to the session's catalogue as a bucketed table."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        layout = _layout(spark, path)
        fields = StructType.fromJson(json.loads(layout.columns)).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        location = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}, shard int) USING parquet PARTITIONED BY (shard) "
            f"CLUSTERED BY (id) SORTED BY (id) INTO {layout.buckets} BUCKETS LOCATION '{location}'"
        )
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def _overwritten(rows: DataFrame, path: str) -> None:
    """Replace the shards that the rows have."""
    spark = rows.sparkSession
    before = spark.conf.get(_MODE)
    spark.conf.set(_MODE, "dynamic")
    try:
        rows.write.insertInto(_name(path), overwrite=True)
    finally:
        spark.conf.set(_MODE, before)
    spark.catalog.refreshTable(_name(path))


def merged_shards(spark: SparkSession, path: str, new: DataFrame, column: str) -> DataFrame:
    """The shards of the stored products that ``new`` (id, column) touches, with its vectors put in."""
    shards = _layout(spark, path).shards
    # At most as many numbers as there are shards.
    touched = [r.shard for r in new.where(F.col("id").isNotNull()).select(_shard(shards).alias("shard")).distinct().collect()]
    return merge_embeddings(bucketed(spark, path).where(F.col("shard").isin(touched)), new, column)


def merge_stored(spark: SparkSession, path: str, new: DataFrame, column: str) -> str:
    """Put the vectors of ``new`` into the stored products; ids must be unique in ``new``, unknown ids are ignored."""
    _overwritten(merged_shards(spark, path, new, column), path)
    return path


def reset_stored(spark: SparkSession, path: str, column: str) -> str:
    """Drop all vectors of a column; shards that have none are not rewritten."""
    rows = bucketed(spark, path)
    touched = [r.shard for r in rows.where(F.col(column).isNotNull()).select("shard").distinct().collect()]
    _overwritten(reset_column(rows.where(F.col("shard").isin(touched)), column), path)
    return path
