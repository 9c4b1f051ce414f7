"""Ingest of catalogue files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vitrina.functions.encoders import Encoder
from vitrina.operators.backfill import embed_backfill
from vitrina.operators.ingest import catalog_filter, prepare_load
from vitrina.plans.ingest import load_rows


def arriving_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the path may be a pattern of folders and files, ``pattern`` is one of file names."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def ingest_available(rows: DataFrame, target: str, checkpoint: str, bucket: str, **filters) -> StreamingQuery:
    """Filter and clean everything that has arrived, then stop.

    The rules look at one row at a time, so the stream keeps no state; files seen
    before are skipped by the checkpoint.
    """
    cleaned = prepare_load(catalog_filter(rows, **filters), bucket)
    return (
        cleaned.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def load_available(
    rows: DataFrame, target: str, checkpoint: str, bucket: str, column: str | None = None, encoder: Encoder | None = None,
    name: str = "stream", **filters,
) -> StreamingQuery:
    """Append everything that has arrived to the products table, then stop.

    A micro-batch is a load of its own, called after the stream and the number of the
    batch. Spark runs a batch again with the same files after a failure; it then replaces
    what it wrote before and its rows keep their ids, so no row is lost, doubled or
    renumbered. With an ``encoder`` the text vector ``column`` is filled in the same batch.
    ``rows`` come from ``arriving_files``; select ``_metadata`` with the columns if you select.
    Several streams may feed one table one after another under different names.
    """
    if "_metadata" not in rows.columns:
        rows = rows.select("*", "_metadata")

    def fill(loaded: DataFrame) -> DataFrame:
        return embed_backfill(loaded.withColumn(column, F.lit(None).cast("array<float>")), column, encoder)

    def load(batch: DataFrame, number: int) -> None:
        load_rows(
            catalog_filter(batch, **filters), target, f"{name}-{number:010d}", bucket, fill=fill if encoder else None
        )

    return (
        rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
