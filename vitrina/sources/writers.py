"""Catalogue, report and trace writers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.session import parallelism


def parquet_sink(df: DataFrame, path: str) -> str:
    """Replace a Parquet folder; an empty frame still leaves its columns behind."""
    df.write.mode("overwrite").parquet(path)
    return path


def append_products(df: DataFrame, path: str, batch_id: str) -> str:
    """Add one load to the products folder.

    Every load is its own partition and replaces only itself, so a load that is
    run again leaves no row twice.
    """
    (
        df.withColumn("load_batch", F.lit(batch_id)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("load_batch").parquet(path)
    )
    return path


def report_path(folder: str, name: str, limit: int | None = None, proxy: str | None = None) -> str:
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S")
    parts = [name, proxy, stamp, None if limit is None else str(limit)]
    return f"{folder}/{'_'.join(p for p in parts if p)}"


def metrics_sink(report: DataFrame, folder: str, name: str, limit: int | None = None, proxy: str | None = None) -> str:
    """Write a metric report as JSON under a time-stamped name; returns the path."""
    path = report_path(folder, name, limit, proxy)
    report.write.mode("errorifexists").json(path)
    return path


def trace_sink(traces: DataFrame, path: str) -> str:
    """Write search traces as JSON, spread over the partitions they already have."""
    traces.write.mode("overwrite").json(path)
    return path


def object_sink(objects: DataFrame, folder: str) -> str:
    """Write each (path, content) as a file below a folder that all machines share; returns the folder.

    Spark's writers name files themselves, so tasks write these through Arrow's file systems,
    one row at a time. A file is one path's: of several contents the least one counts, and a
    task that is run again writes the same. Rows without a path are left out, null content
    is an empty file.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(folder)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                target = f"{root}/{path}"
                parent = target.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(target) as file:
                    file.write(content.as_py() or b"")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    # A number of tasks is named, as small rows would otherwise end up in one.
    rows = objects.where(F.col("path").isNotNull()).repartition(4 * parallelism(objects.sparkSession), "path")
    rows.groupBy("path").agg(F.min("content").alias("content")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder
