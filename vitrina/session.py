"""Session construction and the few helpers that depend on cluster size."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings a job of this package wants; anything the caller passes wins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}

# Input per core above which a scan is taken to have enough splits.
SPLIT_BYTES = 32 << 20


def build_session(app: str = "vitrina", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Does nothing where the package came with the application (``--py-files``)
    already: Spark keeps one copy per file name.
    """
    sc = spark.sparkContext
    if getattr(sc, "_vitrina_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="vitrina-")) / "vitrina_pkg.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, Path("vitrina") / source.relative_to(root))
    sc.addPyFile(str(target))
    sc._vitrina_shipped = True


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the shared folder that the cluster names.

    Only a session on one machine may leave ``spark.checkpoint.dir`` unset, and gets
    a temporary folder; on several machines that would lose rows, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(context, "_vitrina_scratch", None) or tempfile.mkdtemp(prefix="vitrina-scratch-")
        context._vitrina_scratch = base
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a Parquet copy in the shared folder.

    Used where one intermediate result feeds several jobs: unlike a cache it
    survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), parallelism(spark))


def input_bytes(df: DataFrame) -> int:
    """Size of everything a frame reads, from file statistics; runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """Spread small inputs over the cluster before work that is heavy per row.

    A table of one small file would otherwise be one task. Inputs that give every
    core some tens of megabytes have enough splits and pass through unchanged.
    """
    cores = parallelism(df.sparkSession)
    if input_bytes(df) >= cores * SPLIT_BYTES:
        return df
    return df.repartition(cores)
