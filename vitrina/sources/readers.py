"""Catalogue readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.functions.images import shrunk
from vitrina.operators.ordering import number_in_file_order
from vitrina.schema import LOAD_SCHEMA
from vitrina.session import parallelism

# Texts that mean a missing value in a catalogue file.
NULL_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Tasks that share the images of a folder; they stream, so more images are no more memory.
TASKS_PER_CORE = 16


def csv_source(
    spark: SparkSession, path: str | list[str], schema: T.StructType = LOAD_SCHEMA, line_order: str | None = None
) -> DataFrame:
    """Catalogue CSV with a header, quoted line breaks and the usual null markers.

    A file with quoted line breaks cannot be split, so each file is one task; the
    rows are spread right after the scan when there are fewer files than cores.
    ``line_order`` adds a number that increases by file name and line, for ``first_n``.
    """
    rows = (
        spark.read.schema(schema)
        .option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(path)
    )
    if line_order:
        # Files are packed into tasks by size; their names decide the order.
        placed = rows.withColumns({"__file": F.col("_metadata.file_path"), "__at": F.monotonically_increasing_id()})
        rows = number_in_file_order(placed, "__file", "__at", line_order).drop("__file", "__at")
    if rows.rdd.getNumPartitions() < parallelism(spark):
        rows = rows.repartition(parallelism(spark))
    text = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return rows.withColumns({c: F.when(~F.col(c).isin(NULL_MARKERS), F.col(c)) for c in text})


def parquet_source(spark: SparkSession, path: str) -> DataFrame:
    """One Parquet file or a folder of them; an absent path is an error.

    Files may lack columns that others have; those become null.
    """
    return spark.read.option("mergeSchema", True).parquet(path)


def image_source(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, content) of objects; content is read only when selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    objects = reader.load(path)
    return objects.withColumn("path", F.regexp_replace("path", r"^[A-Za-z0-9]+:/*", ""))


def decoded_images(
    spark: SparkSession, path: str, side: int, pattern: str | None = None, undecoded: bool = True
) -> DataFrame:
    """(path, length, pixels) of the images of a folder, each shrunk to ``side`` by ``side`` pixels.

    Spark's image source decodes (PNG, JPEG, GIF, BMP) and shrinks an image in the task that reads
    it, so that full pictures are never shuffled. An object that is no image or is cut short has
    null ``pixels``; Spark reads no empty file, so an empty object has no row. All objects of the folder that match ``pattern`` are decoded.
    Without ``undecoded`` objects, those with pixels come from the one listing that decoding needs.
    """
    reader = (
        spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True)
        # Spark takes a picture that breaks off for a read error.
        .option("ignoreCorruptFiles", True)
    )
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # Spark reckons 4 MB for opening a file, which makes a task of a few small ones.
    loaded = reader.load(path).select("image", F.col("_metadata.file_size").alias("length")).coalesce(TASKS_PER_CORE * parallelism(spark))
    images = loaded.select(
        F.regexp_replace("image.origin", r"^[A-Za-z0-9]+:/*", "").alias("path"), "length", shrunk("image", side).alias("pixels")
    )
    if not undecoded:
        return images
    # A listing: content is not selected.
    return image_source(spark, path, pattern).select("path", "length").join(images.drop("length"), "path", "left")


def resolve_images(rows: DataFrame, objects: DataFrame, bucket: str) -> DataFrame:
    """Objects that pending rows point to, once each: (path, length, content, n_rows).

    Rows are counted per object before the join, so an object that a third of the
    catalogue shares is still read once.
    """
    from vitrina.functions.text import object_location

    where = object_location(bucket)
    wanted = rows.groupBy(F.concat_ws("/", where["bucket"], where["key"]).alias("path")).agg(
        F.count("*").alias("n_rows")
    )
    return objects.join(wanted, "path")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads it from."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
