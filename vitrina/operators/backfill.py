"""Filling vector columns: which rows are pending, and how new vectors are merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.encoders import Encoder, encode, encode_text
from vitrina.functions.text import compose_text, object_location
from vitrina.functions.vectors import round_vector
from vitrina.session import spread


def pending_rows(df: DataFrame, column: str, need_image: bool = False) -> DataFrame:
    """Rows without the vector; for image vectors also with a path."""
    rows = df.where(F.col(column).isNull())
    if need_image:
        rows = rows.where(F.col("s3_path").isNotNull() & (F.col("s3_path") != ""))
    return rows


def pending_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows lack each vector, all columns in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"pending_{c}") for c in columns])


def reset_column(df: DataFrame, column: str) -> DataFrame:
    """Drop all vectors of a column; touched rows get a new ``updated_at``."""
    if "updated_at" in df.columns:
        touched = F.when(F.col(column).isNotNull(), F.current_timestamp()).otherwise(F.col("updated_at"))
        df = df.withColumn("updated_at", touched)
    return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


def encode_pending(df: DataFrame, column: str, encoder: Encoder, text: Column | None = None) -> DataFrame:
    """(id, column): vectors for the rows that lack one. Only their text is read."""
    composed = compose_text() if text is None else text
    rows = spread(pending_rows(df, column).select("id", composed.alias("__text")))
    return rows.select("id", encode_text("__text", encoder).alias("v")).select(
        "id", round_vector("v").alias(column)
    )


def encode_images(df: DataFrame, column: str, encoder: Encoder, objects: DataFrame, bucket: str) -> DataFrame:
    """(id, column): vectors for rows that lack an image vector.

    ``objects`` is (path, pixels) of ``decoded_images`` for an image encoder, or (path,
    content), whose encoder gets the bytes as base64. An object is encoded once, however
    many rows point to it; content never meets the catalogue rows. Rows whose object is
    absent or has null pixels get no vector and stay pending.
    """
    given = "pixels" if "pixels" in objects.columns else "content"
    where = object_location(bucket)
    rows = pending_rows(df, column, need_image=True).select(
        "id", F.concat_ws("/", where["bucket"], where["key"]).alias("path")
    )
    used = objects.where(F.col(given).isNotNull()).join(rows.select("path").distinct(), "path", "left_semi")
    source = F.col("pixels") if given == "pixels" else F.base64("content")
    encoded = used.select("path", encode(source, encoder).alias("v"))
    return rows.join(encoded, "path").select("id", round_vector("v").alias(column))


def merge_embeddings(products: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Products with the vectors of ``new`` (id, column) put in, ``updated_at`` touched.

    Rows that got a vector are marked by the join; ids must be unique in ``new``.
    """
    fresh = new.select("id", F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    joined = products.join(fresh, "id", "left")
    changes = {column: F.coalesce("__new", column)}
    if "updated_at" in products.columns:
        changes["updated_at"] = F.when(F.col("__hit"), F.current_timestamp()).otherwise(F.col("updated_at"))
    return joined.withColumns(changes).select(*products.columns)


def embed_backfill(
    products: DataFrame, column: str, encoder: Encoder, reset: bool = False, text: Column | None = None
) -> DataFrame:
    """Fill the missing vectors of a text column; ``reset`` encodes every row again.

    Without a join: a row that has its vector passes through, the others are
    encoded where they are. Write the result as the new table, or use
    ``encode_pending`` and append (id, vector) to a table of its own.
    """
    if reset:
        products = reset_column(products, column)
    composed = compose_text() if text is None else text
    missing = F.col(column).isNull()
    source = F.when(missing, composed)
    filled = products.withColumn("__fresh", round_vector(encode_text(source, encoder)))
    changes = {column: F.when(missing, F.col("__fresh")).otherwise(F.col(column))}
    if "updated_at" in products.columns:
        changes["updated_at"] = F.when(missing, F.current_timestamp()).otherwise(F.col("updated_at"))
    return filled.withColumns(changes).select(*products.columns)
