"""The catalogue view over the test tables, in the shape of the products table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.functions.vectors import l2_normalize

# Values of the binding: stand-in markets, automatic-store prefix and bucket.
MARKETS = ["es", "fr"]
AUTO_STORE_PREFIX = "src1"
BUCKET = "catalog-images"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def second_vector(v: Column) -> Column:
    """A second modality derived from a vector: a blend of it, its reverse and a rotation."""
    rotated = F.concat(F.slice(v, -1, 1), F.slice(v, F.lit(1), F.size(v) - 1))
    mixed = F.zip_with(
        F.zip_with(v, F.reverse(v), lambda a, b: 0.25 * a.cast("double") + 0.5 * b.cast("double")),
        rotated, lambda a, b: a + 0.9 * b.cast("double"),
    )
    return l2_normalize(mixed)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as products, with a text vector where the embeddings table has one."""
    documents = table(spark, sf_dir, "documents")
    embeddings = table(spark, sf_dir, "embeddings")
    joined = documents.join(embeddings, documents.doc_id == embeddings.vec_id, "left")
    path = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 11 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("dataset/"), F.col("doc_id").cast("string"), F.lit(".png"))
    )
    return joined.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("country_code"),
        F.col("source").alias("city_code"),
        F.col("source").alias("store_name"),
        F.substring_index("text", "\n", 1).alias("product_name"),
        F.col("label").cast("string").alias("collection_section"),
        F.col("text").alias("product_description"),
        path.alias("s3_path"),
        F.lit(None).cast("string").alias("s3_url"),
        F.col("embedding").alias("text_vector"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v, label, country, city): rows with a vector, and with their document if any."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    embeddings = table(spark, sf_dir, "embeddings")
    return embeddings.join(documents, documents.doc_id == embeddings.vec_id, "left").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("label"),
        F.col("lang").alias("country"), F.col("source").alias("city"),
    )


# Short requests in the invented words of the documents, asked besides the benchmark items.
SHORT_QUERIES = ["ción mente", "ciónado ciónos", "tion thon", "that with from"]


def query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): the benchmark items as search requests, and the short ones."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    short = spark.createDataFrame(
        [(1_000_000 + i, text) for i, text in enumerate(SHORT_QUERIES)], "query_id long, text string"
    )
    return items.unionByName(short)
