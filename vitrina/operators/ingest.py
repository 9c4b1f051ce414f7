"""Catalogue rules applied between the raw file and the products table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.text import clean_string, has_content, object_url
from vitrina.schema import LOAD_COLUMNS, conform_schema

# Markets kept by every ingest.
SPANISH_SPEAKING = [
    "MX", "CO", "ES", "AR", "PE", "VE", "CL", "GT", "EC", "BO", "CU", "DO", "HN", "PY", "SV", "NI", "CR", "PA",
    "UY", "GQ", "PR",
]
AUTO_STORE_PREFIX = "AS_"


def catalog_filter(
    df: DataFrame, country_codes: str | list[str] | None = None, whitelist: list[str] = SPANISH_SPEAKING,
    auto_store_prefix: str = AUTO_STORE_PREFIX,
) -> DataFrame:
    """Rows with image path and description, in a wanted market, of no automatic store.

    A row without a store name stays.
    """
    keep = (
        has_content("s3_path")
        & has_content("product_description")
        & ~F.coalesce(F.col("store_name"), F.lit("")).startswith(auto_store_prefix)
        & F.col("country_code").isin(whitelist)
    )
    if country_codes:
        wanted = [country_codes] if isinstance(country_codes, str) else list(country_codes)
        keep = keep & F.col("country_code").isin(wanted)
    return df.where(keep)


def derive_url(df: DataFrame, bucket: str) -> DataFrame:
    """Recompute ``s3_url`` from ``s3_path``, whatever the file held."""
    return df.withColumn("s3_url", object_url(bucket, "s3_path"))


def clean_strings(df: DataFrame, columns: list[str] = LOAD_COLUMNS) -> DataFrame:
    """Strip every listed column; an empty string becomes null."""
    return df.withColumns({c: clean_string(c) for c in columns})


def prepare_load(df: DataFrame, bucket: str, keep: list[str] = ()) -> DataFrame:
    """What a file goes through before it is appended: conform, URL, clean.

    The URL is built before stripping, so blanks at the front of a path stay in it.
    Columns to ``keep`` pass through unchanged.
    """
    own = conform_schema(df).columns
    marks = {c: df.schema[c].dataType for c in keep}
    kept = conform_schema(df, [*own, *keep]).withColumns({c: F.col(c).cast(kind) for c, kind in marks.items()})
    return clean_strings(derive_url(kept, bucket))


def count_by_section_in_city(df: DataFrame, city: str) -> DataFrame:
    """Number of products per section in one city."""
    return df.where(F.col("city_code") == city).groupBy(
        F.coalesce("collection_section", F.lit("None")).alias("collection_section")
    ).agg(F.count("*").alias("n_products"))


def near_duplicates(df: DataFrame, text: str, key: str = "id") -> DataFrame:
    """Groups of rows whose normalised text is equal: (text_key, copies, kept_id).

    Case, digits, punctuation, separators and URLs do not count. A group is one
    row of counts, however many copies it has.
    """
    from vitrina.functions.text import normalize_text

    return df.select(key, F.md5(normalize_text(text)).alias("text_key")).groupBy("text_key").agg(
        F.count("*").alias("copies"), F.min(key).alias("kept_id")
    ).where(F.col("copies") > 1)
