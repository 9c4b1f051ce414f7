"""The products model: columns, vector dimensions and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns every catalogue load keeps, in order.
LOAD_COLUMNS = [
    "country_code",
    "city_code",
    "store_name",
    "product_name",
    "collection_section",
    "product_description",
    "s3_path",
    "s3_url",
]

# Vector columns and their dimensions.
VECTOR_DIMENSIONS = {
    "text_emb_je3": 1024,
    "clip_text_emb": 1024,
    "clip_image_emb": 1024,
    "text_emb_e5": 384,
    "text_emb_gte": 768,
    "image_emb_clip": 512,
    "text_emb_clip_multi": 512,
}

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

LOAD_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in LOAD_COLUMNS])


def products_schema() -> T.StructType:
    """Schema of the products table, each vector field carrying its dimension."""
    fields = [T.StructField("id", T.LongType(), False)]
    fields += [T.StructField(name, T.StringType()) for name in LOAD_COLUMNS]
    fields.append(T.StructField("meta", T.StringType()))
    fields += [T.StructField(n, VECTOR, True, {"dimension": d}) for n, d in VECTOR_DIMENSIONS.items()]
    fields += [T.StructField(n, T.TimestampType()) for n in ("created_at", "updated_at")]
    return T.StructType(fields)


def conform_schema(df: DataFrame, columns: list[str] = LOAD_COLUMNS) -> DataFrame:
    """Exactly ``columns``, in order; missing ones become null strings."""
    present = set(df.columns)
    return df.select(*[
        F.col(c).cast("string").alias(c) if c in present else F.lit(None).cast("string").alias(c)
        for c in columns
    ])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail before any job starts when a needed column is absent."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def vector_checks(df: DataFrame, text_col: str, image_col: str) -> DataFrame:
    """One row: aligned pairs, the dimensions seen, and a warning if they differ.

    ``pairs`` is 0 whenever the two sides cannot be compared.
    """
    require_columns(df, [text_col, image_col])
    stats = df.where(F.col(text_col).isNotNull() & F.col(image_col).isNotNull()).agg(
        F.count("*").alias("aligned"),
        F.min(F.size(text_col)).alias("text_dim"),
        F.max(F.size(text_col)).alias("text_dim_max"),
        F.min(F.size(image_col)).alias("image_dim"),
        F.max(F.size(image_col)).alias("image_dim_max"),
    )
    same = (
        (F.col("text_dim") == F.col("image_dim"))
        & (F.col("text_dim") == F.col("text_dim_max"))
        & (F.col("image_dim") == F.col("image_dim_max"))
    )
    return stats.select(
        F.when(same, F.col("aligned")).otherwise(F.lit(0)).cast("long").alias("pairs"),
        "text_dim",
        "image_dim",
        F.when(
            ~same,
            F.concat(
                F.lit("dimension_mismatch: text_dim="), F.col("text_dim").cast("string"),
                F.lit(" image_dim="), F.col("image_dim").cast("string"),
            ),
        ).alias("warning"),
    )


def pick_column(df: DataFrame, preferred: list[str]) -> str | None:
    """First column of ``preferred`` that exists and holds at least one value.

    All candidates are counted in one pass over the data.
    """
    candidates = [c for c in preferred if c in df.columns]
    if not candidates:
        return None
    seen = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in candidates]).first()
    return next((c for c in candidates if seen[c]), None)
