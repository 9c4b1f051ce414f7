"""Fusion of ranked lists, the answer line and the trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the search surface.
RRF_CONSTANT = 60.0
TOP_K = 20
TRACE_ROWS = 5
ANSWER_PREFIX = "Resultados top: "
NO_RESULTS = "sin resultados"
BLANK_QUERY = "Debe proporcionar texto de consulta."


def fuse_join(lexical: DataFrame, vector: DataFrame, shared: list[str] = ()) -> DataFrame:
    """One row per query and item of either list; shared fields come from the vector side first."""
    lex = lexical.select(
        "query_id", "id", F.col("rank").alias("lex_rank"), "lex_score", *[F.col(c).alias(f"__l_{c}") for c in shared]
    )
    vec = vector.select(
        "query_id", "id", F.col("rank").alias("vec_rank"), "score", *[F.col(c).alias(f"__v_{c}") for c in shared]
    )
    return lex.join(vec, ["query_id", "id"], "full_outer").select(
        "query_id", "id", "lex_rank", "vec_rank", "lex_score", "score",
        *[F.coalesce(f"__v_{c}", f"__l_{c}").alias(c) for c in shared],
    )


def _cut(scored: DataFrame, k: int | None) -> DataFrame:
    # Equal scores keep lexical order, then vector order.
    order = [
        F.desc(F.round("hybrid_score", 12)), F.asc_nulls_last("lex_rank"), F.asc_nulls_last("vec_rank"), F.asc("id"),
    ]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def rrf_fusion(
    lexical: DataFrame, vector: DataFrame, k: int | None = TOP_K, constant: float = RRF_CONSTANT,
    shared: list[str] = (),
) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (60 + rank) over the two lists."""
    joined = fuse_join(lexical, vector, shared)

    def part(rank: str):
        return F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(rank)), F.lit(0.0))

    return _cut(joined.withColumn("hybrid_score", part("lex_rank") + part("vec_rank")), k)


def blend_fusion(
    lexical: DataFrame, vector: DataFrame, k: int | None = TOP_K, lexical_weight: float = 0.5,
    shared: list[str] = (),
) -> DataFrame:
    """Weighted sum of the two scores, each scaled to 0..1 within its query."""
    w = Window.partitionBy("query_id")

    def scaled(df: DataFrame, column: str) -> DataFrame:
        low, high = F.min(column).over(w), F.max(column).over(w)
        value = F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(F.lit(1.0))
        return df.withColumn(column, value)

    joined = fuse_join(scaled(lexical, "lex_score"), scaled(vector, "score"), shared)
    blended = (
        F.lit(lexical_weight) * F.coalesce("lex_score", F.lit(0.0))
        + F.lit(1 - lexical_weight) * F.coalesce("score", F.lit(0.0))
    )
    return _cut(joined.withColumn("hybrid_score", blended), k)


def answer_summary(queries: DataFrame, fused: DataFrame, name: str = "product_name", top: int = 5) -> DataFrame:
    """One line per query naming its first items; a fixed reply for a blank query."""
    from vitrina.functions.text import has_content

    names = fused.where(F.col("rank") <= top).groupBy("query_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", F.col(name).alias("name")))), lambda x: x["name"]
    ), ", ").alias("__names"))
    line = F.concat(F.lit(ANSWER_PREFIX), F.coalesce("__names", F.lit(NO_RESULTS)))
    return queries.join(names, "query_id", "left").select(
        "query_id", F.when(has_content("text"), line).otherwise(F.lit(BLANK_QUERY)).alias("answer")
    )


def trace(
    queries: DataFrame, lexical: DataFrame, vector: DataFrame, fused: DataFrame,
    params: dict[str, int], rows: int = TRACE_ROWS,
) -> DataFrame:
    """Per query: parameters, the first rows of both lists and the whole fused list."""
    from vitrina.functions.text import has_content

    def packed(df: DataFrame, fields: list[str], name: str, limit: int | None) -> DataFrame:
        df = df if limit is None else df.where(F.col("rank") <= limit)
        return df.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias(name))

    extra = [c for c in ("name", "text", "image_url") if c in fused.columns]
    out = queries.select(
        "query_id", "text", F.lit("hybrid_text").alias("intent"),
        F.when(~has_content("text"), F.lit("empty_text")).alias("error"),
        F.struct(*[F.lit(v).alias(n) for n, v in params.items()]).alias("params"),
    )
    lists = [
        packed(vector, ["id", "score"], "vector_top", rows),
        packed(lexical, ["id", "lex_score"], "lexical_top", rows),
        packed(fused, ["id", "lex_rank", "vec_rank", "hybrid_score", *extra], "final", None),
    ]
    for part in lists:
        out = out.join(part, "query_id", "left")
    return out
