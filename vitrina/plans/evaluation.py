"""Metric reports: a sample by id, the metrics of one family, one long table.

A report row is (embedding, scope, metric, value); ``metrics_sink`` writes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.text import normalize_label
from vitrina.operators.labels import (
    by_group, cluster_agreement, filter_separation, hybrid_recall, kmeans_clusters, label_cardinality,
    nearest_metrics, silhouette,
)
from vitrina.operators.ordering import sample_by_id
from vitrina.operators.pairs import align_pairs, pair_separation, pair_stats, retrieval_metrics, text_pair_retrieval
from vitrina.schema import pick_column, vector_checks

# The vector columns that each report tries, in order.
TEXT_COLUMNS = ["text_emb_e5", "text_emb_gte", "text_emb_je3"]
PAIRED_TEXT = ["text_emb_clip_multi", "clip_text_emb"]
PAIRED_IMAGE = ["image_emb_clip", "clip_image_emb"]
COMBINED_TEXT = ["clip_text_emb", "text_emb_clip_multi", "text_emb_gte", "text_emb_e5", "text_emb_je3"]
COMBINED_IMAGE = ["image_emb_clip", "clip_image_emb"]
METRIC_FAMILIES = ("pairs", "retrieval", "labels", "clusters")


def long_form(df: DataFrame, embedding: str, scope: str, scope_column: str | None = None) -> DataFrame:
    """Wide metric rows as (embedding, scope, metric, value)."""
    metrics = [c for c in df.columns if c != scope_column]
    where = F.lit(scope) if scope_column is None else F.concat(F.lit(f"{scope}:"), F.col(scope_column))
    return df.select(
        F.lit(embedding).alias("embedding"), where.alias("scope"),
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
        ])).alias("x"),
    ).select("embedding", "scope", "x.*")


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def search_quality_report(df: DataFrame, columns: list[str] = TEXT_COLUMNS, limit: int | None = None) -> DataFrame:
    """Pooled hybrid recall, and separation by section and by store."""
    sample = sample_by_id(df, limit)
    parts = []
    for c in [c for c in columns if c in df.columns]:
        rows = sample.withColumn("v", F.col(c))
        recall = hybrid_recall(rows, "country_code", "city_code", "collection_section")
        parts.append(long_form(recall, c, "hybrid_recall"))
        for label in ("collection_section", "store_name"):
            parts.append(long_form(filter_separation(rows, label), c, f"filter_separation:{label}"))
    return _together(parts)


def relevance_report(
    df: DataFrame, columns: list[str] = TEXT_COLUMNS, proxy: str = "collection_section",
    limit: int | None = None, seed: int = 42,
) -> DataFrame:
    """Neighbour, silhouette and cluster agreement metrics with a column as label.

    With ``store_name`` as label the same inside every country.
    """
    sample = sample_by_id(df, limit)
    label = normalize_label(proxy, product_name=proxy == "product_name")
    parts = []
    for c in [c for c in columns if c in df.columns]:
        rows = sample.select("id", F.col(c).alias("v"), label.alias("label"), "country_code")
        clusters = kmeans_clusters(rows, "label", seed=seed)
        for metrics in (
            nearest_metrics(rows, "label"), silhouette(rows, "label").select("silhouette"),
            cluster_agreement(clusters, "label", "cluster"), label_cardinality(rows, "label"),
        ):
            parts.append(long_form(metrics, c, "overall"))
        if proxy == "store_name":
            parts.append(long_form(by_group(rows, "label", "country_code"), c, "country", "group"))
    return _together(parts)


def alignment_report(df: DataFrame, limit: int | None = None, text: str | None = None, image: str | None = None) -> DataFrame:
    """Pair separation and retrieval between a text and an image vector column.

    Columns of different dimensions give a single ``pairs`` row with value 0.
    """
    sample = sample_by_id(df, limit)
    text, image = text or pick_column(sample, PAIRED_TEXT), image or pick_column(sample, PAIRED_IMAGE)
    if text is None or image is None:
        raise ValueError("no text or no image vector column with values")
    checked = vector_checks(sample, text, image)
    head = long_form(checked.select("pairs"), text, "checks")
    if not checked.first()["pairs"]:
        return head
    pairs = align_pairs(sample, text, image)
    return _together([
        head,
        long_form(pair_separation(pairs), text, "pair_separation"),
        long_form(retrieval_metrics(pairs), text, "retrieval", "direction"),
    ])


def combined_report(
    df: DataFrame, text: str, image: str | None = None, query_text: str | None = None,
    target_text: str | None = None, label: str = "collection_section", limit: int | None = None,
    metrics: tuple[str, ...] = METRIC_FAMILIES,
) -> DataFrame:
    """The older combined report: choose metric families and columns.

    Without an image column it is the text-only form, with an optional pair of
    text columns for text-to-text retrieval.
    """
    require = [text] + ([image] if image else [])
    sample = sample_by_id(df, limit, require=require)
    parts = []
    if image and {"pairs", "retrieval"} & set(metrics):
        checked = vector_checks(sample, text, image)
        parts.append(long_form(checked.select("pairs"), text, "checks"))
        # Columns of different dimensions cannot be compared.
        comparable = bool(checked.first()["pairs"])
        metrics = metrics if comparable else tuple(m for m in metrics if m not in ("pairs", "retrieval"))
        pairs = align_pairs(sample, text, image)
        if "pairs" in metrics:
            parts.append(long_form(pair_stats(pairs), text, "pair_stats"))
        if "retrieval" in metrics:
            parts.append(long_form(retrieval_metrics(pairs, ndcg=True), text, "retrieval", "direction"))
    if query_text and target_text:
        parts.append(long_form(text_pair_retrieval(sample, query_text, target_text), query_text, "text_to_text"))
    rows = sample.select("id", F.col(text).alias("v"), F.col(label).alias("label"))
    if "labels" in metrics:
        parts += [
            long_form(nearest_metrics(rows, "label", ()), text, "labels"), long_form(silhouette(rows, "label").select("silhouette"), text, "labels"),
        ]
    if "clusters" in metrics:
        clusters = kmeans_clusters(rows, "label")
        parts.append(long_form(cluster_agreement(clusters, "label", "cluster"), text, "clusters"))
    return _together(parts)
