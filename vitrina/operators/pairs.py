"""Metrics over aligned pairs of vectors: separation, statistics, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.text import label_or_none
from vitrina.functions.vectors import cosine, euclidean
from vitrina.operators.labels import label_sums
from vitrina.operators.ordering import exact_percentiles, shift_by_one
from vitrina.operators.similarity import partner_positions
from vitrina.session import materialize, spread

KS = (1, 5, 10)


def align_pairs(df: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """(id, a, b): rows that hold both vectors."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        "id", F.col(a).alias("a"), F.col(b).alias("b"), *keep
    )


def pair_distances(pairs: DataFrame) -> DataFrame:
    """(id, cos_pos, euc_pos, cos_neg, euc_neg) for rows (id, a, b).

    The negative partner is the second vector of the row before in id order, the
    last row's for the first row; a single row has none.
    """
    shifted = shift_by_one(spread(pairs.select("id", "a", "b")), "id", "b", "n")
    return shifted.select(
        "id",
        cosine("a", "b").alias("cos_pos"), euclidean("a", "b").alias("euc_pos"),
        cosine("a", "n").alias("cos_neg"), euclidean("a", "n").alias("euc_neg"),
    )


def expected_negative_cosine(pairs: DataFrame) -> Column:
    """Mean cosine over all mismatched pairs, from two vector sums (a scalar subquery)."""
    a = label_sums(pairs.select(F.col("a").alias("v")), F.lit(""))
    b = label_sums(pairs.select(F.col("b").alias("v")), F.lit(""))
    own = pairs.agg(F.sum(cosine("a", "b")).alias("own")).scalar()
    joined = a.select("n", F.col("s").alias("sa")).withColumn("sb", b.select("s").scalar())
    product = F.aggregate(F.zip_with("sa", "sb", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return joined.select(F.try_divide(product - own, F.col("n") * (F.col("n") - 1)).alias("x")).scalar()


def pair_separation(pairs: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """Mean cosine and Euclidean of true and mismatched pairs and the gaps, one row.

    ``neg_cos_expected`` is the exact mean over all mismatched pairs.
    """
    d = pair_distances(pairs) if distances is None else distances
    means = d.agg(
        F.count("*").alias("count"),
        F.avg("cos_pos").alias("pos_cos_mean"), F.avg("cos_neg").alias("neg_cos_mean"),
        F.avg("euc_pos").alias("pos_euc_mean"), F.avg("euc_neg").alias("neg_euc_mean"),
    ).where(F.col("count") > 0)
    return means.select(
        "count", "pos_cos_mean", "neg_cos_mean",
        (F.col("pos_cos_mean") - F.col("neg_cos_mean")).alias("cos_separation"),
        "pos_euc_mean", "neg_euc_mean",
        (F.col("neg_euc_mean") - F.col("pos_euc_mean")).alias("euc_separation"),
        expected_negative_cosine(pairs).alias("neg_cos_expected"),
    )


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Means, medians and tail percentiles of the pair distances, one row."""
    d = materialize(pair_distances(pairs), "pair-distances")
    tails = exact_percentiles(d, {
        "cos_pos_median": ("cos_pos", 0.5), "cos_pos_p95": ("cos_pos", 0.95),
        "euc_pos_median": ("euc_pos", 0.5), "euc_pos_p05": ("euc_pos", 0.05),
        "cos_neg_p95": ("cos_neg", 0.95), "euc_neg_p05": ("euc_neg", 0.05),
    })
    means = d.agg(
        F.count("*").alias("count"), F.avg("cos_pos").alias("cos_pos_mean"), F.avg("euc_pos").alias("euc_pos_mean"),
        F.avg("cos_neg").alias("cos_neg_mean"), F.avg("euc_neg").alias("euc_neg_mean"),
    )
    packed = means.select(F.struct(*means.columns).alias("m")).scalar()
    return tails.withColumn("m", packed).where(F.col("m.count") > 0).select("m.*", *tails.columns)


def _position_metrics(position: Column, ks: tuple[int, ...], ndcg: bool) -> list[Column]:
    gain = F.lit(1.0) / F.log2(F.lit(1.0) + position)
    out = [F.avg((position <= k).cast("double")).alias(f"recall_{k}") for k in ks]
    if ndcg:
        out += [F.avg(F.when(position <= k, gain).otherwise(F.lit(0.0))).alias(f"ndcg_{k}") for k in ks]
    return out + [F.avg(F.lit(1.0) / position).alias("mrr")]


def _both_directions(positions: DataFrame, names: tuple[str, str], *keep: str) -> DataFrame:
    return positions.select(*keep, F.explode(F.array(
        F.struct(F.lit(names[0]).alias("direction"), F.col("a_to_b").alias("position")),
        F.struct(F.lit(names[1]).alias("direction"), F.col("b_to_a").alias("position")),
    )).alias("x")).select(*keep, "x.direction", "x.position")


def retrieval_metrics(
    pairs: DataFrame, ks: tuple[int, ...] = KS, names: tuple[str, str] = ("text_to_image", "image_to_text"),
    ndcg: bool = False,
) -> DataFrame:
    """Recall@k and MRR (and nDCG@k) of the true partner, one row per direction."""
    long = _both_directions(partner_positions(pairs), names)
    return long.groupBy("direction").agg(F.count("*").alias("pairs"), *_position_metrics(F.col("position"), ks, ndcg))


def ndcg(pairs: DataFrame, ks: tuple[int, ...] = KS, names=("text_to_image", "image_to_text")) -> DataFrame:
    """nDCG@k with one relevant item per query, one row per direction."""
    out = retrieval_metrics(pairs, ks, names, ndcg=True)
    return out.select("direction", *[f"ndcg_{k}" for k in ks])


def text_pair_retrieval(df: DataFrame, query_col: str, target_col: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """Pair statistics and retrieval of one text vector column against another, one row."""
    pairs = align_pairs(df, query_col, target_col)
    retrieval = retrieval_metrics(pairs, ks, ("text_to_text", "back"), ndcg=True).where(
        F.col("direction") == "text_to_text"
    ).drop("direction", "pairs")
    packed = retrieval.select(F.struct(*retrieval.columns).alias("r")).scalar()
    stats = pair_stats(pairs)
    return stats.withColumn("r", packed).select(*stats.columns, "r.*")


def recall_by_section(
    pairs: DataFrame, section: Column | str, ks: tuple[int, ...] = (1, 5, 10, 50),
) -> DataFrame:
    """Recall@k per section of the query row, text to image. ``pairs`` keeps the section column."""
    positions = partner_positions(pairs.select("id", "a", "b"))
    labelled = positions.join(pairs.select("id", label_or_none(section).alias("section")), "id")
    return labelled.groupBy("section").agg(
        F.count("*").alias("pairs"),
        *[F.avg((F.col("a_to_b") <= k).cast("double")).alias(f"recall_{k}") for k in ks],
    )
