"""Connected components, and look-ups by keys that many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.session import materialize

# A key is hot if it holds more than one row in so many; there are never more hot keys than this.
HOT_KEYS = 1 << 12


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Rows joined with a table of (key, n, ...), where n of the ``total`` rows have the key.

    Rows of hot keys stay where they are: at most ``HOT_KEYS`` rows of the table can be hot,
    and these are broadcast. The others meet the rest of the table in a shuffle.
    """
    is_hot = F.col("n") * HOT_KEYS >= F.lit(total)
    hot, cold = table.where(is_hot).drop("n"), table.where(~is_hot).drop("n")
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(cold, key))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches; ``links`` is (a, b).

    Large-star and small-star steps alternate until nothing changes: each node hands the
    smallest node it knows to its larger, then to its smaller neighbours. A star's centre
    may hold any share of the links.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = materialize(_star(both, F.col("b") > F.col("a"), False), "large-star")
        edges = materialize(_star(edges, F.lit(True), True), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = now


def _star(edges: DataFrame, kept, itself: bool) -> DataFrame:
    """Each neighbour that is kept (and the node itself) beside the smallest node of node and neighbours."""
    total = edges.count()
    least = edges.groupBy("a").agg(F.count("*").alias("n"), F.least(F.col("a"), F.min("b")).alias("m"))
    handed = looked_up(edges, least, "a", total).where(kept).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if itself:
        handed = handed.unionByName(least.select("a", F.col("m").alias("b")))
    return handed.where("a <> b").distinct()
