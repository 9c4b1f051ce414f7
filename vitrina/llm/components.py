"""Connected components of an edge table, in logarithmically many joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.session import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link every node's larger (or smaller) neighbours to the least node around it.

    ``edges`` has both directions. The least neighbour is a partial aggregate, so a node
    with very many links costs one row per task.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = edges.join(least, "a")
    side = F.col("b") > F.col("a") if large else F.col("b") < F.col("a")
    linked = joined.where(side).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        linked = linked.unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where(F.col("a") != F.col("b")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _digest(edges: DataFrame):
    return edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.hash("a", "b").cast("long")).alias("s")
    ).first()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that can be reached, for every id that has a link.

    ``edges`` has two comparable columns a and b without nulls; direction, repetitions and
    loops do not matter. No edges give no rows. Alternates large and small stars until
    nothing changes; each step is a table in the shared folder.
    """
    edges = materialize(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    while True:
        now = _digest(edges)
        if now == before or now.n == 0:
            return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        before = now
        large = materialize(_stars(_both(edges), large=True), "large-stars")
        edges = materialize(_stars(_both(large), large=False), "small-stars")
