"""Approximate nearest neighbours through cells, with a recall knob.

Vectors belong to the nearest of some centres. A query looks into its ``n_probe``
nearest cells only; probing all cells gives the exact answer. Inside the probed
cells scores are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrina.functions.vectors import l2_normalize
from vitrina.operators import streams
from vitrina.operators.similarity import BOUND_ROWS, DECIMALS, Block, against, best_rows, make_block, similarities, top_k_rows, vector_search
from vitrina.session import materialize, spread

# Centres travel with the tasks; more are an error, not a silent change.
MAX_CELLS = 1 << 16
# Without a number of probes: the share of the exact neighbours to find, and the vectors it is measured on.
RECALL = 0.9
RECALL_SAMPLE = 512
# Copies of vectors, one for each cell, that a task holds at once.
PLACED_ROWS = 1 << 14


@dataclass
class CellIndex:
    """Cell centres (at most ``MAX_CELLS`` unit vectors) and the vectors with their cell."""

    centres: np.ndarray
    rows: DataFrame

    def write(self, path: str) -> "CellIndex":
        """Store the index; its rows are partitioned by cell, so that a search reads the probed cells only."""
        spark = self.rows.sparkSession
        self.rows.write.mode("overwrite").partitionBy("pool").parquet(f"{path}/rows")
        cells = [(i, c.tolist()) for i, c in enumerate(self.centres)]
        spark.createDataFrame(cells, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return read_cells(spark, path)


def read_cells(spark: SparkSession, path: str) -> CellIndex:
    """A stored index: the centres come to the driver, the rows stay where they are."""
    cells = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
    centres = np.array(cells.column("centre").to_pylist(), dtype=float)
    rows = spark.read.parquet(f"{path}/rows")
    return CellIndex(centres, rows.withColumn("pool", F.col("pool").cast("string")))


def _placed(df: DataFrame, choose, cells: int = 1) -> DataFrame:
    """(id, v, label, pool): one row per vector and cell that ``choose`` names for it, ``cells`` at most.

    ``choose`` maps (similarities to the centres, table) to row and cell numbers.
    """
    most = max(PLACED_ROWS // cells, 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # A row is copied for every cell it meets: a few rows at a time.
            for start in range(0, batch.num_rows, most):
                table = pa.Table.from_batches([batch.slice(start, most)])
                r, c = choose(make_block(table).units, table)
                out = table.select(["id", "v", "label"]).take(pa.array(r)).append_column("pool", pa.array(c.astype(str)))
                yield from out.to_batches()

    element = df.schema["v"].dataType.simpleString()
    return spread(df).mapInArrow(assign, f"id long, v {element}, label string, pool string")


def _vectors(df: DataFrame) -> DataFrame:
    label = F.col("label") if "label" in df.columns else F.lit("")
    return df.where(F.col("v").isNotNull()).select(F.col("id").cast("long"), "v", label.alias("label"))


def _nearest_cells(units: np.ndarray, centres: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    scores = np.round(units @ centres.T, DECIMALS)
    return top_k_rows(scores, np.arange(len(centres)), min(count, len(centres)))


def _with_cells(df: DataFrame, centres: np.ndarray, count: int) -> DataFrame:
    """Every vector with its ``count`` nearest cells, one row each."""
    return _placed(_vectors(df), lambda units, _: _nearest_cells(units, centres, count), min(count, len(centres)))


def build_cells(items: DataFrame, n_cells: int | None = None, seed: int = 42) -> CellIndex:
    """Find cell centres and put every vector into its cell.

    The centres are learnt from all vectors and every vector is assigned. Without
    ``n_cells`` there are as many as the root of the row count, up to ``MAX_CELLS``.
    """
    rows = _vectors(items)
    if n_cells is not None and not 1 <= n_cells <= MAX_CELLS:
        raise ValueError(f"n_cells must lie between 1 and {MAX_CELLS}")
    n = rows.count()
    n_cells = min(n_cells or min(max(round(math.sqrt(n)), 1), MAX_CELLS), max(n, 1))
    if n_cells == 1:
        # Any centre serves; without vectors there is nothing to place.
        one = rows.select("v").first()
        centre = np.array([one.v if one else [1.0]], dtype=float)
        return CellIndex(centre / (np.linalg.norm(centre) + 1e-8), _with_cells(rows, centre, 1))
    features = spread(rows).select(array_to_vector(l2_normalize("v")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=10, featuresCol="features").fit(features)
    centres = np.asarray(model.clusterCenters())
    centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-8
    return CellIndex(centres, _with_cells(rows, centres, 1))


def _search(index: CellIndex, probes: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    schema = "query_id long, id long, same boolean, score double"

    def kernel(items: Block, asked: Block) -> pa.Table:
        scores = similarities(asked, items)
        if exclude_self:
            scores[asked.ids[:, None] == items.ids[None, :]] = -np.inf
        r, c = top_k_rows(scores, items.ids, k)
        same = (asked.column("label")[r] == items.column("label")[c]).astype(bool)
        return pa.table({"query_id": asked.ids[r], "id": items.ids[c], "same": same, "score": scores[r, c]})

    return against(index.rows, probes, kernel, schema, pooled=True, reduce=best_rows("query_id", "id", "score", k))


def _rank(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall_by_probes(index: CellIndex, k: int) -> np.ndarray:
    """Share of the ``k`` exact neighbours found with 1, 2, ... all cells probed.

    Measured on ``RECALL_SAMPLE`` stored vectors (smallest hashes of their ids) against all
    others, which one pass reads in place; the driver gets the sample and its neighbours.
    """
    sample = index.rows.select("id", "v", "label").orderBy(F.xxhash64("id"), "id").limit(RECALL_SAMPLE).toArrow()
    recall = np.ones(len(index.centres))
    if not sample.num_rows:
        return recall
    asked = index.rows.sparkSession.createDataFrame(sample).select(F.col("id").alias("query_id"), "v")
    found = vector_search(asked, index.rows.select("id", "v"), k + 1).where("query_id <> id").select("query_id", "id", "score")
    nearest = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    cells = index.rows.select("id", "pool").join(F.broadcast(nearest.where(F.col("rank") <= k)), "id").select("query_id", "pool").toPandas()
    if not len(cells):
        return recall
    scores = np.round(make_block(sample).units @ index.centres.T, DECIMALS)
    order = np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)
    row = {x: i for i, x in enumerate(sample.column("id").to_pylist())}
    at = order[[row[x] for x in cells.query_id], cells.pool.astype(int)]
    return np.cumsum(np.bincount(at, minlength=len(recall))) / len(at)


def probes_for(index: CellIndex, k: int, recall: float = RECALL) -> int:
    """The least number of probed cells that finds the share ``recall`` of the exact neighbours of a sample."""
    return int(np.argmax(recall_by_probes(index, k) >= min(recall, 1.0))) + 1


def ann_knn(
    queries: DataFrame, index: CellIndex, k: int, n_probe: int | None = None, exclude_self: bool = False, recall: float = RECALL
) -> DataFrame:
    """(query_id, id, score, rank): ``k`` nearest among the probed cells.

    Without ``n_probe`` it follows from ``recall``, measured on stored vectors; queries that
    are unlike those can find less. A cell with many vectors is cut into blocks like any
    other pool. Many queries stay in blocks past which the cells stream: a query is not
    copied for the cells it probes.
    """
    n_probe = probes_for(index, k, recall) if n_probe is None else n_probe
    if streams.many_unique(queries, BOUND_ROWS):
        centres = index.centres
        items = index.rows.where(F.col("v").isNotNull()).select("id", "v", "pool")
        return streams.ranked(streams.best_lists(
            queries, items, k, exclude_self, centres=centres, probes=lambda units: _nearest_cells(units, centres, n_probe)
        ))
    probes = _with_cells(queries.withColumnRenamed("query_id", "id"), index.centres, n_probe)
    return _rank(_search(index, probes, k, exclude_self).drop("same"), k)


def cell_radii(index: CellIndex) -> np.ndarray:
    """Largest angle between a centre and a vector of its cell, one number per cell."""
    centres = index.centres

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                cells = table.column("pool").to_numpy(zero_copy_only=False).astype(int)
                cosines = (make_block(table).units * centres[cells]).sum(axis=1)
                yield pa.RecordBatch.from_pydict({"cell": cells, "angle": np.arccos(np.clip(cosines, -1, 1))})

    radii = np.zeros(len(centres))
    # At most MAX_CELLS rows.
    for row in index.rows.mapInArrow(widest, "cell long, angle double").groupBy("cell").agg(F.max("angle").alias("a")).collect():
        radii[row.cell] = row.a
    return radii


def exact_knn(rows: DataFrame, k: int, n_cells: int | None = None, n_probe: int = 2) -> DataFrame:
    """Exact ``k`` nearest other rows, leaving out cells that cannot hold one.

    A first look into the nearest cells gives every row a score that its k-th
    neighbour has at least. By the triangle inequality of angles a cell whose
    centre is further away than its radius allows for that score holds no
    neighbour; only the other cells are searched. Same columns as ``knn_join``.
    """
    rows = _vectors(rows)
    index = build_cells(rows, n_cells)
    index = CellIndex(index.centres, materialize(index.rows, "cells"))
    centres, radii = index.centres, cell_radii(index)
    first = materialize(_rank(_search(index, _with_cells(rows, centres, n_probe), k, True), k), "first-look")
    floor = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    bounded = rows.join(floor, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))

    def reachable(units: np.ndarray, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        angles = np.arccos(np.clip(units @ centres.T, -1, 1))
        best = np.cos(np.maximum(angles - radii, 0))
        open_cells = best >= table.column("floor").to_numpy()[:, None] - 1e-6
        open_cells[_nearest_cells(units, centres, n_probe)] = False
        return np.nonzero(open_cells)

    rest = _search(index, _placed(bounded, reachable, len(centres)), k, True)
    ranked = _rank(first.drop("rank").unionByName(rest), k)
    return ranked.select(
        F.col("query_id").alias("id"), F.col("id").alias("neighbour_id"), "same", F.col("score").alias("similarity"), "rank"
    )


def recall_against(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours (query_id, id) that the approximate list holds."""
    found = exact.select("query_id", "id").join(
        approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left"
    )
    return found.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"), F.count("*").alias("n"))
