"""Exact top-k by distributed histogram selection.

Queries are handled in blocks of bounded size that travel to the vectors, which are read
in place and never shuffled or copied. For a block every score is computed, and a global
histogram of the scores of each query is refined until its k-th value is known. Then the
scores at or above it are filtered, and ties are broken by the smaller id.

A task sends, for a query, only the bins from its best score down to the bin where its own
count reaches k: a bin below cannot hold the global k-th value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.session import scratch_dir

SCALE = 1024
BINS = 1024
# Queries of a block: bounds what is broadcast (their components) and a task's histograms.
BLOCK_QUERIES = 4096
# Rows of a scored batch: bounds the score matrix of a task.
BATCH_ROWS = 512
EXACT = float(1 << 53)
RESULT = "query_id long, rank int, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), x as double.

    Rows with a null id, a null vector, or null or non-finite components are left out.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        "vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v")
    )


def _scores(items: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products, query by item; in floating point where that is exact."""
    if not items.size or not queries.size:
        return np.zeros((len(queries), len(items)), np.int64)
    bound = float(np.abs(items).max()) * float(np.abs(queries).max()) * items.shape[1]
    if bound < EXACT:
        return (queries.astype(np.float64) @ items.astype(np.float64).T).astype(np.int64)
    return queries @ items.T


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, components) of rows of one size each."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(start, BATCH_ROWS)
            ids, v = part.column(0).to_numpy(), part.column(1)
            sizes = v.value_lengths().to_numpy()
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for size in np.unique(sizes):
                rows = np.nonzero(sizes == size)[0]
                at = (ends[rows] - size)[:, None] + np.arange(size)
                yield ids[rows], flat[at]


class _Block:
    """A block of queries, by vector size; positions count through the whole block."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.ids = rows["vec_id"].to_numpy(np.int64)
        self.count = len(rows)
        sizes = rows["v"].map(len).to_numpy()
        self.parts = {
            int(size): (
                (at := np.nonzero(sizes == size)[0]),
                np.array([rows["v"].iloc[i] for i in at], np.int64).reshape(len(at), size),
            )
            for size in np.unique(sizes)
        }

    def scored(self, ids: np.ndarray, items: np.ndarray):
        """(positions, scores, whether the item counts) for the queries of the items' size."""
        at, queries = self.parts.get(items.shape[1], (None, None))
        if at is not None:
            yield at, _scores(items, queries), ids[None, :] != self.ids[at][:, None]


def _cut_below(counts: np.ndarray, k: int) -> np.ndarray:
    """Bins of each row that may hold its k-th best: from the top until k are counted."""
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    return (counts > 0) & (above < k)


def _kth_values(items: DataFrame, block: _Block, k: int, bins: int) -> np.ndarray:
    """The k-th best score of every query of a block; the least value if there are fewer."""
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(block)

    def extremes(batches):
        low = np.full(shared.value.count, np.iinfo(np.int64).max)
        high = np.full(shared.value.count, np.iinfo(np.int64).min)
        for ids, vectors in _batches(batches):
            for at, scores, counts in shared.value.scored(ids, vectors):
                low[at] = np.minimum(low[at], np.where(counts, scores, low[at][:, None]).min(axis=1))
                high[at] = np.maximum(high[at], np.where(counts, scores, high[at][:, None]).max(axis=1))
        found = np.nonzero(high >= low)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(low[found]), pa.array(high[found])], ["q", "low", "high"])

    ends = items.mapInArrow(extremes, "q long, low long, high long").groupBy("q").agg(
        F.min("low").alias("low"), F.max("high").alias("high")
    ).toPandas()
    low, high = np.zeros(block.count, np.int64), np.full(block.count, -1, np.int64)
    low[ends["q"]], high[ends["q"]] = ends["low"], ends["high"]
    # How many of the k are still to be found within [low, high].
    wanted = np.full(block.count, k, np.int64)
    while True:
        open_queries = np.nonzero(high > low)[0]
        if not len(open_queries):
            return low
        # Widths that reach beyond a long would only come from saturated components.
        width = (high - low).astype(np.uint64) // np.uint64(bins) + np.uint64(1)
        state = spark.sparkContext.broadcast((low.copy(), high.copy(), width, wanted.copy()))

        def histogram(batches, state=state):
            low, high, width, wanted = state.value
            counts = np.zeros((shared.value.count, bins), np.int32)
            for ids, vectors in _batches(batches):
                for at, scores, counted in shared.value.scored(ids, vectors):
                    inside = counted & (scores >= low[at][:, None]) & (scores <= high[at][:, None])
                    row, col = np.nonzero(inside)
                    bin_of = (scores[row, col] - low[at][row]).astype(np.uint64) // width[at][row]
                    np.add.at(counts, (at[row], bin_of.astype(np.int64)), 1)
            q, b = np.nonzero(_cut_below(counts, wanted[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array(b), pa.array(counts[q, b].astype(np.int64))], ["q", "bin", "n"]
            )

        summed = items.mapInArrow(histogram, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        goals = spark.createDataFrame(pd.DataFrame({"q": open_queries, "wanted": wanted[open_queries]}))
        # One row per query: the bin that holds its k-th value, or its lowest if there are fewer.
        reached = (
            summed.join(goals, "q").withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0)))
            .where(F.col("above") < F.col("wanted"))
            .groupBy("q").agg(F.min_by(F.struct("bin", "above"), "bin").alias("x"))
            .select("q", "x.bin", "x.above").toPandas()
        )
        at, b = reached["q"].to_numpy(np.int64), reached["bin"].to_numpy(np.int64)
        begin = low[at] + b * width[at].astype(np.int64)
        high[at] = np.minimum(high[at], begin + (width[at] - np.uint64(1)).astype(np.int64))
        low[at] = begin
        wanted[at] -= reached["above"].to_numpy(np.int64)


def _at_or_above(items: DataFrame, block: _Block, kth: np.ndarray, k: int) -> DataFrame:
    """All scores above the k-th value, and of those equal to it the k smallest ids of each task."""
    shared = items.sparkSession.sparkContext.broadcast((block, kth))

    def kept(batches):
        block, kth = shared.value
        ties: dict[int, np.ndarray] = {}
        for ids, vectors in _batches(batches):
            for at, scores, counted in block.scored(ids, vectors):
                row, col = np.nonzero(counted & (scores > kth[at][:, None]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids[at[row]]), pa.array(ids[col]), pa.array(scores[row, col])],
                    ["query_id", "vec_id", "score"],
                )
                row, col = np.nonzero(counted & (scores == kth[at][:, None]))
                for r in np.unique(row).tolist():
                    equal = np.concatenate([ties.get(int(at[r]), ids[:0]), ids[col[row == r]]])
                    ties[int(at[r])] = np.sort(equal)[:k]
        for q, equal in ties.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(equal), block.ids[q])), pa.array(equal), pa.array(np.full(len(equal), kth[q]))],
                ["query_id", "vec_id", "score"],
            )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        items.mapInArrow(kept, "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def top_k(
    queries: DataFrame, items: DataFrame, k: int = 10, bins: int = BINS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """The ``k`` highest integer inner products of every query, ties to the smaller id.

    Both frames have vec_id and v (an array of integers, see :func:`quantized`); other
    columns are ignored. A row with a query's own id is no candidate for it, nor is a
    vector of another length. A query id that occurs several times is asked once, with its
    smallest vector; repeated item rows are candidates each. Fewer candidates than ``k``
    give fewer rows; no queries or no items give none.
    """
    spark = items.sparkSession
    items = items.select("vec_id", "v")
    asked = queries.select("vec_id", "v").groupBy("vec_id").agg(F.min("v").alias("v"))
    count = asked.count()
    # Half full on average, so that the hash leaves no block over its bound.
    blocks = max(1, -(-2 * count // block_queries)) if count > block_queries else 1
    path = scratch_dir(spark, "top-k")
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        # At most block_queries rows, as the hash deals them out.
        block = _Block(own.orderBy("vec_id").toPandas())
        if block.count:
            kth = _kth_values(items, block, k, bins)
            _at_or_above(items, block, kth, k).write.mode("append").parquet(path)
    if not count:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(path)
