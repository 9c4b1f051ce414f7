"""Approximate nearest neighbours from product-quantised codes, re-scored exactly.

A unit vector is its nearest centre and a code of one byte for each sub-vector of what is
left. A search looks up every code, which are a sixteenth of the vectors' bytes, keeps the
best by these approximate scores, reads the survivors' vectors from the cells they lie in
and ranks them by their exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrina.functions.vectors import cosine, l2_normalize
from vitrina.operators import streams
from vitrina.operators.similarity import BOUND_ROWS, DECIMALS, as_matrix, make_block, vector_search
from vitrina.session import materialize, parallelism, spread

# The bound of the fit: vectors that centres and code books are learnt from.
SAMPLE_ROWS = 1 << 14
CENTRES = 64
WORDS = 256
# Components of a sub-vector, and the survivors read for each wanted neighbour.
PART = 4
SURVIVORS = 16
_STEPS = 12


def _book(points: np.ndarray, seed: int) -> np.ndarray:
    """At most ``WORDS`` means of the points by Lloyd's steps."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    if len(distinct) <= WORDS:
        return distinct
    book = distinct[np.sort(rng.permutation(len(distinct))[:WORDS])]
    for _ in range(_STEPS):
        nearest = _nearest(points, book)
        counts = np.bincount(nearest, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, nearest, points)
        book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], points[rng.integers(len(points), size=len(book))])
    return book


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book ** 2).sum(axis=1)[None, :] - 2 * points @ book.T).argmin(axis=1)


def _parts(matrix: np.ndarray) -> np.ndarray:
    """Sub-vectors (row, part, component); zeros fill the last part."""
    n, d = matrix.shape
    parts = -(-d // PART)
    wide = np.zeros((n, parts * PART))
    wide[:, :d] = matrix
    return wide.reshape(n, parts, PART)


@dataclass
class CodeIndex:
    """Centres and code books (bounded), codes (id, cell, code) and vectors (id, v) by cell."""

    centres: np.ndarray
    books: list[np.ndarray]
    codes: DataFrame
    vectors: DataFrame

    @property
    def _matrix(self) -> streams.Matrix:
        """What the codes (cell, code) of a table say, in single precision."""
        centres, books, d = self.centres, self.books, self.centres.shape[1]

        def matrix(table: pa.Table) -> np.ndarray:
            code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)
            rest = np.concatenate([book[code[:, j]] for j, book in enumerate(books)], axis=1)[:, :d]
            return (centres[table.column("cell").to_numpy()] + rest).astype(np.float32)

        return matrix

    def decoded(self) -> DataFrame:
        """(id, v): what the codes say; only codes are read."""
        d, matrix = self.centres.shape[1], self._matrix

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ends = pa.array(np.arange(batch.num_rows + 1) * d, pa.int32())
                found = pa.array(matrix(pa.Table.from_batches([batch])).ravel())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, found)], ["id", "v"])

        return self.codes.mapInArrow(look_up, "id long, v array<float>")

    def survivors(self, queries: DataFrame, k: int, kept: int | None = None) -> DataFrame:
        """(query_id, id): the rows whose vectors a search reads."""
        kept = kept or SURVIVORS * k
        if streams.many_unique(queries, BOUND_ROWS):
            return self._lists(queries, kept).select("query_id", F.explode("id").alias("id"))
        return vector_search(queries, self.decoded(), kept).select("query_id", "id")

    def _lists(self, queries: DataFrame, kept: int) -> DataFrame:
        """(query_id, id, score): the survivors of many queries as lists; codes travel, not what they say."""
        return streams.best_lists(queries, self.codes, kept, matrix=self._matrix)

    def search(self, queries: DataFrame, k: int, kept: int | None = None, exclude_self: bool = False) -> DataFrame:
        """(query_id, id, score, rank): the ``k`` best by exact score of the ``kept`` best by code for each query (query_id, v).

        ``exclude_self`` leaves out the row whose id is the query's. Queries without a vector
        have no neighbours.
        """
        queries = queries.select(F.col("query_id").cast("long"), "v")
        if streams.many_unique(queries, BOUND_ROWS) and streams.many_unique(self.codes.withColumn("v", F.lit(True)), 0, "id"):
            return self._search_many(queries, k, kept or SURVIVORS * (k + int(exclude_self)), exclude_self)
        asked = queries.where(F.col("v").isNotNull()).select("query_id", F.col("v").alias("__q"))
        near = self.survivors(queries, k + int(exclude_self), kept)
        if exclude_self:
            near = near.where("query_id <> id")
        # Cells first, so that only the files of cells with survivors are read.
        placed = materialize(near.join(self.codes.select("id", "cell"), "id"), "survivors")
        scored = self.vectors.join(placed, ["cell", "id"]).join(asked, "query_id").select(
            "query_id", "id", F.round(cosine("v", "__q"), DECIMALS).alias("score")
        )
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def _search_many(self, queries: DataFrame, k: int, kept: int, exclude_self: bool) -> DataFrame:
        """``search`` of many queries and items with ids of their own.

        Queries lie in blocks with the lists of their survivors; a survivor's vector goes to a
        block once, however many of its queries have it.
        """
        asked = queries.where(F.col("v").isNotNull()).select("query_id", F.col("v").alias("asked"))
        lists = materialize(self._lists(queries, kept).select("query_id", F.col("id").alias("near")), "survivors")
        blocks = streams.block_count(asked.count(), parallelism(queries.sparkSession))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
        needed = lists.select(block, F.explode("near").alias("id")).distinct()

        class Block:
            def __init__(self, table: pa.Table):
                units = streams.unit_rows(as_matrix(table.column("asked"), table.num_rows))
                self.best = streams.Best(table.column("query_id").to_numpy(), units, k, exclude_self)
                near = table.column("near").combine_chunks()
                ids = near.flatten().to_numpy()
                order = np.argsort(ids, kind="stable")
                self.ids, self.rows = ids[order], np.repeat(np.arange(table.num_rows), near.value_lengths().to_numpy())[order]

            def see(self, table: pa.Table) -> None:
                ids, units = table.column("id").to_numpy(), streams.unit_rows(streams.plain_matrix(table))
                low, high = (np.searchsorted(self.ids, ids, side) for side in ("left", "right"))
                held = high - low
                c = np.repeat(np.arange(len(ids)), held)
                r = self.rows[np.arange(len(c)) + np.repeat(low - (np.cumsum(held) - held), held)]
                for start in range(0, len(r), streams.PAIRS):
                    self.best.score(r[start:start + streams.PAIRS], c[start:start + streams.PAIRS], ids, units)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in streams.by_block(batches, Block, streams.CHUNK_ROWS):
                yield from found.best.lists()

        asked = asked.join(lists, "query_id").select("query_id", "asked", "near", block)
        items = self.vectors.select("id", "v").join(needed, "id").select("id", "v", "block")
        return streams.ranked(streams.in_blocks(asked, items, blocks, []).mapInArrow(run, streams.LISTED))

    def recall(self, queries: DataFrame, k: int, kept: int | None = None, exclude_self: bool = False) -> DataFrame:
        """One row: queries, the share of their exact ``k`` neighbours found, and the share of the vectors' bytes a query reads."""
        wanted = queries.select(F.col("query_id").cast("long"), "v").where(F.col("v").isNotNull())
        exact = vector_search(wanted, self.vectors.select("id", "v"), k + int(exclude_self))
        if exclude_self:
            order = Window.partitionBy("query_id").orderBy("rank")
            exact = exact.where("query_id <> id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = self.search(wanted, k, kept, exclude_self).select("query_id", "id", F.lit(1.0).alias("hit"))
        hits = exact.join(found, ["query_id", "id"], "left").agg(
            F.count_distinct("query_id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall")
        )
        codes = (len(self.books) + 4) / (4.0 * self.centres.shape[1])
        share = F.least(F.lit(1.0), F.lit(codes) + F.lit(float(kept or SURVIVORS * (k + int(exclude_self)))) / F.lit(float(self.codes.count())))
        return hits.withColumn("bytes_share", share)


def build_codes(items: DataFrame, path: str, seed: int = 42) -> CodeIndex:
    """Learn centres and code books, code every vector of (id, v) and store the index.

    The fit sees the ``SAMPLE_ROWS`` vectors with the smallest hashes of their ids; every
    vector is coded. Rows without a vector have no code; without vectors it is an error.
    """
    spark = items.sparkSession
    rows = items.where(F.col("v").isNotNull()).select(F.col("id").cast("long"), "v")
    sample = materialize(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS), "code-sample")
    n = sample.count()
    if not n:
        raise ValueError("no vectors to code")
    features = spread(sample).select(array_to_vector(l2_normalize("v")).alias("features"))
    k = min(CENTRES, max(1, round(n ** 0.5)))
    centres = np.asarray(KMeans(k=k, seed=seed, maxIter=10, featuresCol="features").fit(features).clusterCenters()) if k > 1 else np.zeros(
        (1, len(sample.first().v))
    )

    def rest(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        units = make_block(table).units
        cell = _nearest(units, centres)
        return cell, _parts(units - centres[cell])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, parts = rest(pa.Table.from_batches([batch]))
                flat = parts.transpose(1, 0, 2).reshape(-1, PART)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.arange(parts.shape[1]), batch.num_rows), pa.int32()),
                    pa.array(list(flat), pa.list_(pa.float64())), pa.array(np.tile(batch.column("id").to_numpy(), parts.shape[1])),
                ], ["part", "x", "id"])

    def learn(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        book = _book(as_matrix(table.column("x"), table.num_rows)[order], seed)
        return pa.table({"part": table.column("part").slice(0, 1).cast(pa.int32()), "book": pa.array([book.ravel().tolist()], pa.list_(pa.float64()))})

    # One task for each part of the vectors, of the bounded sample only.
    books = sample.mapInArrow(cut, "part int, x array<double>, id long").groupBy("part").applyInArrow(learn, "part int, book array<double>")
    books.write.parquet(f"{path}/books")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    learnt = _books(spark, path)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, parts = rest(pa.Table.from_batches([batch]))
                words = np.stack([_nearest(parts[:, j], book) for j, book in enumerate(learnt)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array([w.tobytes() for w in words], pa.binary()),
                ], ["id", "v", "cell", "code"])

    kind = rows.schema["v"].dataType.simpleString()
    coded = spread(rows).mapInArrow(code, f"id long, v {kind}, cell int, code binary")
    # Written by cell, so that a search opens the cells of its survivors only.
    coded.write.partitionBy("cell").parquet(f"{path}/rows")
    return read_codes(spark, path)


def _books(spark: SparkSession, path: str) -> list[np.ndarray]:
    found = spark.read.parquet(f"{path}/books").orderBy("part").collect()
    return [np.array(r.book).reshape(-1, PART) for r in found]


def read_codes(spark: SparkSession, path: str) -> CodeIndex:
    """A stored index: centres and code books come to the driver, codes and vectors stay where they are."""
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])
    rows = spark.read.parquet(f"{path}/rows")
    # Two readings of one table: columns that a reading does not name are not read.
    return CodeIndex(centres, _books(spark, path), rows.select("id", "cell", "code"), rows.select("id", "cell", "v"))
