"""The best items of many queries: blocks of queries, past which all items stream.

A task holds a block of queries and the best rows found for each so far; items come in
batches, once for every block, and are let go. Products are taken in single precision
first: only pairs that can reach the worst row kept, by a bound of the rounding error, are
scored in double precision. So the rows are those of all products, and what leaves a task
is one list for each query, however many items there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.vectors import EPSILON
from vitrina.operators.similarity import DECIMALS, SCORED_AT_ONCE, as_matrix
from vitrina.session import parallelism

# Queries of a block, and of the strips it is worked through in; items that are multiplied at once.
QUERY_ROWS = 1 << 15
LEAST_ROWS = 1 << 11
STRIP_ROWS = 1 << 9
CHUNK_ROWS = 1 << 14
# Pairs of lists that are scored before the best are kept.
PAIRS = 1 << 18
# Lists that are handed on at once.
LISTS = 1 << 10
LISTED = "query_id long, id array<long>, score array<double>"

Matrix = Callable[[pa.Table], np.ndarray]


def plain_matrix(table: pa.Table) -> np.ndarray:
    return as_matrix(table.column("v"), table.num_rows)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + EPSILON) if matrix.size else matrix


class Best:
    """The ``k`` best items seen so far of every query, ties by smaller id."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.units, self.k, self.exclude_self = ids, units, k, exclude_self
        self.narrow = units.astype(np.float32)
        # Above the error of a product of unit vectors in single precision, for any order of its sum.
        self.slack = (units.shape[1] + 8) * 2.0 ** -23 + 10.0 ** -DECIMALS
        self.scores = np.full((len(ids), k), -np.inf)
        self.items = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, units: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Items for all queries, or for those of the numbers ``rows``."""
        whole = np.isfinite(units).all(axis=1)
        if not whole.all():
            ids, units = ids[whole], units[whole]
        rows = np.arange(len(self.ids)) if rows is None else rows
        narrow, order = units.astype(np.float32).T, np.argsort(ids, kind="stable")
        for start in range(0, len(rows) if len(ids) else 0, STRIP_ROWS):
            self._strip(rows[start:start + STRIP_ROWS], ids, units, narrow, order)

    def _strip(self, rows: np.ndarray, ids: np.ndarray, units: np.ndarray, narrow: np.ndarray, order: np.ndarray) -> None:
        part, m, k = self.narrow[rows] @ narrow, len(ids), self.k
        if self.exclude_self:
            low, high = (np.searchsorted(ids, self.ids[rows], side, sorter=order) for side in ("left", "right"))
            while (own := np.nonzero(low < high)[0]).size:
                part[own, order[low[own]]] = -np.inf
                low[own] += 1
        least = self.scores[rows, -1] - self.slack
        if m > k and (np.isneginf(least)).any():
            # At least k items reach this one.
            least = np.maximum(least, np.partition(part, m - k, axis=1)[:, m - k] - 2 * self.slack)
        r, c = np.nonzero((part >= least[:, None].astype(np.float32) - np.float32(1e-6)) & (part > -np.inf))
        self.score(rows[r], c, ids, units)

    def score(self, rows: np.ndarray, c: np.ndarray, ids: np.ndarray, units: np.ndarray) -> None:
        """Pairs of a query and an item by their exact scores."""
        if self.exclude_self:
            other = self.ids[rows] != ids[c]
            rows, c = rows[other], c[other]
        if not len(rows):
            return
        k = self.k
        score = np.concatenate([
            np.einsum("ij,ij->i", self.units[rows[i:i + SCORED_AT_ONCE]], units[c[i:i + SCORED_AT_ONCE]])
            for i in range(0, len(rows), SCORED_AT_ONCE)
        ]).round(DECIMALS)
        kept = score >= self.scores[rows, -1]
        rows, c, score = rows[kept], c[kept], score[kept]
        met = np.unique(rows)
        row = np.concatenate([np.repeat(met, k), rows])
        scores = np.concatenate([self.scores[met].ravel(), score])
        items = np.concatenate([self.items[met].ravel(), ids[c]])
        ranked = np.lexsort((items, -scores, row))
        row = row[ranked]
        first = ranked[np.arange(len(row)) - np.searchsorted(row, row) < k]
        self.scores[met], self.items[met] = scores[first].reshape(-1, k), items[first].reshape(-1, k)

    def lists(self) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.ids), LISTS):
            scores, items = self.scores[start:start + LISTS], self.items[start:start + LISTS]
            held = np.isfinite(scores)
            ends = pa.array(np.concatenate([[0], np.cumsum(held.sum(axis=1))]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(self.ids[start:start + LISTS]), pa.ListArray.from_arrays(ends, pa.array(items[held])),
                pa.ListArray.from_arrays(ends, pa.array(scores[held])),
            ], ["query_id", "id", "score"])


def in_blocks(queries: DataFrame, items: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Queries (block, kind 0) and items (block, kind 1), each block in a partition, queries first, items by ``order``.

    Both have a ``block``; a column that one side does not have is null there.
    """
    sides = [queries.withColumn("kind", F.lit(0)), items.withColumn("kind", F.lit(1))]
    return sides[0].unionByName(sides[1], allowMissingColumns=True).repartitionById(n, F.col("block")).sortWithinPartitions("block", "kind", *order)


def by_block(batches: Iterator[pa.RecordBatch], start: Callable[[pa.Table], object], chunk_rows: int) -> Iterator[object]:
    """Each block's object, made from its queries, when it has seen the block's items: ``see(table)`` gets them in chunks."""
    block, asked, made, held, size = None, [], None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
        for begin, end in zip(*(lambda e: (e[:-1], e[1:]))([0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]), strict=True):
            part, own = batch.slice(begin, end - begin), keys[begin] // 2
            if own != block:
                if made is not None:
                    if held:
                        made.see(pa.Table.from_batches(held))
                    yield made
                block, asked, made, held, size = own, [], None, [], 0
            if keys[begin] % 2 == 0:
                asked.append(part)
                continue
            if made is None:
                if not asked:
                    continue
                made = start(pa.Table.from_batches(asked))
            held.append(part)
            size += part.num_rows
            if size >= chunk_rows:
                made.see(pa.Table.from_batches(held))
                held, size = [], 0
    if made is not None:
        if held:
            made.see(pa.Table.from_batches(held))
        yield made


def block_count(n: int, cores: int, rows: int = QUERY_ROWS) -> int:
    """Full blocks at scale, some for every core below."""
    return max(-(-n // rows), min(2 * cores, -(-n // LEAST_ROWS)), 1)


def best_lists(
    queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = False, matrix: Matrix = plain_matrix,
    centres: np.ndarray | None = None, probes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None,
) -> DataFrame:
    """(query_id, id, score): the ``k`` best items of each query (query_id, v) as lists, best first.

    ``matrix`` makes vectors of the items' columns besides ``id``. With ``centres``, items have
    a ``pool``, and ``probes`` gives rows of queries and the pools that each one meets.
    """
    queries = queries.where(F.col("v").isNotNull()).select(F.col("query_id").cast("long"), F.col("v").alias("asked"))
    n = queries.count()
    rows = QUERY_ROWS if centres is None else min(QUERY_ROWS, max((1 << 27) // len(centres), LEAST_ROWS))
    blocks = block_count(n, parallelism(queries.sparkSession), rows)
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    placed = items.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pooled = centres is not None

    class Block:
        def __init__(self, table: pa.Table):
            units = unit_rows(as_matrix(table.column("asked"), table.num_rows))
            self.best = Best(table.column("query_id").to_numpy(), units, k, exclude_self)
            if pooled:
                self.met = np.zeros((len(units), len(centres)), bool)
                for start in range(0, len(units), STRIP_ROWS):
                    r, c = probes(units[start:start + STRIP_ROWS])
                    self.met[r + start, c] = True

        def see(self, table: pa.Table) -> None:
            units, ids = unit_rows(matrix(table)), table.column("id").to_numpy()
            if not pooled:
                return self.best.see(ids, units)
            pool = table.column("pool").to_numpy(zero_copy_only=False).astype(int)
            for one in np.unique(pool):
                own = np.nonzero(pool == one)[0]
                self.best.see(ids[own], units[own], np.nonzero(self.met[:, one])[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_block(batches, Block, CHUNK_ROWS):
            yield from block.best.lists()

    return in_blocks(asked, placed, blocks, ["pool"] if pooled else []).mapInArrow(run, LISTED)


def ranked(lists: DataFrame) -> DataFrame:
    """(query_id, id, score, rank) of lists."""
    both = lists.select("query_id", F.posexplode(F.arrays_zip("id", "score")))
    return both.select("query_id", F.col("col.id").alias("id"), F.col("col.score").alias("score"), (F.col("pos") + 1).alias("rank"))


def many_unique(queries: DataFrame, bound: int, key: str = "query_id") -> bool:
    """Whether there are more than ``bound`` queries with a vector, and none has the id of another."""
    asked = queries.where(F.col("v").isNotNull()).select(F.col(key).cast("long").alias("q"))
    if asked.limit(bound + 1).count() <= bound:
        return False
    found = asked.groupBy("q").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count_if(F.col("q").isNull()).alias("nulls")).first()
    return found.most == 1 and not found.nulls
