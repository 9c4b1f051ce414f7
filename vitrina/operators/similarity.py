"""Cosine similarity joins in bounded blocks.

No pair of rows is ever emitted: a block of rows meets a block of rows as two
matrices, and a kernel reduces their product to at most a few values per row
before anything is shuffled. Two ways bring blocks together:

* ``against``: one side is small, which is checked by reading at most
  ``BOUND_ROWS`` + 1 rows of it. That side travels with the task and the other is
  read in place without a shuffle. A larger side falls through to tiles.
* ``within`` / tiles: rows are hashed to blocks of about ``BLOCK_ROWS`` and each
  pair of blocks is one group. A pool (say a city) that holds a third of all rows
  becomes many blocks; small pools share a block and stay separate in the kernel.

Where partial rows can be put together inside the task, tiles are ``TILE_ROWS`` wide and
worked through in strips of ``BLOCK_ROWS``: rows are copied, and partial rows shuffled, once
per wide tile.

Similarities are compared at ten decimals, so that copies of one vector tie
exactly and are ordered by id whichever block they meet in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrina.functions.vectors import EPSILON
from vitrina.session import parallelism, spread

BLOCK_ROWS = 2048
BOUND_ROWS = 4096
MIN_BLOCK_ROWS = 256
# Blocks of a whole table against itself; their tiles are worked through in strips of ``BLOCK_ROWS``.
WIDE_ROWS = 8192
# Blocks of a tile that is worked through in strips and reduced before anything leaves the task,
# and the partial rows that are held before they are reduced.
TILE_ROWS = 1 << 15
HELD_ROWS = 1 << 19
# Bounded products: vectors the axes are learnt from, share of the axes that is multiplied
# first, rows that are tried, share of the pairs above which bounds do not pay.
AXES_ROWS = 4096
PREFIX = 0.25
PROBED_ROWS = 64
MOST_SCORED = 0.1
SCORED_AT_ONCE = 1 << 16
DECIMALS = 10
NEIGHBOURS = "id long, neighbour_id long, same boolean, similarity double, pool string"


@dataclass
class Block:
    """Rows of one side of a tile, unit vectors as a matrix."""

    table: pa.Table
    ids: np.ndarray
    units: np.ndarray

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy(zero_copy_only=False)

    def strips(self) -> Iterator["Block"]:
        for start in range(0, len(self.ids), BLOCK_ROWS):
            end = start + BLOCK_ROWS
            yield Block(self.table.slice(start, BLOCK_ROWS), self.ids[start:end], self.units[start:end])

    def take(self, rows: np.ndarray) -> "Block":
        return Block(self.table.take(pa.array(rows)), self.ids[rows], self.units[rows])


def as_matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float32())
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if rows == 0:
        return np.zeros((0, 0))
    if values.size % rows:
        raise ValueError("vectors of different dimensions in one column")
    return values.reshape(rows, -1)


def make_block(table: pa.Table) -> Block:
    matrix = as_matrix(table.column("v"), table.num_rows)
    units = matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + EPSILON) if matrix.size else matrix
    ids = table.column("id").to_numpy() if table.num_rows else np.zeros(0, np.int64)
    return Block(table, ids, units)


def similarities(a: Block, b: Block) -> np.ndarray:
    return np.round(a.units @ b.units.T, DECIMALS)


def top_k_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best columns of every row, ties by smaller id."""
    rows, columns = scores.shape
    if columns > k:
        kth = np.partition(scores, columns - k, axis=1)[:, columns - k]
        r, c = np.nonzero(scores >= kth[:, None])
    else:
        r, c = np.nonzero(np.ones_like(scores, dtype=bool))
    keep = np.isfinite(scores[r, c])
    r, c = r[keep], c[keep]
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    starts = np.searchsorted(r, np.arange(rows))
    first = np.arange(len(r)) - starts[r] < k
    return r[first], c[first]


Kernel = Callable[[Block, Block], pa.Table]
Reduce = Callable[[pa.Table], pa.Table]


def best_rows(key: str, other: str, score: str, k: int) -> Reduce:
    """Keeps the ``k`` best rows of every key, ties by the smaller other id."""
    def reduce(found: pa.Table) -> pa.Table:
        keys, others, scores = (found.column(c).to_numpy() for c in (key, other, score))
        order = np.lexsort((others, -scores, keys))
        ranked = keys[order]
        return found.take(pa.array(order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < k]))

    return reduce


def summed_rows(**columns: str) -> Reduce:
    """Puts the rows of every ``id`` together: ``columns`` name how each is summed up (sum, min, max)."""
    def reduce(found: pa.Table) -> pa.Table:
        grouped = found.group_by("id").aggregate(list(columns.items()))
        return pa.table({"id": grouped.column("id"), **{c: grouped.column(f"{c}_{how}") for c, how in columns.items()}})

    return reduce


def reduced(parts: Iterator[pa.Table], reduce: Reduce) -> pa.Table | None:
    """All parts as one reduced table; little more than ``HELD_ROWS`` partial rows are held at a time."""
    held, rows, most = [], 0, HELD_ROWS
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows > most:
            held = [reduce(pa.concat_tables(held))]
            rows = held[0].num_rows
            most = max(HELD_ROWS, 2 * rows)
    return reduce(pa.concat_tables(held)) if held else None


def _by_pool(kernel: Kernel, left: Block, right: Block, same: bool) -> Iterator[pa.Table]:
    """Run the kernel for every pool that both sides hold."""
    lp, rp = left.column("pool"), right.column("pool")
    if len(lp) == 0 or len(rp) == 0:
        return
    if lp[0] == rp[0] and (lp == lp[0]).all() and (rp == rp[0]).all():
        yield kernel(left, left if same else right)
        return
    lv, lc = np.unique(lp, return_inverse=True)
    rv, rc = np.unique(rp, return_inverse=True)
    lo, ro = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
    ls, rs = np.searchsorted(lc[lo], np.arange(len(lv) + 1)), np.searchsorted(rc[ro], np.arange(len(rv) + 1))
    where = {value: i for i, value in enumerate(rv)}
    for i, value in enumerate(lv):
        j = where.get(value)
        if j is None:
            continue
        a = left.take(lo[ls[i]:ls[i + 1]])
        yield kernel(a, a if same else right.take(ro[rs[j]:rs[j + 1]]))


def _partitions(tiles: int, spark) -> int:
    cores = parallelism(spark)
    return max(cores, min(3 * tiles, max(8 * cores, tiles)))


def blocks_for(rows: int, cores: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks for ``rows`` rows: full blocks at scale, enough tiles for every core below."""
    for_cores = min(math.ceil(math.sqrt(2 * cores)), max(rows // MIN_BLOCK_ROWS, 1))
    return max(math.ceil(rows / block_rows), for_cores, 1)


def _with_pool(df: DataFrame, pool: Column | None) -> DataFrame:
    return df.withColumn("pool", F.lit("") if pool is None else pool)


def _hash_block(blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")


def within(
    df: DataFrame, kernel: Kernel, schema: str, pool: Column | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Every row against the rows of its pool, the row itself included.

    ``df`` has ``id``, ``v`` and whatever the kernel reads. For blocks a and b of
    a pool the kernel sees (a, b) once, a <= b, and has to serve both sides; it
    gets the same object twice when a = b.
    """
    spark = df.sparkSession
    cores = parallelism(spark)
    rows = _with_pool(df.where(F.col("v").isNotNull()), pool)
    counts = rows.groupBy("pool").agg(F.count("*").alias("__n"))
    if pool is None:
        n = rows.count()
        g = blocks_for(n, cores, block_rows)
        tiles = g * (g + 1) // 2
        keyed = rows.withColumn("__g", F.lit(g)).withColumn("__tile_key", F.lit(0).cast("long"))
    else:
        # Pools above one block are cut; the rest is packed so that a tile holds
        # about one block of rows, whatever the number of pools.
        size = F.greatest(F.ceil(F.col("__n") / BLOCK_ROWS), F.lit(1)).cast("int")
        totals = counts.agg(
            F.sum(F.when(size == 1, F.col("__n")).otherwise(0)).alias("small"),
            F.sum(F.when(size > 1, size * (size + 1) / 2).otherwise(0)).cast("long").alias("tiles"),
        ).first()
        small = totals["small"] or 0
        bins = max(math.ceil(small / BLOCK_ROWS), min(cores, max(small // 64, 1)))
        tiles = (totals["tiles"] or 0) + bins
        sized = counts.select("pool", size.alias("__g"))
        pool_hash = F.xxhash64("pool")
        keyed = rows.join(sized, "pool").withColumn(
            "__tile_key", F.when(F.col("__g") > 1, pool_hash).otherwise(F.pmod(pool_hash, F.lit(bins)))
        )
    keyed = keyed.withColumn("__b", F.when(F.col("__g") > 1, _hash_block(F.col("__g"))).otherwise(F.lit(0)))
    placed = (
        keyed.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__g") - 1)))
        .withColumn("__lo", F.least("__b", "__o")).withColumn("__hi", F.greatest("__b", "__o"))
        .withColumn("__side", F.col("__b") == F.col("__lo"))
        .drop("__g", "__o", "__b")
    )
    keys = ["__tile_key", "__lo", "__hi"]

    def run(group: pa.Table) -> pa.Table:
        side = group.column("__side").to_numpy(zero_copy_only=False)
        block = make_block(group)
        left, right = block.take(np.nonzero(side)[0]), block.take(np.nonzero(~side)[0])
        # A diagonal tile has one side only.
        alone = group.column("__lo")[0].as_py() == group.column("__hi")[0].as_py()
        parts = list(_by_pool(kernel, left, left if alone else right, alone))
        return _concat(parts, schema_arrow)

    schema_arrow = _arrow_schema(spark, schema)
    return placed.repartition(_partitions(tiles, spark), *keys).groupBy(*keys).applyInArrow(run, schema)


def _arrow_empty(ddl: str) -> pa.Table:
    return _arrow_schema(None, ddl).empty_table()


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def _concat(parts: list[pa.Table], schema: pa.Schema) -> pa.Table:
    if not parts:
        return schema.empty_table()
    return pa.concat_tables([p.cast(schema) for p in parts])


def against(
    left: DataFrame, right: DataFrame, kernel: Kernel, schema: str,
    pooled: bool = False, bound: int = BOUND_ROWS, *, reduce: Reduce | None = None,
) -> DataFrame:
    """Every left row against every right row (of its ``pool`` when ``pooled``).

    Both sides have ``id`` and ``v``. The right side should be the smaller one. With
    ``reduce``, which puts partial rows of a kernel together, tiles are wide: a row is copied
    once for ``TILE_ROWS`` rows of the other side, and a task hands on reduced rows.
    """
    spark = left.sparkSession
    if not pooled:
        left, right = _with_pool(left, None), _with_pool(right, None)
    left, right = left.where(F.col("v").isNotNull()), right.where(F.col("v").isNotNull())
    schema_arrow = _arrow_schema(spark, schema)
    small = right.limit(bound + 1).toArrow()
    if small.num_rows <= bound:
        if pooled:
            # At most ``bound`` values; prunes the files of a table partitioned by pool.
            left = left.where(F.col("pool").isin(small.column("pool").unique().to_pylist()))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fixed = make_block(small)
            for batch in batches:
                if batch.num_rows and fixed.ids.size:
                    block = make_block(pa.Table.from_batches([batch]))
                    yield from _concat(list(_by_pool(kernel, block, fixed, False)), schema_arrow).to_batches()

        return spread(left).mapInArrow(scan, schema)

    cores = parallelism(spark)
    n_left, n_right = left.count(), right.count()
    if pooled:
        # Few pools still give every core some blocks of the left side.
        l_rows, r_rows = BLOCK_ROWS, BLOCK_ROWS
        if reduce:
            l_rows, r_rows = min(max(n_left // (4 * cores), BLOCK_ROWS), TILE_ROWS), TILE_ROWS

        # Blocks per pool and side, from one row per pool.
        def sizes(df: DataFrame, name: str, rows: int) -> DataFrame:
            n = F.greatest(F.ceil(F.count("*") / rows), F.lit(1)).cast("int")
            return df.groupBy("pool").agg(n.alias(name))

        pools = sizes(left, "__gl", l_rows).join(sizes(right, "__gr", r_rows), "pool")
        left, right = left.join(pools, "pool"), right.join(pools, "pool")
        tiles = math.ceil(n_left / BLOCK_ROWS) * math.ceil(n_right / BLOCK_ROWS)
        tiles = min(tiles, 16 * cores)
    else:
        if reduce:
            # Full tiles at scale, enough of them for every core below.
            gl, gr = (
                max(math.ceil(n / TILE_ROWS), min(math.ceil(math.sqrt(2 * cores)), math.ceil(n / BLOCK_ROWS)), 1)
                for n in (n_left, n_right)
            )
        else:
            gl = max(math.ceil(n_left / BLOCK_ROWS), math.ceil(math.sqrt(cores)))
            gr = max(math.ceil(n_right / BLOCK_ROWS), 1)
        left = left.withColumn("__gl", F.lit(gl)).withColumn("__gr", F.lit(gr))
        right = right.withColumn("__gl", F.lit(gl)).withColumn("__gr", F.lit(gr))
        tiles = gl * gr
    l_placed = left.withColumn("__i", _hash_block(F.col("__gl"))).withColumn(
        "__j", F.explode(F.sequence(F.lit(0), F.col("__gr") - 1))
    ).drop("__gl", "__gr")
    r_placed = right.withColumn("__j", _hash_block(F.col("__gr"))).withColumn(
        "__i", F.explode(F.sequence(F.lit(0), F.col("__gl") - 1))
    ).drop("__gl", "__gr")
    # Both sides often come from one table: give the right one columns of its own.
    r_placed = r_placed.select(*[F.col(c).alias(c) for c in r_placed.columns])
    keys = ["pool", "__i", "__j"]
    n = _partitions(tiles, spark)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return schema_arrow.empty_table()
        x, y = make_block(a), make_block(b)
        if reduce is None:
            return kernel(x, y).cast(schema_arrow)
        return reduced((kernel(s, t) for t in y.strips() for s in x.strips()), reduce).cast(schema_arrow)

    return (
        l_placed.repartition(n, *keys).groupBy(*keys)
        .cogroup(r_placed.repartition(n, *keys).groupBy(*keys))
        .applyInArrow(run, schema)
    )


def rank_neighbours(partial: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per id out of block-wise bests, with ``rank`` from 1."""
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour_id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pairs(a: Block, b: Block, r: np.ndarray, c: np.ndarray, scores: np.ndarray) -> pa.Table:
    labels_a, labels_b = a.column("label"), b.column("label")
    return pa.table({
        "id": a.ids[r], "neighbour_id": b.ids[c], "same": (labels_a[r] == labels_b[c]).astype(bool),
        "similarity": scores[r, c], "pool": a.table.column("pool").take(pa.array(r)),
    })


def knn_join(df: DataFrame, k: int, pool: Column | None = None, label: Column | None = None) -> DataFrame:
    """Exact ``k`` nearest other rows by cosine for every row of (``id``, ``v``).

    With ``pool`` only rows of the same pool are neighbours; ``same`` tells whether
    the neighbour has the row's label.
    """
    from vitrina.operators import streams

    if pool is None and label is None and df.schema["id"].dataType.simpleString() == "bigint" and streams.many_unique(df, BOUND_ROWS, "id"):
        rows = df.where(F.col("v").isNotNull()).select("id", "v")
        found = streams.ranked(streams.best_lists(rows.withColumnRenamed("id", "query_id"), rows, k, exclude_self=True))
        return found.select(
            F.col("query_id").alias("id"), F.col("id").alias("neighbour_id"), F.lit(True).alias("same"), F.col("score").alias("similarity"), "rank"
        )
    rows = df.withColumn("label", F.lit("") if label is None else label)
    rows = rows.select("id", "v", "label", *([] if pool is None else [pool.alias("__pool")]))

    def strip(a: Block, b: Block, alone: bool) -> Iterator[pa.Table]:
        scores = similarities(a, b)
        if alone:
            np.fill_diagonal(scores, -np.inf)
        r, c = top_k_rows(scores, b.ids, k)
        yield _pairs(a, b, r, c, scores)
        if not alone:
            c2, r2 = top_k_rows(scores.T, a.ids, k)
            yield _pairs(b, a, c2, r2, scores.T)

    best = best_rows("id", "neighbour_id", "similarity", k)

    def kernel(a: Block, b: Block) -> pa.Table:
        # Each pair of strips meets once; a block without rows still gives an empty table.
        met = (
            part for i, x in enumerate(a.strips()) for j, y in enumerate(b.strips()) if a is not b or i <= j
            for part in strip(x, y, a is b and i == j)
        )
        found = reduced(met, best)
        return _arrow_empty(NEIGHBOURS) if found is None else found

    partial = within(rows, kernel, NEIGHBOURS, None if pool is None else F.col("__pool"), TILE_ROWS)
    ranked = rank_neighbours(partial, k)
    return ranked.drop("pool") if pool is None else ranked


def principal_axes(rows: DataFrame) -> np.ndarray:
    """Orthogonal axes, those along which unit vectors spread most first, as columns.

    Learnt from ``AXES_ROWS`` vectors at most (smallest hashes of their ids): any axes give
    the same neighbours, better ones only sooner.
    """
    sample = rows.select("id", "v").where(F.col("v").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(AXES_ROWS).toArrow()
    units = make_block(sample).units
    return np.linalg.eigh(units.T @ units)[1][:, ::-1] if units.size else np.zeros((0, 0))


def bounded_top_k(units: np.ndarray, others: Block, own: np.ndarray | None, k: int, axes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, column, similarity) of the ``k`` best others of every row, ties by smaller id.

    The first ``PREFIX`` of the axes give a part of the product, and the lengths of what is
    left bound the rest (Cauchy-Schwarz): a pair whose upper bound lies below the k-th best
    lower bound of its row is not scored. Where a few rows show that most pairs would have to
    be scored all the same, the product is taken whole. ``own`` are the rows' own ids.
    """
    def whole(rows: np.ndarray) -> np.ndarray:
        scores = np.round(units[rows] @ others.units.T, DECIMALS)
        if own is not None:
            scores[own[rows][:, None] == others.ids[None, :]] = -np.inf
        return scores

    n, m = len(units), len(others.ids)
    prefix = int(axes.shape[0] * PREFIX)
    every = np.arange(n)
    if not prefix or m <= 4 * k:
        scores = whole(every)
        r, c = top_k_rows(scores, others.ids, k)
        return r, c, scores[r, c]
    left, right = units @ axes, others.units @ axes
    rest = np.linalg.norm(right[:, prefix:], axis=1)

    def open_pairs(rows: np.ndarray) -> np.ndarray:
        part = left[rows, :prefix] @ right[:, :prefix].T
        slack = np.linalg.norm(left[rows, prefix:], axis=1)[:, None] * rest[None, :]
        # One more than k, as the row itself may be among them.
        low = np.partition(part - slack, m - k - 1, axis=1)[:, m - k - 1]
        return part + slack >= low[:, None] - 10.0 ** -DECIMALS

    if open_pairs(every[:: max(n // PROBED_ROWS, 1)]).mean() > MOST_SCORED:
        scores = whole(every)
        r, c = top_k_rows(scores, others.ids, k)
        return r, c, scores[r, c]
    r, c = np.nonzero(open_pairs(every))
    if own is not None:
        r, c = r[own[r] != others.ids[c]], c[own[r] != others.ids[c]]
    score = np.concatenate([
        np.einsum("ij,ij->i", units[r[i:i + SCORED_AT_ONCE]], others.units[c[i:i + SCORED_AT_ONCE]])
        for i in range(0, max(len(r), 1), SCORED_AT_ONCE)
    ]).round(DECIMALS)
    return _first_k(r, c, score, others.ids, k)


def _first_k(r: np.ndarray, c: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first], score[first]


def bounded_knn(df: DataFrame, k: int, label: Column | None = None) -> DataFrame:
    """Exact ``k`` nearest other rows of a whole table; columns as ``knn_join``.

    Each pair of blocks of ``WIDE_ROWS`` rows meets once and serves both sides, so a row is
    copied rows / ``WIDE_ROWS`` times. A tile is worked through in strips, which bounds its
    memory, and inside a strip bounds of the products leave out pairs.
    """
    rows = df.withColumn("label", F.lit("") if label is None else label).select("id", "v", "label")
    axes = principal_axes(rows)

    def one_side(a: Block, b: Block, alone: bool) -> pa.Table:
        parts = []
        for start in range(0, len(a.ids), BLOCK_ROWS):
            own = a.ids[start:start + BLOCK_ROWS]
            r, c, score = bounded_top_k(a.units[start:start + BLOCK_ROWS], b, own if alone else None, k, axes)
            parts.append((r + start, c, score))
        r, c, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        labels_a, labels_b = a.column("label"), b.column("label")
        return pa.table({
            "id": a.ids[r], "neighbour_id": b.ids[c], "same": (labels_a[r] == labels_b[c]).astype(bool), "similarity": score.astype(float),
            "pool": a.table.column("pool").take(pa.array(r)),
        })

    def kernel(a: Block, b: Block) -> pa.Table:
        if a is b:
            return one_side(a, a, True)
        return pa.concat_tables([one_side(a, b, False), one_side(b, a, False)])

    return rank_neighbours(within(rows, kernel, NEIGHBOURS, block_rows=WIDE_ROWS), k).drop("pool")


def pairwise_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per left row: how its similarities to all right rows are distributed.

    The n x n matrix itself only ever exists block by block.
    """
    schema = "id long, n long, total double, best double, worst double"

    def kernel(a: Block, b: Block) -> pa.Table:
        scores = a.units @ b.units.T
        return pa.table({
            "id": a.ids, "n": np.full(len(a.ids), scores.shape[1], np.int64),
            "total": scores.sum(axis=1), "best": scores.max(axis=1), "worst": scores.min(axis=1),
        })

    reduce = summed_rows(n="sum", total="sum", best="max", worst="min")
    part = against(left.select("id", "v"), right.select("id", "v"), kernel, schema, reduce=reduce)
    return part.groupBy("id").agg(
        F.sum("n").alias("n_pairs"), (F.sum("total") / F.sum("n")).alias("mean_similarity"),
        F.max("best").alias("max_similarity"), F.min("worst").alias("min_similarity"),
    )


def vector_search(queries: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``k`` nearest items for every query: (query_id, id, score, rank).

    ``queries`` has ``query_id`` and ``v``, ``items`` has ``id`` and ``v``; rows
    without a vector take no part. Few queries travel to the items, many are tiled.
    """
    from vitrina.operators import streams

    if streams.many_unique(queries, BOUND_ROWS):
        return streams.ranked(streams.best_lists(queries, items.select(F.col("id").cast("long"), "v").where(F.col("v").isNotNull()), k))
    schema = "query_id long, id long, score double"
    wanted = queries.select(F.col("query_id").cast("long").alias("id"), "v")

    def kernel(items_block: Block, query_block: Block) -> pa.Table:
        scores = similarities(query_block, items_block)
        r, c = top_k_rows(scores, items_block.ids, k)
        return pa.table({"query_id": query_block.ids[r], "id": items_block.ids[c], "score": scores[r, c]})

    best = against(items.select(F.col("id").cast("long"), "v"), wanted, kernel, schema, reduce=best_rows("query_id", "id", "score", k))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def partner_positions(pairs: DataFrame) -> DataFrame:
    """Position of the true partner in both directions, for rows (id, a, b).

    Position = 1 + rows that score better, ties by smaller id; a count, so nothing
    is sorted. Returns (id, a_to_b, b_to_a).
    """
    from vitrina.functions.vectors import cosine

    both = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    own = F.round(cosine("a", "b"), DECIMALS)
    left = both.select("id", F.col("a").alias("v"), own.alias("own"))
    right = both.select("id", F.col("b").alias("v"), own.alias("own"))
    schema = "id long, a_better long, b_better long"

    def kernel(x: Block, y: Block) -> pa.Table:
        scores = similarities(x, y)
        earlier = y.ids[None, :] < x.ids[:, None]
        other = y.ids[None, :] != x.ids[:, None]
        own_x, own_y = x.column("own")[:, None], y.column("own")[None, :]
        a_better = (((scores > own_x) | ((scores == own_x) & earlier)) & other).sum(axis=1)
        b_better = (((scores > own_y) | ((scores == own_y) & ~earlier)) & other).sum(axis=0)
        zero = np.zeros
        return pa.table({
            "id": np.concatenate([x.ids, y.ids]),
            "a_better": np.concatenate([a_better, zero(len(y.ids), np.int64)]),
            "b_better": np.concatenate([zero(len(x.ids), np.int64), b_better]),
        })

    part = against(left, right, kernel, schema, reduce=summed_rows(a_better="sum", b_better="sum"))
    return part.groupBy("id").agg(
        (F.sum("a_better") + 1).alias("a_to_b"), (F.sum("b_better") + 1).alias("b_to_a")
    )
