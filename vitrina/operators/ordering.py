"""Order-dependent operators without a single-task sort.

A window without partition keys would pull a whole table into one task. Here the
rows are first cut into ranges of the order key (quantile bounds, a bounded list),
and the ranges are linked through a table with one row per range.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.session import parallelism

ROWS_PER_RANGE = 1 << 18
MAX_RANGES = 20_000


def range_bounds(df: DataFrame, keys: list[str], rows: int) -> list[list[float]]:
    """Inner range bounds for every key column, found in one pass."""
    ranges = max(math.ceil(rows / ROWS_PER_RANGE), min(parallelism(df.sparkSession), max(rows // 1000, 1)))
    ranges = min(ranges, MAX_RANGES)
    if ranges <= 1:
        return [[] for _ in keys]
    probes = [i / ranges for i in range(1, ranges)]
    error = min(0.25 / ranges, 0.01)
    return [sorted(set(b)) for b in df.approxQuantile(keys, probes, error)]


def with_range(df: DataFrame, key: str, bounds: list[float], name: str) -> DataFrame:
    """Add the number of the range that ``key`` falls in; order is preserved.

    Without bounds zero is one: a constant range would turn later joins on it into
    cross joins.
    """
    splits = [-math.inf, *(bounds or [0.0]), math.inf]
    probe = f"__{name}_key"
    bucketizer = Bucketizer(splits=splits, inputCol=probe, outputCol=name)
    return bucketizer.transform(df.withColumn(probe, F.col(key).cast("double"))).drop(probe)


def _offsets(counts: DataFrame, part: list[Column | str]) -> DataFrame:
    """Rows before each range: a running sum over one row per range."""
    w = Window.partitionBy(*part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__offset", F.coalesce(F.sum("__n").over(w), F.lit(0)).cast("long"))


def dense_index(df: DataFrame, key: str, name: str = "idx", start: int | Column = 0) -> DataFrame:
    """Gap-free numbering in the order of a unique numeric ``key``."""
    rows = df.select(key).count()
    (bounds,) = range_bounds(df.select(key), [key], rows)
    ranged = with_range(df, key, bounds, "__range")
    offsets = _offsets(ranged.groupBy("__range").agg(F.count("*").alias("__n")), [])
    position = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    # One row per range: at most MAX_RANGES rows are broadcast.
    return (
        ranged.withColumn("__pos", position)
        .join(F.broadcast(offsets.select("__range", "__offset")), "__range")
        .withColumn(name, (F.col("__offset") + F.col("__pos") - 1 + start).cast("long"))
        .drop("__range", "__pos", "__offset")
    )


def assign_ids(df: DataFrame, order_key: str, existing: DataFrame | None = None, name: str = "id") -> DataFrame:
    """Dense increasing ids for new rows, continuing after the largest existing id."""
    start: int | Column = 1
    if existing is not None:
        start = existing.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).scalar() + F.lit(1)
    return dense_index(df, order_key, name, start)


# Rows that one file may have in a numbering over files.
FILE_ROWS_BITS = 36


def number_in_file_order(df: DataFrame, file: str, position: str, name: str) -> DataFrame:
    """Increasing numbers by file name, then by position in the file, whatever order files are read in.

    Positions need not begin at zero. The ranks of the files come from one row per file.
    """
    files = df.groupBy(file).agg(F.min(position).alias("__file_first"))
    ranked = files.withColumn("__file_rank", F.row_number().over(Window.orderBy(file)) - 1).withColumnRenamed(file, "__file_name")
    number = F.shiftleft(F.col("__file_rank").cast("long"), FILE_ROWS_BITS) + F.col(position) - F.col("__file_first")
    return df.join(ranked, F.col(file) == F.col("__file_name")).withColumn(name, number).drop("__file_name", "__file_rank", "__file_first")


def shift_by_one(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``value`` of the previous row in ``key`` order; the first row gets the last one.

    Inside a range it is ``lag``; the first row of a range takes the last value of
    the range before it, from a table with one row per range.
    """
    rows = df.select(key).count()
    (bounds,) = range_bounds(df.select(key), [key], rows)
    ranged = with_range(df, key, bounds, "__range")
    w = Window.partitionBy("__range").orderBy(key)
    ends = ranged.groupBy("__range").agg(F.max_by(value, key).alias("__end"))
    order = Window.orderBy("__range")
    ends = ends.withColumn("__before", F.lag("__end").over(order))
    last = F.last("__end").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("__range", F.coalesce("__before", last).alias("__before"))
    shifted = ranged.withColumn(name, F.lag(value).over(w)).withColumn(
        "__first", F.row_number().over(w) == 1
    )
    return (
        shifted.join(ends, "__range")
        .withColumn(name, F.when(F.col("__first"), F.col("__before")).otherwise(F.col(name)))
        .drop("__range", "__first", "__before")
    )


def exact_percentiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact linearly interpolated percentiles, one row.

    ``wanted`` maps an output name to (column, fraction). Values are counted by
    range, the ranks are located in these counts, and only the values of the ranges
    that hold a wanted rank are shuffled and ordered. ``df`` is read several times:
    pass a stored table.
    """
    columns = sorted({c for c, _ in wanted.values()})
    rows = df.count()
    all_bounds = dict(zip(columns, range_bounds(df.select(*columns), columns, rows)))
    ranged = df.select(*columns)
    for c in columns:
        ranged = with_range(ranged, c, all_bounds[c], f"__r_{c}")
    long = ranged.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("__col"), F.col(f"__r_{c}").alias("__range"), F.col(c).cast("double").alias("__val"))
        for c in columns
    ])).alias("x")).select("x.*").where(F.col("__val").isNotNull())
    counts = long.groupBy("__col", "__range").agg(F.count("*").alias("__n"))
    offsets = _offsets(counts, ["__col"]).withColumn("__total", F.sum("__n").over(Window.partitionBy("__col")))
    # The ranks a fraction needs: floor and ceiling of fraction * (n - 1).
    probes = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(c).alias("col"), F.lit(float(p)).alias("p"))
        for name, (c, p) in wanted.items()
    ])
    targets = (
        offsets.withColumn("t", F.explode(probes)).where(F.col("t.col") == F.col("__col"))
        .withColumn("__at", F.col("t.p") * (F.col("__total") - 1))
        .withColumn("__rank", F.explode(F.array_distinct(F.array(
            F.floor("__at").cast("long"), F.ceil("__at").cast("long")
        ))))
        .where((F.col("__rank") >= F.col("__offset")) & (F.col("__rank") < F.col("__offset") + F.col("__n")))
        .select("__col", "__range", "__offset", "__rank", "__at", F.col("t.name").alias("__name"))
    )
    # Other ranges are dropped where they are read; equal values shrink to a count.
    hit = long.join(
        F.broadcast(targets.select("__col", "__range", "__offset").distinct()), ["__col", "__range"]
    ).groupBy("__col", "__range", "__offset", "__val").agg(F.count("*").alias("__c"))
    w = Window.partitionBy("__col", "__range").orderBy("__val").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("__hi", F.col("__offset") + F.sum("__c").over(w)).withColumn(
        "__lo", F.col("__hi") - F.col("__c")
    )
    found = hit.join(F.broadcast(targets.drop("__offset")), ["__col", "__range"]).where(
        (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi"))
    )
    part = F.when(
        F.floor("__at") == F.ceil("__at"), F.col("__val")
    ).when(
        F.col("__rank") == F.floor("__at"), F.col("__val") * (F.ceil("__at") - F.col("__at"))
    ).otherwise(F.col("__val") * (F.col("__at") - F.floor("__at")))
    summed = found.groupBy("__name").agg(F.sum(part).alias("__v"))
    return summed.agg(*[
        F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in wanted
    ])


def first_n(df: DataFrame, order_key: str, n: int | None) -> DataFrame:
    """First ``n`` rows by a unique key; 0 or None keeps all.

    The cut-off is found on the key column alone: rows are counted by range, and only
    the range in which the n-th key lies is ordered. Then rows are filtered by it, so
    neither wide rows nor n keys ever meet in one task.
    """
    if not n:
        return df
    keys = df.select(order_key).where(F.col(order_key).isNotNull())
    rows = keys.count()
    if rows <= n:
        return df.where(F.col(order_key).isNotNull())
    (bounds,) = range_bounds(keys, [order_key], rows)
    ranged = with_range(keys, order_key, bounds, "__range")
    # One row per range.
    before = 0
    for r in sorted(ranged.groupBy("__range").agg(F.count("*").alias("n")).collect()):
        if before + r.n >= n:
            break
        before += r.n
    inside = ranged.where(F.col("__range") == r["__range"]).select(order_key).orderBy(order_key).limit(n - before)
    cut = inside.agg(F.max(order_key)).first()[0]
    return df.where(F.col(order_key) <= cut)


def sample_by_id(
    df: DataFrame, n: int | None, columns: list[str] | None = None, require: list[str] = (), key: str = "id"
) -> DataFrame:
    """The ``n`` rows with the smallest ids among those where ``require`` is not null."""
    for c in require:
        df = df.where(F.col(c).isNotNull())
    out = first_n(df, key, n)
    return out.select(*columns) if columns else out
