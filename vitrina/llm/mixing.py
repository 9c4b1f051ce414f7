"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source asks for its weighted share of all words. A source whose share exceeds its
maximum of epochs is clamped there and its excess goes to the others by weight, until no
share is above its clamp. Documents are then repeated: all of them for the whole epochs,
and for the rest those with the smallest seeded hashes.

The cut of a source is found in sums over hash buckets, so no source is ever ordered as a
whole: only the bucket in which the cut falls is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.common import WORD
from vitrina.session import materialize

EPOCHS = 3
SEED = 17
# A source's documents are dealt to so many buckets by the upper bits of their hashes.
BUCKET_BITS = 12
# Sources up to which their cuts are broadcast; beyond it both sides meet salted.
BROADCAST_SOURCES = 1_000_000
SALTS = 64
_NO_ID = -(1 << 63)


def word_count(text: Column) -> Column:
    """Number of words, those of a null text being 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """(source, weight): 1, 2, ... cycle, repeating in code point order, null last.

    ``sources`` has one row per source, which is what the ordering sees.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.select("source", ((place - 1) % cycle + 1).cast("long").alias("weight"))


def keyed(docs: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    """(source, id, h, size) of every document: what mixing needs to know."""
    identity = F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID))
    return docs.select(
        F.col(source).cast("string").alias("source"), identity.alias("id"), F.xxhash64(F.lit(seed), identity).alias("h"),
        word_count(F.col(text)).alias("size"),
    )


def filled(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Adds target, whole (epochs) and rest (words beyond them) to (source, size, weight).

    ``sources`` is a stored table with one row per source. Each turn clamps the sources
    above their limit at the present level; it ends when none is left. A source without
    words has target 0.
    """
    limit = (F.lit(epochs) * F.col("size")).cast("decimal(38,0)")
    total = int(sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    level, weight, clamped = total, None, -1
    above = F.lit(False)
    while True:
        now = sources.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(above, True)).alias("n"),
        ).first()
        if int(now.n) == clamped:
            break
        clamped, level, weight = int(now.n), total - int(now.fixed), max(int(now.weight), 1)
        # weight * level / weights > limit, without division.
        share = F.col("weight").cast("decimal(10,0)") * F.lit(level).cast("decimal(20,0)")
        above = limit * F.lit(weight).cast("decimal(10,0)") < share
    target = F.when(above, limit.cast("double")).otherwise(F.col("weight") * F.lit(level).cast("double") / F.lit(weight))
    whole = F.when(F.col("size") > 0, F.floor(target / F.col("size"))).otherwise(0).cast("long")
    return sources.withColumn("target", target).withColumn("whole", whole).withColumn(
        "rest", F.greatest(F.round("target").cast("long") - F.col("whole") * F.col("size"), F.lit(0).cast("long"))
    )


def mixing_cuts(documents: DataFrame, weights: DataFrame | None = None, epochs: int = EPOCHS) -> DataFrame:
    """Per source: size, target, whole, and the cut in the order of (h, id).

    Documents before the cut are taken once more than ``whole`` times; those at it yield
    ``part`` of their ``at`` words. ``documents`` is a stored table as of :func:`keyed`.
    """
    sizes = documents.groupBy("source").agg(F.sum("size").alias("size"))
    weights = cycled_weights(sizes) if weights is None else weights
    weights = weights.select(F.col("source").alias("own"), "weight")
    weighted = materialize(
        sizes.join(weights, F.col("source").eqNullSafe(F.col("own"))).select("source", "size", "weight"), "sources"
    )
    targets = filled(weighted, epochs)
    bucket = F.shiftright("h", 64 - BUCKET_BITS)
    sums = documents.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    # At most 2 ** BUCKET_BITS rows per source.
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    rests = targets.select(F.col("source").alias("own"), "rest")
    hit = running.join(rests, F.col("source").eqNullSafe(F.col("own"))).where(
        (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))
    ).select("own", F.col("bucket").alias("own_bucket"), "before", "rest")
    inside = documents.withColumn("bucket", bucket).join(
        hit, F.col("source").eqNullSafe(F.col("own")) & (F.col("bucket") == F.col("own_bucket"))
    ).groupBy("source", "before", "rest", "h", "id").agg(F.sum("size").alias("at"))
    ahead = Window.partitionBy("source").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    cut = inside.withColumn("ahead", F.col("before") + F.coalesce(F.sum("at").over(ahead), F.lit(0))).where(
        (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("at") >= F.col("rest"))
    ).select(F.col("source").alias("own"), F.struct("h", "id").alias("cut"), "at", (F.col("rest") - F.col("ahead")).alias("part"))
    joined = targets.join(cut, F.col("source").eqNullSafe(F.col("own")), "left")
    return materialize(
        joined.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "whole", "cut", "at", "part"),
        "cuts",
    )


def _with_cuts(rows: DataFrame, cuts: DataFrame, source: str, identity: list[str]) -> DataFrame:
    """Rows beside their source's cut, without moving a hot source to one task."""
    if cuts.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(cuts), F.col(source).eqNullSafe(F.col("of")))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*identity), F.lit(SALTS)))
    copies = cuts.withColumn("__of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(
        copies, F.col(source).eqNullSafe(F.col("of")) & (F.col("__salt") == F.col("__of_salt"))
    ).drop("__salt", "__of_salt")


def mixed_words(
    docs: DataFrame, weights: DataFrame | None = None, epochs: int = EPOCHS, seed: int = SEED, key: str = "doc_id",
    source: str = "source", text: str = "text",
) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every document.

    ``taken`` counts the words that the mix takes of it, repetitions included: whole epochs
    times its size, and of the documents up to the source's cut once more, the one at the
    cut in part. Null texts have size 0; a null source is a source of its own; rows that
    share an id at the cut share its words by size. Extra columns are ignored whatever
    their names; an empty table gives no rows.
    """
    documents = materialize(keyed(docs, key, source, text, seed), "mixing")
    cuts = mixing_cuts(documents, weights, epochs)
    place = F.struct("h", "id")
    more = F.when(F.col("cut").isNull() | (place > F.col("cut")), 0).when(place < F.col("cut"), F.col("size")).otherwise(
        F.floor(F.col("part") * F.col("size") / F.col("at"))
    )
    return _with_cuts(documents, cuts, "source", ["id"]).select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("id"), "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + more).cast("long").alias("taken"),
    )


def mixed(
    docs: DataFrame, weights: DataFrame | None = None, epochs: int = EPOCHS, seed: int = SEED, key: str = "doc_id",
    source: str = "source", text: str = "text",
) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns.

    Documents stay whole: the one at a source's cut is repeated once more if at least half
    of it would be taken.
    """
    documents = materialize(keyed(docs, key, source, text, seed), "mixing")
    cuts = mixing_cuts(documents, weights, epochs).select(
        F.struct(F.col("of")).alias("__of"), *[F.col(c).alias(f"__{c}") for c in ("whole", "cut", "at", "part")]
    ).withColumn("of", F.col("__of.of")).drop("__of")
    own = docs.columns
    renamed = docs.toDF(*[f"own_{i}" for i in range(len(own))])
    at = {name: f"own_{own.index(name)}" for name in (key, source)}
    identity = F.coalesce(F.col(at[key]).cast("long"), F.lit(_NO_ID))
    rows = renamed.withColumn("__place", F.struct(F.xxhash64(F.lit(seed), identity).alias("h"), identity.alias("id"))).withColumn(
        "__source", F.col(at[source]).cast("string")
    )
    joined = _with_cuts(rows, cuts, "__source", ["__place"])
    once_more = F.col("__cut").isNotNull() & (
        (F.col("__place") < F.col("__cut")) | ((F.col("__place") == F.col("__cut")) & (2 * F.col("__part") >= F.col("__at")))
    )
    copies = (F.col("__whole") + F.when(once_more, 1).otherwise(0)).cast("int")
    repeated = joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return repeated.select(*[F.col(f"own_{i}") for i in range(len(own))]).toDF(*own)
