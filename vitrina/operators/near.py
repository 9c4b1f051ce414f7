"""Near duplicates by an exact set-similarity join with a prefix filter.

A text's set are its runs of five normalised words. Two sets of n and m members with a
Jaccard similarity of t or more have sizes that differ by at most the factor t, and share a
member among the n - ceil(tn) + 1 and m - ceil(tm) + 1 members that come first in any one
order of all members. The order here ends with the members that are common in a sample of the
sets, so that few sets meet; only these first members are shuffled. Any sample gives all links.

Sets that meet under a member are first compared with two members' hubs. Only sets that are
not connected by then are compared with each other. No link is lost: what a filter leaves
out cannot reach t, and what the hubs have connected needs no further link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, md5
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.functions.text import half_normalized, normalized_rest
from vitrina.operators.graph import components, looked_up
from vitrina.session import materialize, spread

WORDS = 5
SIMILARITY = 0.75
# Hubs that the sets under a member are compared with before each other.
HUBS = 2
# A hub that holds one comparison in so many gets copies, one for each part of its comparisons.
HOT_HUBS = 1 << 10
COPIES = 32
# Sets whose members are counted for the order, up to one in so many, and common members that travel with the tasks.
COUNTED_SETS = 1 << 14
COUNTED_SHARE = 1 << 6
COMMON = 1 << 17
# Sets, and bytes of their text, that a task puts in order at once.
ORDERED_ROWS = 1 << 10
ORDERED_BYTES = 1 << 22


# An odd multiplier of the hash of a run, and what marks lists that are shorter than a run.
MULTIPLIER = 0x9E3779B97F4A7C15
SHORT = 0xD1B54A32D192ED03
# Nodes that pairs name, if their texts are to be picked where they lie.
PICKED = 1 << 18


def _summed(word: np.ndarray, weights: np.ndarray, at: np.ndarray, short: np.ndarray, behind: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Weighted sums of the words from each place ``at`` on."""
    n = len(word) - len(weights)
    value = sum(word[j:n + j] * w for j, w in enumerate(weights))[at] if n else np.zeros(0, np.uint64)
    if len(short):
        value[short] = np.where(behind, np.uint64(0), word[at[short, None] + np.arange(len(weights))] * weights).sum(axis=1) + length
    return value


def _mixed(value: np.ndarray) -> np.ndarray:
    value ^= value >> np.uint64(32)
    value *= np.uint64(MULTIPLIER)
    value ^= value >> np.uint64(29)
    return value.view(np.int64)


@dataclass
class _Sets:
    """Sets of a batch: members as two hashes, those of a row in ascending order, and the number of each row's members."""

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(texts: pa.Array, words: int) -> "_Sets":
        """Distinct runs of ``words`` words of each text; the whole text if it is shorter, nothing of one without a word."""
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = split.flatten().dictionary_encode()
        # A word becomes 128 bits, two independent hashes of 64.
        names = coded.dictionary.to_pylist()
        hashed = np.frombuffer(b"".join(blake2b(w.encode(), digest_size=16).digest() for w in names), np.uint64).reshape(-1, 2)
        code = coded.indices.to_numpy()
        held = np.array([w != "" for w in names], bool)[code] if len(code) else np.zeros(0, bool)
        row = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy())[held]
        code, counts = code[held], np.bincount(row, minlength=len(texts))
        runs = np.where(counts < words, np.minimum(counts, 1), counts - words + 1)
        of = np.repeat(np.arange(len(texts)), runs)
        begin, end = np.cumsum(counts) - counts, np.cumsum(counts)
        at = begin[of] + np.arange(len(of)) - (np.cumsum(runs) - runs)[of]
        weights = np.array([pow(MULTIPLIER, j + 1, 1 << 64) for j in range(words)], np.uint64)
        short = np.nonzero(counts[of] < words)[0]
        # Of a short text the words behind its end do not count, but its length does.
        behind = at[short, None] + np.arange(words) >= end[of[short], None]
        length = np.uint64(SHORT) * (counts[of[short]] + 1).astype(np.uint64)
        first, second = (
            _mixed(_summed(np.concatenate([hashed[:, i][code], np.zeros(words, np.uint64)]), weights, at, short, behind, length)) for i in (0, 1)
        )
        order = np.argsort(first)
        order = order[np.argsort(of[order], kind="stable")]
        first, second, of = first[order], second[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        return _Sets(first[new], second[new], np.bincount(of[new], minlength=len(texts)))

    @property
    def ends(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])


def _pieces(batches: Iterator[pa.RecordBatch], *texts: str) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``ORDERED_ROWS`` rows and, but for single rows, ``ORDERED_BYTES`` of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(t)), 0).to_numpy(zero_copy_only=False) for t in texts)
        total, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            end = int(np.searchsorted(total, (total[start - 1] if start else 0) + ORDERED_BYTES, "right"))
            end = min(max(end, start + 1), start + ORDERED_ROWS)
            yield batch.slice(start, end - start)
            start = end


def _noded(rows: DataFrame, words: int) -> DataFrame:
    """(id, n, node, words) of (id, text): the words, their runs' number, and what is the same for equal sets; null without a word."""
    rows = rows.select("id", *half_normalized("text"))

    def node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, "half"):
            text = normalized_rest(part.column("half"), part.column("plain"))
            sets = _Sets.of(text, words)
            ends = sets.ends
            digests = [
                md5(sets.first[i:j].tobytes() + sets.second[i:j].tobytes()).hexdigest() if i < j else None for i, j in pairwise(ends.tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(sets.sizes, pa.int64()), pa.array(digests, pa.string()), text],
                ["id", "n", "node", "words"],
            )

    schema = T.StructType([
        rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("node", T.StringType()), T.StructField("words", T.StringType()),
    ])
    return rows.mapInArrow(node, schema)


def _prefixes(sets: DataFrame, similarity: float, words: int) -> DataFrame:
    """(token, node, n): the members among a set's first ones, commonest last, that another set has among its own.

    A set is put in order in its row; nothing but its first members leaves it.
    """
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, "words"):
            yield pa.RecordBatch.from_arrays([pa.array(_Sets.of(part.column("words"), words).first)], ["token"])

    share = min(max(sets.count() // COUNTED_SETS, 1), COUNTED_SHARE)
    counted = sets.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).select("words").mapInArrow(members, "token long")
    # At most ``COMMON`` numbers come to the driver.
    common = counted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    known = np.argsort(common.column("token").to_numpy())
    names, weights = common.column("token").to_numpy()[known], common.column("n").to_numpy()[known]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, "words"):
            held = _Sets.of(part.column("words"), words)
            token, sizes = held.first, held.sizes
            row = np.repeat(np.arange(part.num_rows), sizes)
            weight = np.zeros(len(token), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, token), len(names) - 1)
                weight = np.where(names[at] == token, weights[at], 0)
            # Members of a row ascend by now.
            order = np.argsort(row * (weight.max(initial=0) + 1) + weight, kind="stable")
            begin = np.cumsum(sizes) - sizes
            most = sizes - np.ceil(sizes * similarity - 1e-9).astype(np.int64) + 1
            kept = np.arange(len(token)) - begin[row] < most[row]
            taken = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[order][kept]), part.column("node").take(taken), part.column("n").take(taken)], ["token", "node", "n"]
            )

    found = materialize(
        spread(sets.select("node", "n", "words")).mapInArrow(first, "token long, node long, n long").withColumnRenamed("n", "size"), "first-members"
    )
    shared = found.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    return looked_up(found, shared, "token", found.count()).select("token", "node", F.col("size").alias("n"))


def _fits(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * (similarity - 1e-9)


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar; texts travel, sets are made of them again. Any share of the pairs may have one b."""
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    total = pairs.count()
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    if named.count() <= PICKED:
        # Few texts are needed: the others are not shuffled.
        sets = sets.join(F.broadcast(named), "node", "left_semi")
    hot = F.broadcast(pairs.groupBy("b").count().where(F.col("count") * HOT_HUBS >= total).select("b", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("a"), F.lit(COPIES))).otherwise(0)
    salted = pairs.join(hot, "b", "left").select("a", "b", salt.cast("int").alias("salt"))
    right = sets.select(F.col("node").alias("b"), F.col("words").alias("other")).join(hot, "b", "left")
    last = F.when(F.col("hot"), COPIES - 1).otherwise(0)
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("hot")
    left = sets.select(F.col("node").alias("a"), "words")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, "words", "other"):
            a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
            # The set of a text is made once in a slice, however many pairs it has.
            names, where, place = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
            texts = pa.concat_arrays([part.column("words"), part.column("other")]).take(pa.array(where))
            held = _Sets.of(texts, words)
            ends, kept = held.ends, np.zeros(len(a), bool)
            pairs = np.stack([held.first, held.second], axis=1).view([("first", np.int64), ("second", np.int64)]).ravel()
            for i, (x, y) in enumerate(zip(place[:len(a)], place[len(a):], strict=True)):
                one, other = pairs[ends[x]:ends[x + 1]], pairs[ends[y]:ends[y + 1]]
                at = np.minimum(np.searchsorted(one["first"], other["first"]), len(one) - 1)
                common = int((one[at] == other).sum())
                kept[i] = common >= (len(one) + len(other) - common) * (similarity - 1e-9)
            yield part.select(["a", "b"]).filter(pa.array(kept))

    both = salted.join(right, ["b", "salt"]).join(left, "a").select("a", "b", "words", "other")
    return both.mapInArrow(similar, "a long, b long")


def similar_groups(
    df: DataFrame, text: str, key: str = "id", similarity: float = SIMILARITY, words: int = WORDS
) -> DataFrame:
    """(id, n_shingles, group_id): the smallest id that a row reaches over texts of Jaccard ``similarity`` or more.

    Null texts and texts without a word have no set and stay alone. Rows with equal sets are
    one node, however many they are; null ids take part and are the smallest only among
    themselves. ``similarity`` lies above 0 and up to 1.
    """
    if not 0 < similarity <= 1 or math.isnan(similarity):
        raise ValueError("similarity must lie above 0 and up to 1")
    # The words, a fifth of their runs.
    rows = materialize(_noded(spread(df.select(F.col(key).alias("id"), F.col(text).alias("text"))), words), "sets")
    # A number stands for a set from here on: it is given once, when the sets are written.
    sets = rows.where(F.col("n") > 0).dropDuplicates(["node"]).select(F.col("node").alias("digest"), "n", "words")
    sets = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")
    rows = rows.select("id", "n", F.col("node").alias("digest")).join(sets.select("digest", "node"), "digest", "left").select("id", "n", "node")
    rows = materialize(rows, "numbered")
    met = materialize(_prefixes(sets, similarity, words), "prefixes")
    total = met.count()
    pairs = None
    for turn in range(HUBS):
        rank = F.xxhash64("node", F.lit(turn))
        hubs = met.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct(rank.alias("r"), "node", "n")).alias("hub"))
        found = looked_up(met.withColumnRenamed("n", "size"), hubs, "token", total).where(
            (F.col("node") != F.col("hub.node")) & _fits("size", "hub.n", similarity)
        ).select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
    links = _linked(pairs, sets, similarity, words)
    links = materialize(links, "hub-links")
    reached = components(links)
    placed = met.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Members under which several components meet.
    apart = placed.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    apart = apart.where("low <> high").select("token", "n")
    open_ = materialize(looked_up(placed.withColumnRenamed("n", "size"), apart, "token", total), "apart")
    a, b = (open_.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "size", "component")]) for s in "ab")
    pairs = a.join(b, "token").where(
        (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & _fits("size_a", "size_b", similarity)
    ).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    reached = components(links.unionByName(_linked(pairs, sets, similarity, words)))
    grouped = rows.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.where(F.col("component").isNotNull()).groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    known = looked_up(grouped.where(F.col("component").isNotNull()).select("id", F.col("n").alias("size"), "component"), least, "component", rows.count())
    alone = grouped.where(F.col("component").isNull()).select("id", F.lit(0).cast("long").alias("size"), F.col("id").alias("least"))
    return known.select("id", "size", "least").unionByName(alone).select(
        "id", F.col("size").alias("n_shingles"), F.col("least").alias("group_id")
    )
