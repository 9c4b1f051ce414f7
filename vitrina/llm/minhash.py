"""Near duplicates by min-max hashing, with links confirmed on full shingle sets.

Each permutation gives two signature values, the least and the greatest hash of a set, so
64 hash evaluations give 128 values in 32 bands of four, two permutations each. The chance
that two sets at the threshold of 0.75 share no band depends on their size, as the least and
the greatest hash of a small set are not independent: with c common of u members both agree
with probability c(c-1)/(u(u-1)), and a link is lost with (1 - that squared) to the power of
32. That is 1.0e-4 for 3 of 4 members, 2.0e-5 for 6 of 8, and nears 5e-6 for large sets.

Equal sets are one node, so copies cost nothing further. Inside a bucket no pairs are
written out: its members are compared with one hub, buckets whose members are connected
by then are done, and the next hub is asked. What is still apart is compared block by block
inside tasks, and only pairs whose folded sets reach the threshold leave them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.llm.common import free_name, words_of
from vitrina.llm.components import components
from vitrina.session import materialize

SHINGLE = 5
THRESHOLD = 75  # percent
BANDS = 32
PERMUTATIONS_PER_BAND = 2
VALUES = 2 * BANDS * PERMUTATIONS_PER_BAND
# Members of a bucket in a block; two blocks meet at once inside a task, so many shared shingles at a time.
TILE = 128
TILE_COLUMNS = 4096
# Characters that a task turns into shingles at once; one longer text is a step of its own.
STEP_CHARS = 1 << 21
# Ids up to which a list of documents is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, and where each text's end.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    words, ends = words_of(texts)
    coded = words.dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    w = own[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    full = max(len(w) - size + 1, 0)
    rolled = np.zeros(full, np.uint64)
    for i in range(size):
        rolled = rolled * _MULTIPLIER + w[i:i + full]
    rolled = _mixed(rolled)
    sets = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(rolled[a:b - size + 1]))
        elif b > a:
            sets.append(np.array([xxhash.xxh3_64_intdigest(w[a:b].tobytes(), seed=1)], np.uint64))
        else:
            sets.append(rolled[:0])
    return np.concatenate([rolled[:0], *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _nodes(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per set: the sum of its mixed shingles."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(sets ^ _MULTIPLIER), dtype=np.uint64)])
    return (total[ends[1:]] - total[ends[:-1]]).view(np.int64)


def _steps(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chars = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = int(chars[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(chars, done + STEP_CHARS)))
            yield batch.slice(start, stop - start)
            start = stop


def min_max_signatures(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Upper halves of the least and greatest hash of each non-empty set, one row per set."""
    seeds = np.random.default_rng(20_240_607).integers(1, 1 << 63, (VALUES // 2, 2), np.int64).astype(np.uint64)
    out = np.zeros((len(ends) - 1, VALUES), np.uint32)
    filled = np.nonzero(np.diff(ends))[0]
    if len(filled):
        starts = ends[:-1][filled]
        for i, (flip, factor) in enumerate(seeds):
            hashed = (sets ^ flip) * (factor | np.uint64(1))
            out[filled, 2 * i] = np.minimum.reduceat(hashed, starts) >> np.uint64(32)
            out[filled, 2 * i + 1] = np.maximum.reduceat(hashed, starts) >> np.uint64(32)
    return out.view(np.int32)


def signatures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, node, n, signature): node identifies the set (a 64-bit sum over it), n counts it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _steps(batches, "text"):
            sets, ends = shingle_sets(step.column("text"))
            node = _nodes(sets, ends)
            flat = min_max_signatures(sets, ends).reshape(-1)
            offsets = pa.array(np.arange(len(node) + 1) * VALUES, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [step.column("id"), pa.array(node), pa.array(np.diff(ends)), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                ["id", "node", "n", "signature"],
            )

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        run, "id long, node long, n long, signature array<int>"
    )


def _band_keys(signature: Column) -> Column:
    width = VALUES // BANDS
    return F.array(*[
        F.xxhash64(F.lit(i), *[F.get(signature, F.lit(i * width + j)) for j in range(width)]) for i in range(BANDS)
    ])


def _sets_of(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(node, shingles) of the wanted nodes, one row each; ``wanted`` has id and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _steps(batches, "text"):
            sets, ends = shingle_sets(step.column("text"))
            node = _nodes(sets, ends)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node), lists], ["node", "shingles"])

    ids = wanted.select(F.coalesce("id", F.lit(_NO_ID)).alias("key")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("key"), F.col(text_column).cast("string").alias("text")
    ).join(ids, "key", "left_semi").select("text")
    found = texts.mapInArrow(run, "node long, shingles array<long>")
    # An id that several documents carry brings other sets along.
    return found.join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, la, lb) whose full sets reach the threshold."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(other, "b").where(
        100 * common >= THRESHOLD * (F.size("sa") + F.size("sb") - common)
    ).select("la", "lb")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the components that the links join have become one.

    A label is the least (id, node) of its component: nodes that share an id stay apart.
    """
    joined = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    return materialize(
        labels.join(joined, labels["label"] == joined["id"], "left").select(
            "node", "n", F.coalesce("component", "label").alias("label")
        ), "labels",
    )


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, n, label) of the buckets whose members are not all connected yet."""
    labelled = members.join(labels, "node")
    own = F.col("label.node")
    open_keys = labelled.groupBy("key").agg(F.min(own).alias("x"), F.max(own).alias("y")).where("x < y").select("key")
    return labelled.join(open_keys, "key")


def _possible(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * F.least(n, m) >= THRESHOLD * F.greatest(n, m)


def _hub_pairs(apart: DataFrame, order: list[Column]) -> DataFrame:
    """Every member with the hub of its buckets that it shares most bands with.

    The hub is the bucket's first member in the given order, found by a partial aggregate.
    """
    me = F.struct("node", "n", "label")
    hubs = apart.groupBy("key").agg(F.min_by(me, F.struct(*order, "node")).alias("hub"))
    met = apart.join(hubs, "key").where(
        (F.col("label.node") != F.col("hub.label.node")) & _possible(F.col("n"), F.col("hub.n"))
    ).groupBy("node", "label", "hub").agg(F.count("*").alias("bands"))
    best = met.groupBy("node", "label").agg(F.max_by("hub", F.struct("bands", "hub.node")).alias("hub"))
    return best.select(
        F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("label").alias("la"), F.col("hub.label").alias("lb")
    )


def _alone(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, alone): how many of its shingles no other document of these buckets has."""
    nodes = apart.select("node").distinct()
    owned = sets.join(nodes, "node").select("node", F.explode("shingles").alias("s"))
    single = owned.groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    counted = single.groupBy("node").agg(F.count("*").alias("alone"))
    return nodes.join(counted, "node", "left").select("node", F.coalesce("alone", F.lit(0)).alias("alone"))


def _tile_pairs(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, la, lb) of open buckets whose sets reach the threshold by 32-bit shingles.

    Only members outside of a bucket's largest component are looked at: blocks of them meet
    blocks of all members as matrices in some task. Folded to 32 bits, common shingles are
    never counted too few, so no link is lost and hardly any pair has to be refuted later.
    """
    shares = apart.groupBy("key", "label").agg(F.count("*").alias("c"))
    sized = shares.groupBy("key").agg(
        F.max_by("label", F.struct("c", "label")).alias("main"),
        F.ceil((F.sum("c") - F.max("c")) / TILE).alias("few"), F.ceil(F.sum("c") / TILE).alias("all"),
    )
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    placed = apart.join(sized, "key").withColumn("own", F.xxhash64("node"))
    columns = ["key", "i", "j", "side", "node", "n", "label"]
    left = placed.where(F.col("label.node") != F.col("main.node")).withColumn("i", F.pmod("own", "few")).withColumn(
        "j", F.explode(numbers(F.col("all")))
    ).withColumn("side", F.lit(0))
    right = placed.withColumn("j", F.pmod("own", "all")).withColumn("i", F.explode(numbers(F.col("few")))).withColumn("side", F.lit(1))
    folded = sets.select("node", F.transform("shingles", lambda s: s.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("folded"))
    tiled = left.select(*columns).unionByName(right.select(*columns)).join(folded, "node")

    def pairs_in(group: pa.Table) -> pa.RecordBatch:
        side, node, n = (group.column(c).to_numpy() for c in ("side", "node", "n"))
        labels = group.column("label").combine_chunks()
        label = labels.field("node").to_numpy()
        lists = group.column("folded").combine_chunks()
        row = np.repeat(np.arange(len(side)), lists.value_lengths().to_numpy())
        _, value = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        place = np.empty(len(side), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        on_left = side[row] == 0
        size = int(value.max(initial=-1)) + 1
        both = (np.bincount(value[on_left], minlength=size) > 0) & (np.bincount(value[~on_left], minlength=size) > 0)
        column = np.cumsum(both) - 1
        common = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, int(both.sum()), TILE_COLUMNS):
            here = both[value] & (column[value] >= start) & (column[value] < start + TILE_COLUMNS)
            parts = []
            for mask, rows in ((here & on_left, len(left)), (here & ~on_left, len(right))):
                part = np.zeros((rows, TILE_COLUMNS), np.float32)
                np.add.at(part, (place[row[mask]], column[value[mask]] - start), 1)
                parts.append(part)
            common += parts[0] @ parts[1].T
        union = n[left][:, None] + n[right][None, :] - common
        x, y = np.nonzero((100 * common >= THRESHOLD * union) & (label[left][:, None] != label[right][None, :]))
        a, b = left[x], right[y]
        return pa.RecordBatch.from_arrays(
            [pa.array(node[a]), pa.array(node[b]), labels.take(pa.array(a)), labels.take(pa.array(b))], ["a", "b", "la", "lb"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile; a tile may continue in the next batch."""
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*rest, batch])
            marks = [whole.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.nonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0))[0] + 1
            cuts = [0, *new.tolist()]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                yield pairs_in(whole.slice(start, stop - start))
            rest = whole.slice(cuts[-1]).combine_chunks().to_batches()
        if rest:
            yield pairs_in(pa.Table.from_batches(rest))

    found = tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        run, "a long, b long, la struct<id: long, node: long>, lb struct<id: long, node: long>"
    )
    # Two sets may meet in several buckets, and twice in one.
    smaller = F.col("a") < F.col("b")
    return found.select(*[
        F.when(smaller, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("la", "lb"), ("lb", "la"))
    ]).distinct()


def _labelled(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, node, n, label) for every row; label is the least (id, node) of its component, null without words."""
    signed = materialize(signatures(docs, id_column, text_column), "signatures")
    reps = materialize(
        signed.where("n > 0").groupBy("node").agg(
            F.coalesce(F.min("id"), F.lit(_NO_ID)).alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature")
        ), "representatives",
    )
    banded = reps.select("node", F.explode(_band_keys(F.col("signature"))).alias("key"))
    several = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = materialize(banded.join(several, "key").select("key", "node"), "buckets")
    wanted = materialize(reps.select("node", "id", "n").join(members.select("node").distinct(), "node"), "candidates")
    sets = materialize(_sets_of(docs, wanted, id_column, text_column), "sets")
    labels = wanted.select("node", "n", F.struct("id", "node").alias("label"))

    for order in ([F.xxhash64("node", F.lit(1))], [F.xxhash64("node", F.lit(2))]):
        pairs = _hub_pairs(_apart(members, labels), order)
        labels = _relabelled(labels, _confirmed(pairs, sets))
    apart = _apart(members, labels)
    alone = materialize(_alone(apart, sets), "alone")
    # The member with the fewest shingles of its own is the most central one.
    pairs = _hub_pairs(apart.join(alone, "node"), [F.col("alone")])
    labels = _relabelled(labels, _confirmed(pairs, sets))
    pairs = materialize(_tile_pairs(_apart(members, labels), sets), "pairs")
    labels = _relabelled(labels, _confirmed(pairs, sets))

    final = reps.select("node", F.struct("id", "node").alias("own")).join(labels.select("node", "label"), "node", "left").select(
        "node", F.coalesce("label", "own").alias("label")
    )
    return signed.select("id", "node", "n").join(final, "node", "left")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Documents are linked when 100 * intersection >= 75 * union of their sets of five-word
    shingles; component_id is the least id that can be reached. Null, empty and wordless
    texts have no shingles and are linked with nothing: their component is their own id.
    Rows with equal texts are one node; a null id counts as larger than all others and
    comes back as null if nothing else is in its component. Rows that only share an id, or
    have none, are not linked by that. Other columns are ignored whatever their names. An
    empty table gives no rows.
    """
    least = F.col("label.id")
    return _labelled(docs, id_column, text_column).select(
        "id", F.col("n").alias("n_shingles"),
        F.when((F.col("n") == 0) | (least == _NO_ID), F.col("id")).otherwise(least).alias("component_id"),
    )


def _node(text: Column) -> Column:
    """The node of each text."""

    @F.arrow_udf(T.LongType())
    def node(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            steps = _steps([pa.RecordBatch.from_arrays([batch], ["text"])], "text")
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *[_nodes(*shingle_sets(s.column("text"))) for s in steps]]))

    return node.asNondeterministic()(text.cast("string"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without near duplicates, with their own columns: of each component the least id.

    Rows without an id go by a hash of the whole row instead. Different texts that share an
    id are documents of their own; of one component's rows with the least id those with the
    least node (the 64-bit sum over the set) count, and of those any one is kept. Texts
    without words are all kept, but for repeated ids among them. Columns may have any names;
    an empty table stays empty.
    """
    key, node = free_name(docs, "__key"), free_name(docs, "__node")
    keyed = docs.withColumn(key, F.coalesce(F.col(id_column).cast("long"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    stays = (F.col("n") == 0) | ((F.col("id") == F.col("label.id")) & (F.col("node") == F.col("label.node")))
    found = materialize(_labelled(keyed, key, text_column).select("id", "node", stays.alias("stays")), "near-duplicates")
    fates = found.groupBy("id").agg(F.count("*").alias("n"), F.max("stays").alias("stays"))
    goes = materialize(fates.where("not stays").select("id"), "removed")
    repeated = materialize(fates.where("stays and n > 1").select("id"), "repeated")
    few = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    without = lambda rows, ids, how: rows.join(few(ids), rows[key] == ids["id"], how)
    kept = without(keyed, goes, "left_anti")
    if repeated.isEmpty():
        return kept.drop(key)
    single = without(kept, repeated, "left_anti")
    # An id alone does not tell which of its rows stay: their texts do.
    chosen = materialize(found.where("stays").join(few(repeated), "id", "left_semi").select("id", "node").distinct(), "chosen")
    several = without(kept, repeated, "left_semi").withColumn(node, _node(F.col(text_column)))
    several = several.join(few(chosen), (several[key] == chosen["id"]) & (several[node] == chosen["node"]), "left_semi")
    return single.unionByName(several.dropDuplicates([key, node]).drop(node)).drop(key)
