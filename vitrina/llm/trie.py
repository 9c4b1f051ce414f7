"""Prefix trie of conversations by burst tries.

A turn becomes a number, a digest of its role and text; texts do not travel further. Equal
conversations become one sequence. A shard holds containers, and a container holds the
suffixes of all sequences below one trie head. A container of more turns than the limit
bursts by its next turn ids into containers below longer heads; the head then is a node of
the upper trie. What is left is sorted inside its container and swept into nodes.

Conversations lie in chunks of bounded size, also in the end: a sequence that is alone
below its head and too long for a container is a chain, and its chunks give its nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.session import materialize, shuffle_partitions

# Turns of a chunk, and of a container; both bound the memory of a task.
CHUNK_TURNS = 4096
CONTAINER_TURNS = 1 << 16
# Turns that the first round of bursts looks ahead, and the most that a later one does; each round doubles them.
AHEAD, MOST_AHEAD = 8, 256
# Conversation ids in so many consecutive numbers are joined in one task before their digest.
ID_BITS = 12
# Copies of a table that rows of a hot key are joined with.
SALTS = 32

ROOT = b"\0" * 16
NOTHING = hashlib.sha256(b"").hexdigest()

_TURNS = "array<struct<id: binary, chars: int>>"
_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long,"
    " ends_sha256 string"
)
# A container's own head also has the heads above it.
_SWEPT = f"{_NODE}, path array<binary>"


def chunks(conversations: DataFrame, size: int = CHUNK_TURNS) -> DataFrame:
    """(conv, first, turns): the turns of each conversation in order, in chunks; ``first`` turns come before.

    Turns are ordered by turn, null first; those with one turn number by the digest of role and
    text. Null role or text is empty; rows without conv_id belong to no conversation. Rows are
    sorted by ranges, so that one conversation may hold any share of them.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    numbered = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
        F.char_length(text).alias("chars"), F.monotonically_increasing_id().alias("at"),
    )
    order = ["conv", "turn", "id", "at"]
    ranged = numbered.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "turns")
    number = F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "id", "at")) - 1
    cut = ranged.withColumn("number", number).groupBy("conv", "part", F.floor(F.col("number") / size).alias("block"))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("number", "id", "chars"))), lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars")))
    before = Window.partitionBy("conv").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.size("turns")).over(before), F.lit(0))
    return cut.agg(turns.alias("turns")).select("conv", first.cast("long").alias("first"), "turns")


def rebuilt(pieces: DataFrame, heads: int = 6, group: int = 100) -> DataFrame:
    """Chunks of conversations that begin with turns of the first conversation of their group.

    Conversation c takes the first h turns of conversation c - c % ``group`` (all if fewer,
    none if absent) and its own turns after its first h, where h is ``crc32`` of the decimal
    id modulo ``heads``; remainders are SQL's, towards zero. Every conversation has a first chunk, which may be empty.
    """
    few = pieces.where(F.col("first") < heads - 1).select("conv", "first", F.slice("turns", 1, heads - 1).alias("turns"))
    starts = few.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("first", "turns"))).alias("parts"))
    starts = starts.select("base", F.flatten("parts.turns").alias("begin"))
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    convs = pieces.select("conv").distinct().withColumn("base", F.col("conv") - F.col("conv") % group).withColumn("h", taken)
    begun = convs.join(starts, "base", "left").select(
        "conv", "h", F.coalesce(F.slice("begin", F.lit(1), F.col("h")), F.lit([]).cast(_TURNS)).alias("begin")
    )
    skipped = F.greatest(F.col("h") - F.col("first"), F.lit(0)).cast("int")
    own = pieces.join(begun.select("conv", "h", F.size("begin").alias("got")), "conv").select(
        "conv", (F.greatest(F.col("first"), F.col("h").cast("long")) - F.col("h") + F.col("got")).alias("first"),
        F.slice("turns", skipped + 1, F.size("turns")).alias("turns"),
    )
    begun = begun.select("conv", F.lit(0).cast("long").alias("first"), F.col("begin").alias("turns"))
    return own.where(F.size("turns") > 0).unionByName(begun)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sequence from the pieces of its sorted list of conversations, hashed as they pass."""
    state = None
    for batch in batches:
        out: list[tuple] = []
        for a, b, turns, ids, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if state is None or state[0] != (a, b, turns):
                if state is not None:
                    out.append((state[1], state[2], state[0][2], state[3].hexdigest()))
                state = [(a, b, turns), int(ids.split(",", 1)[0]), n, hashlib.sha256(ids.encode())]
            else:
                state[2] += n
                state[3].update(f",{ids}".encode())
        yield _rows(out, _MEMBERS)
    if state is not None:
        yield _rows([(state[1], state[2], state[0][2], state[3].hexdigest())], _MEMBERS)


_MEMBERS = [("rep", pa.int64()), ("n_convs", pa.int64()), ("n_turns", pa.int64()), ("ends", pa.string())]
_NODES = [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
_NODES = [*_NODES, ("ends_sha256", pa.string()), ("path", pa.list_(pa.binary()))]


def _rows(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    values = zip(*rows, strict=True) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(v), t) for v, (_, t) in zip(values, columns, strict=True)], names=[n for n, _ in columns]
    )


def members(pieces: DataFrame) -> DataFrame:
    """(rep, n_convs, n_turns, ends): distinct sequences, their smallest conversation, and a digest of all of them.

    A sequence is known by its number of turns and 128 bits of its turns' digests by place.
    """

    def folded(seed: int) -> Column:
        placed = F.transform("turns", lambda t, i: F.xxhash64(F.lit(seed), t["id"], F.col("first") + i))
        return F.aggregate(placed, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))

    parts = pieces.select("conv", F.size("turns").cast("long").alias("n"), folded(1).alias("a"), folded(2).alias("b"))
    whole = parts.groupBy("conv").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("n").alias("n_turns"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    listed = whole.groupBy("a", "b", "n_turns", F.shiftright("conv", ID_BITS).alias("block")).agg(ids.alias("ids"), F.count("*").alias("n"))
    ordered = listed.repartition("a", "b", "n_turns").sortWithinPartitions("a", "b", "n_turns", "block")
    return ordered.select("a", "b", "n_turns", "ids", "n").mapInArrow(_ends, "rep long, n_convs long, n_turns long, ends string")


def _salted(rows: DataFrame, small: DataFrame, key: str, salt: str, how: str = "left") -> DataFrame:
    """Rows joined with a small table on a key that many of them share."""
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.hash(salt), F.lit(SALTS))).join(copies, [key, "__salt"], how).drop("__salt")


def _burst(open_: DataFrame, pieces: DataFrame, limit: int, look: int) -> tuple[DataFrame, DataFrame]:
    """(members with a state, heads that burst) of one round, which goes down by up to ``look`` turns."""
    skip = F.greatest(F.col("depth") - F.col("first"), F.lit(0)).cast("int")
    near = pieces.join(open_, "rep").where(
        (F.col("first") < F.col("depth") + look) & (F.col("first") + F.size("turns") > F.col("depth"))
    ).select("rep", F.struct("first", F.slice("turns", skip + 1, look).alias("turns")).alias("part"))
    near = near.groupBy("rep").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    ahead = F.slice(F.coalesce(F.flatten("parts.turns"), F.lit([]).cast(_TURNS)), 1, look)
    steps = open_.join(near, "rep", "left").withColumn("ahead", ahead).drop("parts")
    heads = F.aggregate(
        "ahead", F.array("head"), lambda h, t: F.concat(h, F.array(F.unhex(F.md5(F.concat(F.element_at(h, -1), t["id"])))))
    )
    steps = materialize(steps.withColumn("heads", heads), "burst-steps")
    each = steps.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ahead")))).where(F.size("ahead") > 0)
    each = each.select(
        "rep", "k", F.element_at("heads", F.col("k") + 1).alias("head"), (F.col("depth") + F.col("k")).alias("depth"),
        F.concat("path", F.slice("heads", F.lit(2), F.col("k") - 1)).alias("path"), "n_convs", "n_turns",
        F.element_at("ahead", F.col("k"))["chars"].alias("chars"),
    )
    sizes = each.groupBy("head").agg(
        F.sum(F.col("n_turns") - F.col("depth") + 1).alias("size"), F.count("*").alias("members"), F.min("rep").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.first("depth").alias("depth"), F.first("path").alias("path"), F.first("chars").alias("chars"),
    )
    over = materialize(sizes.where((F.col("size") > limit) & (F.col("members") > 1)).drop("size", "members"), "burst-heads")
    burst = _salted(each.select("rep", "k", "head"), over.select("head"), "head", "rep", "inner").groupBy("rep").agg(F.max("k").alias("m"))
    m, seen = F.coalesce(F.col("m"), F.lit(0)), F.size("ahead")
    # Below the last head that burst: a container, the end of the sequence, or the next round.
    state = F.when(m < seen, "container").when(F.col("depth") + m == F.col("n_turns"), "ended").otherwise("open")
    down = F.when(m < seen, m + 1).otherwise(m)
    placed = steps.join(burst, "rep", "left").select(
        "rep", "n_convs", "n_turns", "ends", state.alias("state"), F.element_at("heads", (down + 1).cast("int")).alias("head"),
        (F.col("depth") + down).alias("depth"), F.concat("path", F.slice("heads", F.lit(2), m)).alias("path"),
    )
    return materialize(placed, "burst-members"), over


def _common(a: list, b: list) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def swept(depth: int, path: list[bytes], sequences: list[tuple]) -> list[tuple]:
    """Node rows of a container, whose head lies at ``depth``.

    ``sequences`` are (ids, chars, rep, n_convs, ends); from depth 1 on, ids and chars begin
    with the head's own turn.
    """
    own = 1 if depth else 0
    sequences.sort(key=lambda s: s[0])
    parent, chars, level = [-1], [sequences[0][1][0] if own else 0], [depth]
    conv, convs, ends = [sequences[0][2]], [0], [NOTHING]
    stack, last = [0], sequences[0][0][:own]
    for ids, sizes, rep, n, end in sequences:
        common = _common(last, ids)
        del stack[common - own + 1:]
        for at in range(common, len(ids)):
            stack.append(len(parent))
            parent.append(stack[-2])
            chars.append(sizes[at])
            level.append(level[stack[-2]] + 1)
            conv.append(rep)
            convs.append(0)
            ends.append(NOTHING)
        top = stack[-1]
        conv[top], convs[top], ends[top], last = min(conv[top], rep), convs[top] + n, end, ids
    children, leaves, saved = [0] * len(parent), [0] * len(parent), [0] * len(parent)
    # A node comes after its parent.
    for i in range(len(parent) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (convs[i] - 1) * chars[i]
        if (p := parent[i]) >= 0:
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
            convs[p] += convs[i]
            conv[p] = min(conv[p], conv[i])
    return [
        (conv[i], level[i], conv[parent[i]] if i else None, convs[i], children[i], leaves[i], saved[i], ends[i], None if i else path)
        for i in range(len(parent))
    ]


def _swept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers one after the other, as sorted rows pass; of a container only its own sequences are held."""
    head = depth = path = None
    sequences: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for now, d, p, rep, n, end, ids, chars in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if now != head:
                if sequences:
                    out += swept(depth, path, sequences)
                head, depth, path, sequences = now, d, p, []
            if sequences and sequences[-1][2] == rep:
                sequences[-1][0].extend(ids)
                sequences[-1][1].extend(chars)
            else:
                sequences.append((ids, chars, rep, n, end))
        yield _rows(out, _NODES)
    if sequences:
        yield _rows(swept(depth, path, sequences), _NODES)


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of chunks of sequences that are alone below their heads."""
    for batch in batches:
        for depth, path, rep, n, turns, end, first, chars, after in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
            out, rest = [], after
            for at in range(len(chars) - 1, max(depth - 1 - first, 0) - 1, -1):
                rest += chars[at]
                level = first + at + 1
                top, leaf = level == depth, level == turns
                out.append((rep, level, None if top else rep, n, 0 if leaf else 1, 1, (n - 1) * rest, end if leaf else NOTHING, path if top else None))
            yield _rows(out, _NODES)


def trie(pieces: DataFrame, limit: int = CONTAINER_TURNS) -> DataFrame:
    """One row per node of the prefix trie of all conversations given as chunks.

    conv_id: smallest conversation through the node; depth: 0 for the root; parent_conv_id:
    the parent's conv_id, null for the root; n_convs: conversations through it; n_children;
    n_leaves: childless nodes in its subtree; saved_tokens: over its subtree, each node's
    conversations but one times the characters of its turn; ends_sha256: SHA-256 of the ids
    of the conversations that end at it, ascending, joined by commas. Equal conversations are
    one sequence; one without turns ends at the root; without conversations there is no node.
    A head may be shared by any part of all conversations: sums are taken before the shuffle,
    and look-ups by head are salted.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "chunks")
    known = materialize(members(pieces), "members")
    pieces = materialize(
        pieces.join(known.select(F.col("rep").alias("conv")), "conv", "left_semi").withColumnRenamed("conv", "rep"), "sequences"
    )
    at_root = known.select(
        "rep", "n_convs", "n_turns", "ends", F.lit("open").alias("state"), F.lit(ROOT).alias("head"),
        F.lit(0).cast("long").alias("depth"), F.lit([]).cast("array<binary>").alias("path"),
    )
    whole = known.agg(F.sum(F.col("n_turns") + 1), F.count("*"), F.min("rep"), F.sum("n_convs")).first()
    if not whole[1]:
        return spark.createDataFrame([], _NODE)
    if whole[0] <= limit:
        placed, upper = [at_root.withColumn("state", F.lit("container"))], []
    else:
        root = spark.range(1).select(
            F.lit(ROOT).alias("head"), F.lit(whole[2]).cast("long").alias("conv_id"), F.lit(whole[3]).cast("long").alias("n_convs"),
            F.lit(0).cast("long").alias("depth"), F.lit([]).cast("array<binary>").alias("path"), F.lit(0).alias("chars"),
        )
        placed, upper, open_, look = [], [root], at_root.withColumn("path", F.array("head")), AHEAD
        while True:
            now, heads = _burst(open_, pieces, limit, look)
            placed.append(now.where(F.col("state") != "open"))
            upper.append(heads)
            open_ = now.where(F.col("state") == "open")
            if open_.isEmpty():
                break
            look = min(2 * look, MOST_AHEAD)
    placed = reduce(DataFrame.unionByName, placed)
    held = placed.where(F.col("state") == "container").withColumn("alone", F.col("n_turns") - F.col("depth") + 1 > limit)
    # From the head's own turn on, which all members share.
    chunked = pieces.join(held, "rep").where(F.col("first") + F.size("turns") >= F.col("depth"))
    skip = F.greatest(F.col("depth") - 1 - F.col("first"), F.lit(0)).cast("int")
    rows = chunked.where(~F.col("alone")).withColumn("turns", F.slice("turns", skip + 1, F.size("turns"))).select(
        "head", "depth", "path", "rep", "n_convs", "ends", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"), "first"
    )
    rows = rows.repartition("head").sortWithinPartitions("head", "rep", "first").drop("first")
    after = Window.partitionBy("rep").orderBy(F.desc("first")).rowsBetween(Window.unboundedPreceding, -1)
    total = F.aggregate("turns.chars", F.lit(0).cast("long"), lambda a, b: a + b)
    chains = chunked.where("alone")
    later = chains.select("rep", "first", total.alias("total")).withColumn("after", F.coalesce(F.sum("total").over(after), F.lit(0)))
    chains = chains.join(later.drop("total"), ["rep", "first"]).select(
        "depth", "path", "rep", "n_convs", "n_turns", "ends", "first", F.col("turns.chars").alias("chars"), "after"
    )
    nodes = rows.mapInArrow(_swept_rows, _SWEPT).unionByName(chains.mapInArrow(_chain_rows, _SWEPT))
    columns = [part.split()[0] for part in _NODE.split(", ")]
    if not upper:
        return nodes.select(*columns)
    nodes = materialize(nodes, "nodes")
    tops = nodes.where(F.col("path").isNotNull())
    upper = materialize(reduce(DataFrame.unionByName, upper), "upper")
    below = tops.select("path", "n_leaves", "saved_tokens").unionByName(upper.select(
        F.concat("path", F.array("head")).alias("path"), F.lit(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    ))
    sums = below.select(F.explode("path").alias("head"), "n_leaves", "saved_tokens").groupBy("head").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    parent = F.try_element_at("path", F.lit(-1))
    children = tops.select(parent.alias("head")).unionByName(upper.select(parent.alias("head"))).where("head IS NOT NULL")
    children = children.groupBy("head").agg(F.count("*").alias("n_children"))
    ended = placed.where(F.col("state") == "ended").select("head", F.col("ends").alias("ends_sha256"))
    upper_nodes = upper.join(sums, "head").join(children, "head").join(ended, "head", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))
    )
    headed = tops.select(*[c for c in columns if c != "parent_conv_id"], parent.alias("head")).unionByName(
        upper_nodes.select(*[c for c in columns if c != "parent_conv_id"], parent.alias("head"))
    )
    parents = upper.select("head", F.col("conv_id").alias("parent_conv_id"))
    return nodes.where(F.col("path").isNull()).select(*columns).unionByName(
        _salted(headed, parents, "head", "conv_id").select(*columns)
    )
