import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vitrina.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_nodes(rows):
    conversations = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            conversations.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [turn[3] for turn in sorted(turns)] for c, turns in conversations.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - math.fmod(c, 100), [])[:h] + turns[h:])
    members, children = {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved, found = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) or 1
        saved[path] = sum(saved[p] for p in below) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        ends = ",".join(str(c) for c in sorted(members[path]) if whole[c] == path)
        found.append((
            min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(below),
            leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(found, key=str)


def invented(conversations, width, depth, alike, long):
    rng = random.Random(depth)
    rows = []
    for c in range(conversations):
        turns = [rng.randint(0, width) for _ in range(rng.randint(1, depth))]
        if rng.random() < alike:
            turns = [1] * min(len(turns), 3)
        rows += [(c, i, "user" if i % 2 == 0 else None if x == 0 else "assistant", f"t{x}" * (x + 1) if x else None) for i, x in enumerate(turns)]
    # Two long ones that part late, one of a null turn, repeated rows, a turnless rebuild, rows of no conversation.
    rows += [(5000 + c, i, "user", f"long{i % 3}") for c in (0, 1) for i in range(long + 20 * c)]
    rows += [(None, 0, "user", "x"), (7000, None, "a", "b"), (7000, None, "a", "a"), (7000, None, "a", "a"), (7001, 1, None, None), (-5, 1, "", "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shape, limit, chunk", [((150, 2, 9, 0.3, 40), 1 << 16, 4096), ((150, 2, 9, 0.3, 40), 40, 4), ((80, 1, 14, 0.5, 5), 10, 3)])
def test_against_a_plain_trie(spark, shape, limit, chunk):
    rows = invented(*shape)
    frame = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("head"), F.lit(2).alias("first"), F.lit(3).alias("conv"))
    found = trie.trie(trie.rebuilt(trie.chunks(frame.repartition(5), chunk)), limit)
    assert sorted(map(tuple, found.collect()), key=str) == plain_nodes(rows)


def test_one_row_of_a_conversation_without_turns_of_its_own(spark):
    # Conversation 101 has one turn, takes none from the absent 100, and drops its own.
    assert zlib.crc32(b"101") % 6
    found = trie.trie(trie.rebuilt(trie.chunks(spark.createDataFrame([(101, 0, "user", "hello")], SCHEMA)))).collect()
    assert [tuple(r) for r in found] == [(101, 0, None, 1, 0, 1, 0, hashlib.sha256(b"101").hexdigest())]


def test_no_rows(spark):
    assert trie.trie(trie.rebuilt(trie.chunks(spark.createDataFrame([], SCHEMA)))).count() == 0
