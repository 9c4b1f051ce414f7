from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from conftest_llm import WORDS
from vitrina.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def water_levels(sizes, weights, epochs=3):
    """Targets by the rule itself, in exact fractions."""
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(epochs * sizes[s] for s in clamped)
        share = {s: Fraction(left * weights[s], sum(weights[x] for x in free)) for s in free}
        above = {s for s in free if share[s] > epochs * sizes[s]}
        if not above:
            return {**{s: Fraction(epochs * sizes[s]) for s in clamped}, **share}
        clamped |= above


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_rule(docs_of, seed):
    rng = np.random.default_rng(seed)
    names = ["b", "a", None, "ä", "Z", "tiny", "nothing"]
    rows = []
    for i in range(400):
        source = names[min(int(rng.integers(0, 12)), 4)]
        rows.append((i, " ".join("w" for _ in range(int(rng.integers(0, 40)))), source))
    rows += [(1000, "one two", "tiny"), (1001, None, "nothing"), (1002, "", "nothing"), (1003, "w " * 5000, "a"), (5, "again", "a"), (None, "x y z", "b")]
    found = mixing.mixed_words(docs_of(rows, SCHEMA)).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    ordered = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(ordered)}
    targets = water_levels(sizes, weights)
    taken = defaultdict(int)
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - float(targets[r.source])) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        # Rows that share an id at the cut round down.
        assert abs(taken[s] - float(targets[s])) <= 2
    assert sorted(map(str, found)) == sorted(map(str, mixing.mixed_words(docs_of(rows, SCHEMA).repartition(5)).collect()))


def test_documents_are_repeated_whole(docs_of):
    rows = [(i, "w " * 10, "big") for i in range(90)] + [(100 + i, "w " * 10, "small") for i in range(3)]
    docs = docs_of(rows, SCHEMA)
    found = mixing.mixed(docs).select("doc_id", "source").collect()
    assert mixing.mixed(docs).columns == docs.columns
    counts = defaultdict(int)
    for r in found:
        counts[r.source, r.doc_id] += 1
    # Weights 1 and 2 of 930 words: small is clamped at three epochs, big takes the rest.
    assert all(counts["small", 100 + i] == 3 for i in range(3))
    assert sum(n for (s, _), n in counts.items() if s == "big") == 84


def test_many_sources_meet_salted(docs_of, monkeypatch):
    rows = [(i, "w " * (i % 7), f"s{i % 5}") for i in range(200)]
    expected = sorted(map(str, mixing.mixed_words(docs_of(rows, SCHEMA)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mixed_words(docs_of(rows, SCHEMA)).collect())) == expected


def test_no_rows_and_no_words(docs_of):
    assert mixing.mixed_words(docs_of([], SCHEMA)).count() == 0
    assert mixing.mixed(docs_of([], SCHEMA)).count() == 0
    assert [(r.target, r.taken) for r in mixing.mixed_words(docs_of([(1, None, None)], SCHEMA)).collect()] == [(0.0, 0)]
