import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from conftest_llm import WORDS
from vitrina.llm import runs


def plain_runs(words):
    """(start, length, period) by looking along every lag."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = q
        while i < len(words):
            first = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - first + q >= max(6, 4 * q):
                found.setdefault((first - q, i - first + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text, plant=False):
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    collapsed = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(collapsed.encode()).hexdigest(),
    )


def texts():
    rng = np.random.default_rng(4)
    for t in range(600):
        words = [f"w{x}" for x in rng.integers(0, rng.integers(1, 5), rng.integers(0, 60))]
        if t % 3 == 0 and words:
            part = words[:rng.integers(1, 8)]
            words = words[:5] + part * int(rng.integers(1, 12)) + words[5:9] + part * int(rng.integers(1, 9))
        yield " ".join(words)


def test_against_every_lag(docs_of):
    rows = [(None if i == 7 else i, t) for i, t in enumerate(texts())]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "a\u00a0a " * 9), (903, "a\u00a0a " * 9), (904, "é " * 5), (905, "x " * 6)]
    found = runs.periodic_runs(docs_of(rows), plant=True)
    assert found.columns == [c for c, _ in runs.COLUMNS]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((plain_row(i, t, True) for i, t in rows), key=str)


def test_smallest_period_and_neighbours():
    rows = runs.batch_runs([1, 2, 3], pa.array(["b a a a a a a b", "a b " * 4 + "a", "a b c " * 3 + "a b"]), False)
    assert [r[1:6] for r in rows] == [(1, 1, 6, 1, 6000), (1, 0, 9, 2, 4500), (0, None, None, None, None)]


@pytest.mark.parametrize("text, found", [
    ("a " * 300_000, (1, 0, 300_000, 1)),
    (("a " * 10 + "b ") * 20_000, (20_001, 0, 220_000, 11)),
    ("this is a line that comes again and " * 20_000, (1, 0, 160_000, 8)),
])
def test_long_repeats_are_not_quadratic(text, found):
    assert runs.batch_runs([1], pa.array([text]), False)[0][1:5] == found


def test_words_are_what_stands_between_white_space():
    texts = ["".join(f"{chr(c)}{c}" for c in range(1, 300)), "", " ", "\u2003a\x1cb\x85c\xa0", " x  y\t"]
    words, ends = runs.split(pa.array(texts))
    assert [words.to_pylist()[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)] == [WORDS.findall(t) for t in texts]


def test_no_rows(docs_of):
    assert runs.periodic_runs(docs_of([])).count() == 0
