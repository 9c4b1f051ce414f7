"""Periodic runs of words by an online sparse diagonal program.

A diagonal is a lag: word i lies on it when it equals the word that many places earlier. A
stretch with period q is a row of matches on diagonal q. The words are swept once, from left
to right. At each word its earlier occurrences open diagonals, an open diagonal's match
length grows until a word breaks it, and a diagonal that ends with enough matches gives its
run at once.

The program is sparse in two ways, so that a text of one repeated word, or of one repeated
line, is not quadratic. A run of period q has at least 3q matches, so an earlier occurrence
at lags 2**k to 2**(k + 1) - 1 counts only if the next 2**(k + 1) words agree as well; and it
opens a diagonal only where the words before both differ, as it is open already otherwise.
A diagonal whose lag is a multiple of a run's period, inside that run, is that run itself.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.session import spread

# A run has at least this many words, and this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4

COLUMNS = [
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
]
SCHEMA = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in COLUMNS)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, occurs again) of each key."""
    _, rank, count = np.unique(keys, return_inverse=True, return_counts=True)
    return rank, count[rank] > 1


def _earlier(at: np.ndarray, rank: np.ndarray, before: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, lag) of earlier occurrences with lags from ``least`` to ``most`` behind another preceding word.

    ``at`` are the words whose continuation has a twin, ``rank`` names the continuation.
    """
    order = np.lexsort((at, rank))
    at, rank, before = at[order], rank[order], before[order]
    # One number line for all ranks: occurrences of another rank are further away than any lag.
    line = rank.astype(np.int64) * (int(at.max()) + 2 * most + 2) + at
    low, high = np.searchsorted(line, line - most), np.searchsorted(line, line - least, side="right")
    # From each occurrence, the next one with another preceding word.
    n = len(at)
    turns = np.flatnonzero((before[1:] != before[:-1]) | (rank[1:] != rank[:-1])) + 1
    following = np.append(turns, n)[np.searchsorted(turns, np.arange(n), side="right")]
    words, lags = [], []
    own = np.arange(n)
    while len(own := own[low[own] < high[own]]):
        here = low[own]
        same = before[here] == before[own]
        words.append(at[own[~same]])
        lags.append(at[own[~same]] - at[here[~same]])
        low[own] = np.where(same, following[here], here + 1)
    return np.concatenate(words or [at[:0]]), np.concatenate(lags or [at[:0]])


def openings(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, lag) of every diagonal that may become a run, in the order of words, then lags.

    ``words`` holds word numbers, with a number of its own before the first and behind the
    last word of each document; ``longest`` is the number of words of the longest document.
    """
    at = np.arange(1, len(words))
    rank, again = _ranks(words)
    at, rank = at[again[1:]], rank[1:][again[1:]]
    dense = np.full(len(words) + 1, -1, np.int64)
    found, size = [], 1
    while len(at) and size <= longest // LEAST_PERIODS:
        # The continuation doubles: from ``size`` words to twice as many.
        dense[:] = -1
        dense[at] = rank
        follow = dense[np.minimum(at + size, len(words))]
        at, rank, follow = at[follow >= 0], rank[follow >= 0], follow[follow >= 0]
        if not len(at):
            break
        rank, again = _ranks(rank * (len(words) + 1) + follow)
        at, rank = at[again], rank[again]
        if not len(at):
            break
        found.append(_earlier(at, rank, words[at - 1], size, 2 * size - 1))
        size *= 2
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, lag = (np.concatenate(x) for x in zip(*found, strict=True))
    # Too few words are left for the matches a run needs, or the last of these differs.
    needed = np.maximum(LEAST_WORDS - lag, (LEAST_PERIODS - 1) * lag)
    last = np.minimum(word + needed - 1, len(words) - 1)
    fits = (word + needed <= len(words)) & (words[last] == words[last - lag])
    word, lag = word[fits], lag[fits]
    order = np.lexsort((lag, word))
    return word[order], lag[order]


def _matches(words: np.ndarray, at: int, lag: int) -> int:
    """Length of the row of matches on a diagonal from a word on; it grows by doubled steps."""
    length, step = 0, 64
    while True:
        here = words[at + length:at + length + step]
        differ = here != words[at + length - lag:at + length - lag + len(here)]
        first = int(differ.argmax()) if len(differ) else 0
        if not len(differ) or differ[first]:
            return length + first
        length += len(here)
        step = min(2 * step, 1 << 16)


def sweep(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period; ``words`` as in ``openings``."""
    run_at = np.full(len(words), -1, np.int64)
    runs: list[tuple[int, int, int]] = []
    for i, lag in zip(*(x.tolist() for x in openings(words, longest)), strict=True):
        known = run_at[i]
        if known >= 0 and known == run_at[i - lag] and lag % runs[known][2] == 0:
            continue
        matches = _matches(words, i, lag)
        if matches >= max(LEAST_WORDS - lag, (LEAST_PERIODS - 1) * lag):
            run_at[i - lag:i + matches] = len(runs)
            runs.append((i - lag, lag + matches, lag))
    # One stretch may have several periods; the smallest is its own.
    least: dict[tuple[int, int], int] = {}
    for start, length, period in runs:
        least[start, length] = min(period, least.get((start, length), period))
    return sorted((start, length, period) for (start, length), period in least.items())


def repeated(order: np.ndarray, doc_id: int | None) -> np.ndarray:
    """Word positions of a document after its planted repetition, if its id asks for one.

    One id in ten, by ``crc32`` of the decimal id, repeats from some word on; a null id never.
    """
    n = len(order)
    if doc_id is None or not n:
        return order
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return order
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([order[:a], order[a + np.arange(n - a) % period]])


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts, and where each text's words begin and end."""
    whole = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    # ASCII white space is what separates words: blank and 9 to 13.
    parts = pc.ascii_split_whitespace(whole)
    words = parts.flatten()
    filled = pc.not_equal(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))])
    return words.filter(filled), before[ends]


def _described(doc_id: int | None, runs: list[tuple[int, int, int]], collapsed: str) -> tuple:
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    exponent = 1000 * length // period if runs else None
    sha = [hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in (listed, collapsed)]
    return doc_id, len(runs), start, length, period, exponent, *sha


def batch_runs(ids: list, texts: pa.Array, plant: bool) -> list[tuple]:
    """A result row for each document of a batch."""
    flat, bounds = split(texts)
    coded = flat.dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if plant:
        parts = [repeated(np.arange(a, b), i) for i, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        order = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    else:
        order = np.arange(len(number))
    # Each document's words between two numbers that no word has.
    n = np.diff(bounds)
    line = np.full(len(order) + len(n) + 1, -1, np.int64)
    place = np.arange(len(order)) + np.repeat(np.arange(1, len(n) + 1), n)
    line[place] = number[order]
    marks = np.flatnonzero(line < 0)
    line[marks] = len(coded.dictionary) + np.arange(len(marks))
    found: list[list] = [[] for _ in ids]
    firsts = marks[:-1] + 1
    keep = np.ones(len(line), bool)
    keep[marks] = False
    for start, length, period in sweep(line, int(n.max(initial=0))):
        d = int(np.searchsorted(firsts, start, side="right")) - 1
        found[d].append((start - int(firsts[d]), length, period))
        keep[start + period:start + length] = False
    # All words outside the repeats, document by document, joined without a Python string per word.
    ends = np.concatenate([[0], np.cumsum(keep)])[marks]
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), flat.take(pa.array(order[keep[place]])))
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist()
    return [_described(*x) for x in zip(ids, found, collapsed, strict=True)]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """One row per document: its number of runs, its longest run, and digests of all runs and of the text without repeats.

    A run is a stretch of words with smallest period q and at least max(6, 4q) words that no
    neighbouring word extends. ``collapsed_sha256`` is over the words outside the repeats,
    joined by blanks: those after the first period of any run go. ``plant`` first repeats a
    part of one document in ten, chosen by its id, as a check. A null, empty or blank text has
    no words and no runs: four nulls and the digests of the empty string. A null id stays null
    and plants nothing; repeated rows give a row each; an empty table gives no rows; other
    columns are ignored whatever their names. No row is shuffled but to spread a small table,
    and a task holds one batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch_runs(batch.column(0).to_pylist(), batch.column(1), plant)
            values = zip(*rows, strict=True) if rows else [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), t) for v, (_, t) in zip(values, COLUMNS, strict=True)], names=[c for c, _ in COLUMNS]
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, SCHEMA)
