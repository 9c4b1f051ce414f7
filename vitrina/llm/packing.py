"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents longer than a window fill whole windows of their own. What is left of them
and the short documents are gathered into groups of bounded size as a task reads its
rows; each group is partitioned into windows by the largest differencing method. No
row is shuffled and no task holds more than one group.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vitrina.llm.common import byte_bpe, texts_of, tokenizer_path

WINDOW = 2048
END_ID = 1
# Windows of one group; bounds a task's memory (this many times the window) and its time.
GROUP_WINDOWS = 256
# One document in so many is cut into halves, quarters and so on, which level out the windows.
HALVED_EVERY = 3
SMALLEST_HALF = 8

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each item by Karmarkar-Karp multiway differencing.

    Every item begins as a partition with one filled window. The two partitions with
    the widest imbalance merge, the heaviest windows of one with the lightest of the
    other, until one is left.
    """
    n = len(sizes)
    if n == 0 or windows == 1:
        return np.zeros(n, np.int64)
    # A partition: its imbalance, window sums from light to heavy, and a node of the merge tree per window.
    heap = [(-int(s), i, None, None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, np.ndarray, np.ndarray]] = []
    nodes, turn = n, n

    def opened(entry):
        spread, i, sums, slots = entry
        if sums is None:
            sums, slots = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
            sums[-1], slots[-1] = -spread, i
        return sums, slots

    while len(heap) > 1:
        a, a_slots = opened(heapq.heappop(heap))
        b, b_slots = opened(heapq.heappop(heap))
        sums, b_slots = a + b[::-1], b_slots[::-1]
        both = (a_slots >= 0) & (b_slots >= 0)
        slots = np.where(a_slots >= 0, a_slots, b_slots)
        k = int(both.sum())
        if k:
            merges.append((nodes, a_slots[both], b_slots[both]))
            slots[both] = np.arange(nodes, nodes + k)
            nodes += k
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        # Only differences count from here on.
        heapq.heappush(heap, (int(sums[0] - sums[-1]), turn, sums - sums[0], slots[order]))
        turn += 1
    _, slots = opened(heap[0])
    window = np.empty(nodes, np.int64)
    window[slots[slots >= 0]] = np.nonzero(slots >= 0)[0]
    for first, left, right in reversed(merges):
        window[left] = window[right] = window[first:first + len(left)]
    return window[:n]


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each item, windows): the count rises until no window exceeds the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, windows)
        if np.bincount(window, sizes, windows).max(initial=0) <= capacity:
            return window, windows
        windows += 1


def _halves(start: int, stop: int) -> list[tuple[int, int]]:
    cuts = []
    while stop - start >= 2 * SMALLEST_HALF:
        middle = (start + stop) // 2
        cuts.append((start, middle))
        start = middle
    return [*cuts, (start, stop)]


class _Group:
    """The pieces that a task has gathered for its next windows."""

    def __init__(self) -> None:
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.pieces: list[tuple[int, int, int]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray, start: int) -> None:
        at = len(self.docs)
        self.docs.append((doc_id, ids))
        cuts = _halves(start, len(ids)) if at % HALVED_EVERY == 0 else [(start, len(ids))]
        self.pieces += [(at, *cut) for cut in cuts]
        self.tokens += len(ids) - start


class _Rows:
    """Finished pieces, column by column, and the task's next sequence number."""

    def __init__(self, first: int) -> None:
        self.columns: list[list] = [[] for _ in PIECES.split(",")]
        self.sequence = first

    def put(self, doc_id, ids: np.ndarray, start: int, stop: int, sequence: int, offset: int) -> None:
        row = (
            doc_id, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), len(ids), sequence, offset,
        )
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)

    def put_group(self, group: _Group, capacity: int) -> None:
        sizes = np.array([stop - start for _, start, stop in group.pieces], np.int64)
        window, windows = pack(sizes, capacity)
        filled = np.zeros(windows, np.int64)
        for (at, start, stop), w in zip(group.pieces, window.tolist(), strict=True):
            self.put(*group.docs[at], start, stop, self.sequence + w, int(filled[w]))
            filled[w] += stop - start
        self.sequence += windows

    def taken(self, names: list[str]) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.columns], names=names)
        self.columns = [[] for _ in names]
        return batch


def packed(
    docs: DataFrame, path: str | None = None, window: int = WINDOW, group_windows: int = GROUP_WINDOWS
) -> DataFrame:
    """Pieces of all documents in windows of at most ``window`` tokens.

    ``docs`` has doc_id and text; other columns are ignored whatever their names. A null
    or empty text is a document of the end token alone; repeated rows are packed once
    each; a null doc_id stays null. An empty table gives no rows. Sequence numbers start
    anew in every partition, with the partition's number in the upper bits.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    names = [part.split()[0] for part in PIECES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = byte_bpe(path)
        rows, group = _Rows(TaskContext.get().partitionId() << 40), _Group()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    rows.put(doc_id, ids, start, start + window, rows.sequence, 0)
                    rows.sequence += 1
                if whole < len(ids):
                    group.add(doc_id, ids, whole)
                if group.tokens > (group_windows - 1) * window:
                    rows.put_group(group, window)
                    group = _Group()
            if len(rows.columns[0]) >= 1 << 14:
                yield rows.taken(names)
        if group.pieces:
            rows.put_group(group, window)
        yield rows.taken(names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
