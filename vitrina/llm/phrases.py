"""Document fingerprints from Lempel-Ziv phrases.

A document is parsed from its start into the shortest phrases it has not had before; a
phrase is a run of words (of single characters in scripts without blanks). The phrases are
hashed, and the smallest hashes are the fingerprint. The share of common phrases that two
fingerprints estimate tells how much of one text the dictionary of the other covers.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.operators.ordering import with_range
from vitrina.session import shuffle_partitions

# Hashes of a fingerprint; a document with fewer phrases has them all.
KEPT = 128
# Ranges of ids that neighbours are found in: one row each comes to the driver.
ROWS_PER_RANGE = 4096
MOST_RANGES = 20_000
_NO_ID = -(1 << 63)

# The symbols: a word with what follows it, a character of a script without blanks, or white space.
_SYMBOL = re.compile(r"[^\s⺀-\U0010ffff]{1,64}\s{0,64}|[⺀-\U0010ffff]\s{0,64}|\s{1,64}")


def phrases(text: str, known: set[str] | None = None) -> tuple[list[str], list[int]]:
    """New phrases of a text in order and where each ends; an incomplete last phrase is none."""
    known = set() if known is None else known
    found, ends, phrase, at = [], [], "", 0
    for symbol in _SYMBOL.findall(text):
        phrase += symbol
        at += len(symbol)
        if phrase not in known:
            known.add(phrase)
            found.append(phrase)
            ends.append(at)
            phrase = ""
    return found, ends


def smallest(hashes: list[int], kept: int = KEPT) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint32))[:kept]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated share of common phrases, from the smallest hashes of both sets together; 1 for two empty ones."""
    union = np.union1d(a, b)[:kept]
    if not len(union):
        return 1.0
    return float(np.isin(union, a, assume_unique=True).__and__(np.isin(union, b, assume_unique=True)).sum() / len(union))


def encoded(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


class Parsed:
    """A text with its phrases, hashes and fingerprint."""

    def __init__(self, text: str) -> None:
        self.text = text
        found, self.ends = phrases(text)
        self.found, self.hashes = found, [xxhash.xxh32_intdigest(p) for p in found]
        self.smallest = smallest(self.hashes)

    def edited(self, cut: int, tail: str) -> tuple[str, np.ndarray]:
        """(text, fingerprint) with everything from ``cut`` on replaced.

        Phrases that end before the cut stay as they are; parsing goes on behind them.
        """
        j = bisect.bisect_right(self.ends, cut - 1)
        start = self.ends[j - 1] if j else 0
        text = self.text[:cut] + tail
        more, _ = phrases(text[start:], set(self.found[:j]))
        return text, smallest(self.hashes[:j] + [xxhash.xxh32_intdigest(p) for p in more])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(..., fingerprint) for every row, as base64 of its smallest phrase hashes.

    A null text is empty; equal texts have equal fingerprints; an empty table stays empty. A
    column named fingerprint is replaced, all others stay.
    """

    @F.arrow_udf("string")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([encoded(Parsed(t or "").smallest) for t in texts.to_pylist()], pa.string())

    return docs.withColumn("fingerprint", fingerprint.asNondeterministic()(F.col(text).cast("string")))


def _with_successors(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (at, tail, key, id, text) by ranges of ids; each range also has, as tail, the first row after it.

    The order is by descending id, nulls last, then text; after the last row comes the first.
    """
    spark = docs.sparkSession
    rows = docs.count()
    ranges = max(min(max(rows // ROWS_PER_RANGE, 4 * shuffle_partitions(spark)), rows // 16, MOST_RANGES), 1)
    probes = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.approxQuantile("key", probes, 0.25 / ranges))) if probes else []
    ranged = with_range(docs, "key", bounds, "range")
    heads = sorted((tuple(r) for r in ranged.groupBy("range").agg(F.max("key")).collect()), reverse=True)
    # The row before the head of a range is in the range of larger ids; the first head follows the last row.
    links = [(r, head, heads[i - 1][0]) for i, (r, head) in enumerate(heads)]
    link = F.broadcast(spark.createDataFrame(links or [(0.0, 0, 0.0)], "range double, head long, before double"))
    place = lambda at, tail: F.struct(at.alias("at"), F.lit(tail).alias("tail"))
    copied = F.when(F.col("key") == F.col("head"), F.array(place(F.col("range"), 0), place(F.col("before"), 1))).otherwise(
        F.array(place(F.col("range"), 0))
    )
    return ranged.join(link, "range").withColumn("place", F.explode(copied)).select("place.*", "key", "id", "text"), ranges


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside an edited version and its successor.

    The successor is the next document by descending id (rows with one id by text, null ids
    last, after the last the first). The edited text has the last half of the characters
    replaced by as many of the successor's first ones. Null texts are empty; a single
    document succeeds itself; other columns are ignored whatever their names; an empty table
    gives no rows. Rows go once through a shuffle by ranges of ids and are read in order, two
    at a time.
    """
    identity = F.col(key).cast("long")
    rows = docs.select(
        F.coalesce(identity, F.lit(_NO_ID)).alias("key"), identity.alias("id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    placed, ranges = _with_successors(rows)
    ordered = placed.repartition("at").sortWithinPartitions("at", "tail", F.desc("key"), "text").select("at", "tail", "id", "text")
    columns = [
        ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]

    def row(identity, one: Parsed, other: Parsed) -> tuple:
        size = len(one.text)
        half = size // 2
        text, smallest_edited = one.edited(size - half, other.text[:half])
        return (
            identity, size, hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), encoded(one.smallest),
            encoded(smallest_edited), likeness(one.smallest, smallest_edited), likeness(one.smallest, other.smallest),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            found = []
            for at, tail, identity, content in zip(*(batch.column(i) for i in range(4)), strict=True):
                if tail.as_py() and waiting is None:
                    continue
                now = Parsed(content.as_py())
                if waiting is not None:
                    found.append(row(*waiting, now))
                waiting = None if tail.as_py() else (identity.as_py(), now)
            values = zip(*found, strict=True) if found else [[]] * len(columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), k) for v, (_, k) in zip(values, columns, strict=True)], names=[n for n, _ in columns]
            )

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema)
