"""Token counts of sections by offset-mapped attribution.

A document is encoded once as a whole, so that its tokens are the ones a model sees. Token
character spans are then joined to the spans of its sections, and a token that crosses a
boundary is allocated by an explicit rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import byte_bpe, tokenizer_path

# first: the section of the token's first character; largest: the one with most of its
# characters, the earlier of equals; split: each in proportion to its characters.
RULES = ("first", "largest", "split")
OUTSIDE = -1
ROWS_OUT = 1 << 16

COUNTS = "section int, start long, n_chars long, n_tokens double, n_crossing long"


def joined_fields(fields: list[str], separator: str = "\n") -> tuple[Column, Column]:
    """(text, sections) of several columns in one text: one section per field, the separators in none.

    Null fields are empty.
    """
    values = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    start, spans = F.lit(0).cast("long"), []
    for value in values:
        stop = start + F.char_length(value)
        spans.append(F.struct(start.alias("start"), stop.alias("stop")))
        start = stop + len(separator)
    return F.concat_ws(separator, *values), F.array(*spans)


def line_spans(text: str) -> np.ndarray:
    """(start, stop) of each line with its line feed; an empty text is one empty line."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.nonzero(codes == 10)[0] + 1
    bounds = np.concatenate([[0], ends, [len(codes)]])
    spans = np.stack([bounds[:-1], bounds[1:]], axis=1)
    # A final line feed ends the last line and begins no other.
    return spans[:-1] if len(ends) and ends[-1] == len(codes) else spans


def token_spans(text: str, sizes: np.ndarray) -> np.ndarray:
    """(first, last + 1) character of each token from the tokens' sizes in bytes.

    Tokens that share the bytes of one character all span it.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    if not len(ends):
        return np.zeros((0, 2), np.int64)
    return np.stack([character[ends - sizes], character[ends - 1] + 1], axis=1)


def allocated(tokens: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(tokens, crossing tokens) of each section and the tokens outside of all.

    Sections are ordered and disjoint, gaps may lie between. A crossing token has
    characters in several sections, or in one and in none; it is allocated by the rule
    among sections and gap alike, and counts as crossing for every section it touches.
    """
    count, crossing, outside = np.zeros(len(spans)), np.zeros(len(spans), np.int64), 0.0
    first, last = tokens[:, 0], tokens[:, 1] - 1
    at = np.searchsorted(spans[:, 0], first, side="right") - 1
    to = np.searchsorted(spans[:, 0], last, side="right") - 1
    # Beyond the stop of the section that begins before it, a character is in a gap.
    stop = np.concatenate([[-1], spans[:, 1]])
    inside = (at == to) & (last < stop[at + 1])
    gap = (at == to) & (first >= stop[at + 1])
    count += np.bincount(at[inside], minlength=len(spans))
    outside += float(gap.sum())
    for i in np.nonzero(~inside & ~gap)[0].tolist():
        touched, shares, covered = [], [], 0
        for s in range(max(int(at[i]), 0), int(to[i]) + 1):
            common = min(int(last[i]) + 1, int(spans[s, 1])) - max(int(first[i]), int(spans[s, 0]))
            if common > 0:
                touched.append(s)
                shares.append(common)
                covered += common
        size = int(last[i]) + 1 - int(first[i])
        crossing[touched] += 1
        if rule == "split":
            count[touched] += np.array(shares) / size
            outside += (size - covered) / size
        elif rule == "first":
            if touched and spans[touched[0], 0] <= first[i]:
                count[touched[0]] += 1
            else:
                outside += 1
        else:
            best = int(np.argmax(shares)) if touched else -1
            if touched and shares[best] >= size - covered:
                count[touched[best]] += 1
            else:
                outside += 1
    return count, crossing, outside


def attributed(
    docs: DataFrame, sections: str | None = None, rule: str = "largest", path: str | None = None, key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Token counts of every section of every document: (key, section, start, n_chars, n_tokens, n_crossing).

    ``sections`` names an array of (start, stop) in characters, ordered and disjoint; without
    it the lines of the text are its sections. Spans are cut at the text's end, null spans
    left out. Tokens in no section make a row of their own, section -1, if there are any;
    the counts of a document add up to its tokens. A null or empty text has one empty line
    and no tokens. Repeated rows are counted each; other columns are ignored whatever their
    names; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or tokenizer_path("byte_bpe_50k.json")
    columns = [F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text")]
    if sections:
        span = F.filter(F.col(f"`{sections}`"), lambda s: s.isNotNull())
        columns += [
            F.transform(span, lambda s: s["start"].cast("long")).alias("starts"),
            F.transform(span, lambda s: s["stop"].cast("long")).alias("stops"),
        ]
    names = ["key", "section", "start", "n_chars", "n_tokens", "n_crossing"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = byte_bpe(path)
        out: list[list[np.ndarray]] = [[] for _ in names]
        keys: list = []
        rows = 0

        def taken() -> pa.RecordBatch:
            columns = [pa.array(keys, kinds[0])] + [
                pa.array(np.concatenate([np.zeros(0), *c]).astype(k.to_pandas_dtype()), k) for c, k in zip(out[1:], kinds[1:], strict=True)
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_py() or ""
                ids = np.array(encode(content), np.int64)
                tokens = token_spans(content, sizes[ids])
                if sections:
                    starts, stops = (batch.column(c)[i].as_py() or [] for c in (2, 3))
                    spans = np.array(list(zip(starts, stops, strict=True)), np.int64).reshape(-1, 2).clip(0, len(content))
                else:
                    spans = line_spans(content)
                count, crossing, outside = allocated(tokens, spans, rule)
                number = np.arange(len(spans))
                chars = spans[:, 1] - spans[:, 0]
                parts = [number, spans[:, 0], chars, count, crossing]
                if outside:
                    rest = (OUTSIDE, 0, len(content) - int(chars.sum()), outside, 0)
                    parts = [np.append(p, r) for p, r in zip(parts, rest, strict=True)]
                for column, part in zip(out[1:], parts, strict=True):
                    column.append(part)
                keys += [batch.column(0)[i].as_py()] * len(parts[0])
                rows += len(parts[0])
                if rows >= ROWS_OUT:
                    yield taken()
                    out, keys, rows = [[] for _ in names], [], 0
        yield taken()

    return docs.select(*columns).mapInArrow(run, f"key long, {COUNTS}").withColumnRenamed("key", key)
