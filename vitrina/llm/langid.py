"""Language identification by compression.

Each language has a raw-content dictionary for zstandard, made of a bounded sample of its
labelled texts. A text is cut into chunks, every chunk is compressed with every dictionary,
and the language whose dictionary gives the fewest bytes is chosen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.llm.common import free_name

UNDETERMINED = "und"
# The bound of the fit: rows of each language, characters of each row, bytes of a dictionary.
SAMPLE_ROWS = 200
SAMPLE_CHARS = 300
DICTIONARY_BYTES = 1 << 14
CHUNK_BYTES = 1 << 11
SALTS = 64
# A best size that is less than this share below the second best is too close to trust.
LEAST_MARGIN = 0.002

PREDICTION = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
])

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case letters of a text; everything else becomes one blank."""
    return _NO_LETTERS.sub(" ", text.lower()).strip()


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, in the order of their names."""

    dictionaries: tuple[tuple[str, bytes], ...]
    least_margin: float = LEAST_MARGIN

    def open(self):
        """A function from a text to (language, score, margin, rejected)."""
        # Short matches and a lazy search: what tells languages apart is a few letters long.
        parameters = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY, min_match=4, search_log=4, hash_log=15, chain_log=15, window_log=17,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        names, compressors = [], []
        for name, content in self.dictionaries:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            names.append(name)
            compressors.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary).compress)

        def classify(text: str | None):
            known = letters(text or "")
            if not names or not any(map(str.isalpha, known)):
                return UNDETERMINED, 0.0, 0.0, True
            # Blanks around it, as first and last words then match like any other.
            content = f" {known} ".encode("utf-8", "replace")
            sizes = [0] * len(names)
            for start in range(0, len(content), CHUNK_BYTES):
                chunk = content[start:start + CHUNK_BYTES]
                for i, compress in enumerate(compressors):
                    sizes[i] += len(compress(chunk))
            best = min(sizes)
            others = sorted(sizes)[1:]
            margin = (others[0] - best) / others[0] if others else 1.0
            # A saved byte counts as one bit of evidence.
            score = 1.0 / sum(0.5 ** min(s - best, 1000) for s in sizes)
            return names[sizes.index(best)], score, margin, margin < self.least_margin

        return classify


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS,
    least_margin: float = LEAST_MARGIN, dictionary_bytes: int = DICTIONARY_BYTES,
) -> LanguageModel:
    """Dictionaries from labelled texts, a bounded sample.

    Of each language the ``rows`` different texts with the smallest hashes count, with
    ``chars`` characters from a place in the text that its hash gives: the bound of what
    comes to the driver is languages * rows * chars, and the order of the input does not
    matter. A dictionary has at most ``dictionary_bytes``, an equal part of them from every
    sampled text that is long enough. Rows without text or label are left out; copies count
    once. Without labelled rows every prediction is ``und``.
    """
    known = labelled.select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(text)).alias("h")
    ).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    first = lambda *part: F.row_number().over(Window.partitionBy("lang", *part).orderBy("h"))
    # Salted before the language itself, so that a frequent language never meets in one task.
    chosen = (
        known.select("lang", "h", F.pmod("h", F.lit(SALTS)).alias("salt")).distinct()
        .withColumn("place", first("salt")).where(F.col("place") <= rows)
        .withColumn("place", first()).where(F.col("place") <= rows).select("h").distinct()
    )
    hashes = [r.h for r in chosen.collect()]
    start = F.pmod("h", F.greatest(F.char_length("text") - chars, F.lit(0)) + 1) + 1
    piece = F.substr(F.col("text"), start.cast("int"), F.lit(chars))
    sample = known.where(F.col("h").isin(hashes)).select("lang", "h", piece.alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    pieces: dict[str, list[bytes]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r.lang, r.h)):
        pieces.setdefault(r.lang, []).append(letters(r.text).encode("utf-8", "replace"))
    kept = {name: _joined([p for p in parts if p], dictionary_bytes) for name, parts in pieces.items()}
    return LanguageModel(tuple(sorted((name, content) for name, content in kept.items() if content)), least_margin)


def _joined(parts: list[bytes], size: int) -> bytes:
    """Equal beginnings of all parts in at most ``size`` bytes, blanks between; what short parts leave goes to the others."""
    each, left = 0, sorted(len(p) + 1 for p in parts)
    for i, n in enumerate(left):
        each = (size - sum(left[:i])) // (len(left) - i)
        if n > each:
            break
    return b"".join(p[:max(each - 1, 0)] + b" " for p in parts)[:size]


def prediction(model: LanguageModel, text: Column) -> Column:
    """Struct of lang_pred, score (0 to 1), margin and rejected for a text.

    A null text or one without a letter is ``und`` with score 0 and rejected. Equal sizes
    go to the first name; their margin of 0 rejects them.
    """

    @F.arrow_udf(PREDICTION)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classify = model.open()
        for batch in batches:
            columns = zip(*[classify(t) for t in batch.to_pylist()], strict=True) if len(batch) else [[]] * 4
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.name for f in PREDICTION]
            )

    # Evaluated once, not again in every field that is taken from it.
    return predict.asNondeterministic()(text.cast("string"))


def accepted(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows whose language is decided, with their own columns, whatever their names.

    Null and empty texts and texts without a letter go; repeated rows stay or go together;
    an empty table stays empty. A model without languages rejects all rows.
    """
    own = free_name(docs, "__language")
    return docs.withColumn(own, prediction(model, F.col(text))).where(~F.col(f"{own}.rejected")).drop(own)
