"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vitrina.session import ship_package

# What separates words, as a class for regular expressions.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


# Bytes of an Arrow batch between Spark and Python: bounds the buffers of both sides of every task.
BATCH_BYTES = 8 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def prepared(spark: SparkSession) -> SparkSession:
    """A session whose executors have this package, with small Arrow batches unless it sets their size itself."""
    ship_package(spark)
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; functions of this package can run on the executors."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, for a column that is dropped again."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """(encode, bytes per id) of a byte-level BPE file; ids equal those of the ``tokenizers`` library.

    The merge loop of ``tiktoken`` is six times as fast on the same vocabulary. The string
    of an added token in a text is that token, as the library has it at its defaults. White
    space in runs of hundreds of thousands overflows its splitter; such a text goes through
    ``tokenizers``.
    """
    import tiktoken
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    visible = sorted(ByteLevel.alphabet(), key=ord)
    # The printable stand-ins: bytes that print stand for themselves, the others follow from 256 on.
    own = [ord(c) for c in visible if ord(c) < 256]
    others = iter(sorted(set(range(256)) - set(own)))
    byte_of = {c: ord(c) if ord(c) < 256 else next(others) for c in visible}
    special = {t["content"]: t["id"] for t in stored.get("added_tokens", [])}
    ranks = {
        bytes(byte_of[c] for c in token): i for token, i in stored["model"]["vocab"].items() if token not in special
    }
    # Fixed value: the pattern by which byte-level BPE splits a text before its merges.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        try:
            if any(t in text for t in special):
                return fast.encode(text, allowed_special="all")
            return fast.encode_ordinary(text)
        except BaseException as error:
            if type(error).__name__ not in ("PanicException", "ValueError"):
                raise
            return slow.encode(text, add_special_tokens=False).ids

    lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
    for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
        lengths[i] = len(token)
    return encode, lengths


def encoded(*columns: np.ndarray) -> str:
    return base64.b64encode(b"".join(c.tobytes() for c in columns)).decode()


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a batch, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts, lower-cased in A-Z, and where each text's words begin and end."""
    import pyarrow.compute as pc

    # A copy, as lower-casing a slice of an array gives wrong offsets in some Arrow versions.
    whole = pa.concat_arrays([pc.fill_null(column, "").cast(pa.large_string())])
    split = pc.split_pattern_regex(pc.ascii_lower(whole), WORD_BREAK)
    words = split.flatten()
    filled = pc.not_equal(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))])
    return words.filter(filled), before[ends]
