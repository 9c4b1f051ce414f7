"""Text encoders as Arrow-batched columns.

An encoder is any picklable object with ``dim`` and ``open()``; ``open()`` runs
once per task and returns a callable from a list of texts to a matrix of unit
vectors. Load a model inside ``open()``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina.functions.text import normalize_text


class Encoder(Protocol):
    dim: int

    def open(self) -> Callable[[list[str]], np.ndarray]: ...


@dataclass(frozen=True)
class HashingEncoder:
    """Token counts hashed into ``dim`` buckets, length one; needs no model file."""

    dim: int = 64

    def open(self) -> Callable[[list[str]], np.ndarray]:
        dim = self.dim

        @lru_cache(maxsize=1 << 17)
        def bucket(token: str) -> int:
            return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim

        def encode(texts: list[str]) -> np.ndarray:
            # Tokens of the whole batch at once; each distinct one is hashed once.
            split = pc.split_pattern(pa.array(texts, pa.string()), " ")
            coded = split.flatten().dictionary_encode()
            places = np.array([bucket(t) if t else -1 for t in coded.dictionary.to_pylist()], np.int64)
            place = places[coded.indices.to_numpy()] if len(coded) else places
            row = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy())
            cells = (row * dim + place)[place >= 0]
            out = np.bincount(cells, minlength=len(texts) * dim).reshape(len(texts), dim).astype(float)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)

        return encode


def encode(column: Column, encoder: Encoder) -> Column:
    """Vectors of a text column; a null text has none and never reaches the encoder, which opens once per task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder.open()
        for texts in batches:
            given = texts.notna().to_numpy()
            out = np.full(len(texts), None, dtype=object)
            if given.any():
                vectors = np.asarray(model(texts[given].tolist()), dtype=np.float32)
                for row, vector in zip(np.nonzero(given)[0], vectors, strict=True):
                    out[row] = vector
            yield pd.Series(out)

    # An encoder is costly: no copies of the call in filters the optimizer derives.
    return run.asNondeterministic()(column)


def encode_text(column: Column | str, encoder: Encoder) -> Column:
    """Normalise, then encode: how catalogue rows get their vectors. A null text stays without one."""
    text = F.col(column) if isinstance(column, str) else column
    return encode(F.when(text.isNotNull(), normalize_text(text)), encoder)
