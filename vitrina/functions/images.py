"""Decoded images: shrinking them where they are read, and an encoder that needs no model file.

An image encoder is an encoder with a ``side``: its function takes a list of pixel strings,
each ``side`` rows of ``side`` pixels of three bytes (red, green, blue), top row first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell_means(values: np.ndarray, cells: int, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of ``cells`` even pieces along an axis; with fewer values than cells, a value fills several."""
    size = values.shape[axis]
    edges = np.arange(cells + 1) * size // cells
    return np.add.reduceat(values, edges[:-1], axis=axis), np.maximum(np.diff(edges), 1)


def shrink(image: np.ndarray, side: int) -> np.ndarray:
    """Mean colour of every cell of a ``side`` by ``side`` grid over (height, width, 3), rounded half up."""
    rows, heights = cell_means(image.astype(np.int64), side, 0)
    sums, widths = cell_means(rows, side, 1)
    counts = (heights[:, None] * widths[None, :])[:, :, None]
    return ((2 * sums + counts) // (2 * counts)).astype(np.uint8)


def shrunk(image: Column | str, side: int) -> Column:
    """Pixel string of an image of Spark's image source; null for one that could not be decoded.

    Grey images get three equal colours; opacity is left out.
    """

    @F.arrow_udf(T.BinaryType())
    def run(images: pa.Array) -> pa.Array:
        fields = [images.field(name) for name in ("height", "width", "nChannels", "data")]
        out = []
        for height, width, channels, data in zip(*fields, strict=True):
            shape = height.as_py(), width.as_py(), channels.as_py()
            if any(n is None or n <= 0 for n in shape):
                out.append(None)
                continue
            pixels = np.frombuffer(data.as_buffer(), np.uint8).reshape(shape)
            # Spark keeps blue, green, red.
            colours = np.repeat(pixels, 3, axis=2) if shape[2] == 1 else pixels[:, :, 2::-1]
            out.append(shrink(colours, side).tobytes())
        return pa.array(out, pa.binary())

    return run.asNondeterministic()(F.col(image) if isinstance(image, str) else image)


@dataclass(frozen=True)
class PixelEncoder:
    """Colours of a ``side`` by ``side`` grid, length one; a black image has zeros only."""

    side: int = 8

    @property
    def dim(self) -> int:
        return 3 * self.side * self.side

    def open(self) -> Callable[[list[bytes]], np.ndarray]:
        dim = self.dim

        def encode(images: list[bytes]) -> np.ndarray:
            out = np.frombuffer(b"".join(images), np.uint8).reshape(len(images), dim) / 255.0
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)

        return encode
