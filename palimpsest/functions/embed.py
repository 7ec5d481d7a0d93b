"""The default embedding: eight polynomial hashes of the text's bytes, exact in single precision."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Provider

#: Fixed values.
DIMENSIONS, MODULUS, CYCLE = 8, 1_000_003, 8


#: Bytes of a text that are hashed by themselves, a multiple of CYCLE, and bytes that are hashed together; hashes that become one.
PIECE, TOGETHER, WIDTH = 1 << 16, 1 << 20, 64


def _composed(factor: np.ndarray, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of steps acc * factor + term in runs of ``n``, one after the other, what each run does as one step: halves are put together, WIDTH steps at a time. Numbers stay below 2 ** 42, exact in doubles."""

    def low(x: np.ndarray) -> np.ndarray:
        return x - np.floor(x * (1 / MODULUS)) * MODULUS  # the remainder, or one MODULUS beside it

    while True:
        chunks = np.maximum(1, -(-n // WIDTH))
        at = np.arange(len(factor)) + np.repeat((np.cumsum(chunks) - chunks) * WIDTH - (np.cumsum(n) - n), n)
        f, t = np.ones(int(chunks.sum()) * WIDTH), np.zeros(int(chunks.sum()) * WIDTH)
        f[at], t[at] = factor, term
        for _ in range(WIDTH.bit_length() - 1):
            f, t = low(f[::2] * f[1::2]), low(t[::2] * f[1::2] + t[1::2])
        factor, term, n = f, t, chunks
        if n.max(initial=1) == 1:
            return factor, term


def _embedded(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    sizes = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, np.diff(ends))
    pieces = -(-sizes // PIECE)
    of = np.repeat(np.arange(len(sizes)), pieces)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    size, start = np.minimum(PIECE, sizes[of] - start), start + ends[:-1][of]
    data, found, first = np.frombuffer(texts.buffers()[2] or b"", np.uint8), [], 0
    before = np.cumsum(size) - size
    while first < len(of):
        last = max(first + 1, int(np.searchsorted(before, before[first] + TOGETHER)))
        n = size[first:last]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        found.append(_composed(data[place + np.repeat(start[first:last], n)].astype(np.float64) + 1, (place & (CYCLE - 1)) + 1.0, n))
        first = last
    out = np.zeros((len(sizes), DIMENSIONS), np.float32)
    if found:
        factor, term = _composed(np.concatenate([f for f, _ in found]), np.concatenate([t for _, t in found]), pieces)
        out[:] = (np.arange(DIMENSIONS) * factor[:, None] + term[:, None]).astype(np.int64) % MODULUS
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * DIMENSIONS), pa.array(out.ravel()), mask=pa.array(sizes == 0))


def hash_embedding(text: Column) -> Column:
    """array<float> of eight; null for a null or empty text.

    The d-th hash starts at d and takes each byte b at place i by acc * (b + 1) + i % 8 + 1. That is affine
    in d, so a text's steps put together give the factor and the term for all eight.
    """
    return F.arrow_udf(_embedded, "array<float>")(text.cast("string"))


def embed_text(text: str) -> list[float]:
    """The same on the driver, for a query; an empty one is an error."""
    if not text:
        raise Provider("an empty text has no embedding")
    out = []
    for acc in range(DIMENSIONS):
        for i, b in enumerate(text.encode()):
            acc = (acc * (b + 1) + i % CYCLE + 1) % MODULUS
        out.append(float(acc))
    return out


@dataclass(frozen=True)
class Embedding:
    """A provider: the same embedding of a text on the driver, for queries, and of a Column, for records."""

    of_text: Callable[[str], list[float]] = embed_text
    of_column: Callable[[Column], Column] = hash_embedding
    dimension: int = DIMENSIONS
