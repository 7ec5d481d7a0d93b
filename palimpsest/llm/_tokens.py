"""Vectorised word splitting and hashing shared by the operators that run in Arrow batches.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; lower-casing touches A-Z only. Both
hold for UTF-8, whose multi-byte sequences never contain ASCII bytes. Hashes are 64-bit and depend
on the bytes alone, so they agree between processes, machines and runs.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: An odd multiplier and its inverse modulo 2**64 (checked below), for positional byte hashes.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
assert (_P * _P_INV) % (1 << 64) == 1

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """The words of a batch of texts.

    ``doc`` gives each word's text, ``start``/``end`` its bytes in ``raw``, ``hash`` 64 bits of it;
    ``first`` has, for each text, the index of its first word, and one entry more at the end.
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.bytes = _LOWER[self.raw] if lower else self.raw
        space = _IS_SPACE[self.raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.start, self.text_start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._texts = len(texts)

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = span_hash(self.bytes, self.start, self.end)
        return self._hash

    def __len__(self) -> int:
        return len(self.start)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """64 bits for each span of ``data``; equal bytes give equal hashes wherever they stand."""
    up, down = _power_tables(block + 1)
    out = np.empty(len(start), U)
    if not len(start):
        return out
    # Blocks keep the power tables small; a span longer than a block is hashed by itself.
    at = 0
    while at < len(start):
        lo = int(start[at])
        to = int(np.searchsorted(end, lo + block, "right"))
        if to <= at:
            out[at] = _long_hash(data[lo : int(end[at])])
            at += 1
            continue
        hi = int(end[to - 1])
        total = np.concatenate((np.zeros(1, U), np.cumsum((data[lo:hi].astype(U) + U(1)) * up[: hi - lo], dtype=U)))
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
        at = to
    return out


def _long_hash(data: np.ndarray) -> np.uint64:
    """As span_hash, for one span of any length."""
    value, scale, block = 0, 1, 1 << 16
    up, _ = _power_tables(block + 1)
    for at in range(0, len(data), block):
        part = data[at : at + block]
        value += int(np.sum((part.astype(U) + U(1)) * up[: len(part)], dtype=U)) * scale
        scale = scale * pow(_P, len(part), 1 << 64) % (1 << 64)
    return mix(np.array([(value + len(data)) % (1 << 64)], U))[0]


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``width`` words; a text with fewer words has its whole sequence as one, with none nothing."""
    h, n = words.hash, np.diff(words.first)
    runs = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), runs)
    offset = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = words.first[:-1][doc] + offset
    size = np.minimum(n[doc], width)
    out = size.astype(U)
    for k in range(width):
        with_k = size > k
        word = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else np.zeros(len(at), U)
        out = mix(out * U(_P) + np.where(with_k, word, U(0)) + with_k.astype(U))
    return doc, out


def as_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null reads as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
