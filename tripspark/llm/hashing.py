"""Numpy hashing of bytes, words and windows: polynomial sums modulo 2**64, read off prefix sums and then mixed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tripspark.llm.common import text_buffer

BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}
#: Powers that a worker keeps for each base, at most; a longer text makes its own.
KEPT = 1 << 20
#: The ASCII white space that ends a word.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base & (2**64 - 1), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= KEPT:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), dtype=np.uint64, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], wherever the span stands."""
    inverse = powers(pow(BASE, -1, 2**64), len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start])


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space, of all texts in a row: bytes, start and end of each word, first word of each text (and the count last)."""
    data, offsets = text_buffer(column)
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return data, start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(_BYTES[data]), start, end)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width values in a row."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    if rest := width - have:
        out = np.minimum(out[:-rest], out[rest:])
    return out
