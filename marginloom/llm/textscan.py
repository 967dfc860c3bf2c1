"""Vectorised scans over the UTF-8 bytes of Arrow text columns.

Texts are handled in slices of whole rows, about `SLICE` bytes each, so the working memory of a
task does not depend on how many rows a batch has. A null text counts as empty. All hashes are
64-bit polynomials over randomised byte values, finished by a mixer; equal bytes always give equal
hashes, wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for i < n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE * 2)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for k, factor in enumerate((_BASE, inverse)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash so that all bits depend on all bits (wraps around in 64 bits)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in these bytes) for runs of whole rows."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = hash of bytes i..j times base**i."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes outside `space`; runs end with their row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    start = np.flatnonzero(inside & (before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    end = np.flatnonzero(inside & (after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE
                ) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word."""
    start, end, row = words(data, offsets, space)
    return span_hashes(prefix_hashes(data), start, end), row
