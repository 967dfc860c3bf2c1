"""Content-defined places in bytes, for finding equal windows without looking at every pair."""

from __future__ import annotations

import numpy as np

from marginloom.llm.textscan import mix

GRAM = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """32-bit hash of the GRAM bytes from each place on, zeros being read behind the end."""
    word = np.zeros(len(data) + GRAM, np.uint64)
    word[:len(data)] = data
    size = 1
    while size < GRAM:
        word[:-size] |= word[size:] << np.uint64(8 * size)
        size *= 2
    return (mix(word[:len(data)] + _FACTOR) >> np.uint64(32)).astype(np.uint64)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of `width` values, for each start of a whole window."""
    best = (values << np.uint64(32)) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while size < width:
        step = min(size, width - size)
        best = np.minimum(best[:-step], best[step:])
        size += step
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(data: np.ndarray, offsets: np.ndarray, window: int, margin: int
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, first start, number of starts) of the runs of windows with the same anchor.

    The anchor of a window is the place of its smallest gram hash, at least `margin` from either
    end, the first of equals. Equal windows have their anchors at equal places.
    """
    places = window - 2 * margin + 1
    if len(data) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    anchor = window_minima(gram_hashes(data)[margin:len(data) - window + margin + places], places) + margin
    anchor = anchor[:len(data) - window + 1]
    inside = np.zeros(len(data) + 1, np.int32)
    size = np.diff(offsets)
    whole = size >= window
    np.add.at(inside, offsets[:-1][whole], 1)
    np.add.at(inside, offsets[1:][whole] - window + 1, -1)
    inside = np.cumsum(inside)[:len(anchor)] > 0
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    row_start = offsets[:-1][whole]
    change[row_start] = True
    start = np.flatnonzero(change)
    count = np.diff(np.append(start, len(anchor)))
    keep = inside[start]
    start, count = start[keep], count[keep]
    return np.searchsorted(offsets, start, side="right") - 1, anchor[start], start, count
