"""Periodic runs of words by seed and extend.

A run of period q is a stretch of words that equals itself q words later, is as long as it can be, has
no smaller period, and has at least max(6, 4 q) words. On the diagonal of lag q it is a stretch of at
least max(5, 3 q) matching words, the guaranteed overlap.

Lags are handled in classes from 2**j to 2**(j + 1) - 1, each with grams of the smallest overlap
guaranteed in its class: five words, then 3 * 2**j. The grams of a document are indexed by their hash,
and an occurrence is paired with the next one of the same document. This is enough: a gram is at least
as long as the lag, so if it came again earlier inside a run, the run would have a smaller period. The
same argument leaves out all multiples of a smallest period. So a class has at most one pair a word,
and the work is that of sorting a document once a class.

Pairs are seeds. Those of one lag are taken in ascending order; a table of the furthest place that is
covered skips seeds inside what has been extended, and the others are extended word by word, in steps
that double and are then halved on prefix hashes.

All documents of a slice are handled together. Words are known by 64-bit hashes. Memory follows the
largest text.

Unusual rows: a null, empty or blank text has no words and no runs, and the hash of nothing. A null id
counts as an id that `planted` leaves alone; repeated rows are handled each for itself. Further columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginloom.llm.textscan import mix, powers, prefix_hashes, slices, span_hashes, words

LEAST = 6
TIMES = 4
SCHEMA = ("doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
          "collapsed string")


class Grams:
    """Hashes of stretches of a sequence of word hashes."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = powers(len(hashes) + 1)
        self.prefix = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes) * up[:len(hashes)], out=self.prefix[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


def seeds(grams: Grams, row: np.ndarray, end: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(place, distance to the next equal gram) with a distance from lag to 2 * lag - 1, and the gram's size.

    `row` is the document of each word and `end` the place behind its last word.
    """
    size = 5 if lag == 1 else 3 * lag
    place = np.arange(len(row))
    place = place[place + size <= end]
    key = mix(grams.span(place, place + size) + mix(row[place].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    apart = place[1:] - place[:-1]
    pair = (key[1:] == key[:-1]) & (apart >= lag) & (apart < 2 * lag)
    return place[:-1][pair], apart[pair], size


def matching(grams: Grams, left: np.ndarray, right: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
    """Number of equal words from left and right on (or before them), at most `limit`."""
    def equal(n):
        if back:
            return grams.span(left - n, left) == grams.span(right - n, right)
        return grams.span(left, left + n) == grams.span(right, right + n)

    low, step = np.zeros(len(left), np.int64), 1
    high = limit.copy()
    open_ = low < high
    while open_.any():
        n = np.minimum(step, high)
        same = equal(np.where(open_, n, 0))
        low = np.where(open_ & same, n, low)
        high = np.where(open_ & ~same, n - 1, high)
        open_ &= same & (low < high)
        step *= 2
    while (low < high).any():
        n = (low + high + 1) // 2
        same = equal(n)
        low, high = np.where(same, n, low), np.where(same, high, n - 1)
    return low


def find_runs(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start within the row, length, period) of all runs of rows of words, by row, start and period."""
    count = np.diff(offsets)
    grams = Grams(hashes)
    found = []
    lag = 1
    while len(count) and max(LEAST, TIMES * lag) <= count.max():
        some = np.flatnonzero(count >= max(LEAST, TIMES * lag))
        row = np.repeat(some, count[some])
        place = np.repeat(offsets[some] - (np.cumsum(count[some]) - count[some]), count[some]) + np.arange(len(row))
        part = Grams(hashes[place])
        ends = np.repeat(np.cumsum(count[some]), count[some])
        at, apart, size = seeds(part, row, ends, lag)
        at = place[at]
        order = np.lexsort((at, apart))
        at, apart = at[order], apart[order]
        owner = np.searchsorted(offsets, at, side="right") - 1
        # A seed right behind another one of its lag lies in what that one covers.
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (apart[1:] != apart[:-1])
        at, apart, owner = at[fresh], apart[fresh], owner[fresh]
        ahead = matching(grams, at + size, at + apart + size, offsets[owner + 1] - at - apart - size, False)
        reach = at + size + ahead
        # Furthest covered place of each lag; places grow with the rows, so rows do not mix.
        base = apart * (len(hashes) + 1)
        covered = np.maximum.accumulate(base + reach) - base if len(at) else reach
        fresh = np.ones(len(at), bool)
        fresh[1:] = (apart[1:] != apart[:-1]) | (at[1:] >= covered[:-1])
        at, apart, owner, reach = at[fresh], apart[fresh], owner[fresh], reach[fresh]
        start = at - matching(grams, at, at + apart, at - offsets[owner], True)
        found.append((owner, start - offsets[owner], reach + apart - start, apart))
        lag *= 2
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    owner, start, length, period = (np.concatenate(c) for c in zip(*found))
    keep = length >= np.maximum(LEAST, TIMES * period)
    owner, start, length, period = owner[keep], start[keep], length[keep], period[keep]
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], length[order], period[order]


def planted(key: int | None, n: int) -> np.ndarray | None:
    """Numbers of the words that the words of a document with this id are replaced by; None: no change.

    In every tenth document, the words from some place on repeat a few of them.
    """
    if key is None or n == 0:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def periodic_runs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  replaced: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row.

    `collapsed` has the words that no run holds behind its first period, joined by one blank. With
    `replaced`, a function of an id and a number of words, the words are first taken in that order.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, data, offsets in slices(batch.column(1)):
                yield from slice_rows(ids[lo:lo + len(offsets) - 1], data, offsets)

    def slice_rows(ids, data, offsets):
        hashes, ends = hashed(data, offsets)
        orders = [replaced(key, int(n)) if replaced else None for key, n in zip(ids, np.diff(ends))]
        for r, order in enumerate(orders):
            if order is not None:
                hashes[ends[r]:ends[r + 1]] = hashes[ends[r] + order]
        row, start, length, period = find_runs(hashes, ends)
        gone = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(gone, ends[row] + start + period, 1)
        np.add.at(gone, ends[row] + start + length, -1)
        kept = np.cumsum(gone)[:-1] == 0
        first = np.searchsorted(row, np.arange(len(ids) + 1))
        out = []
        for r, order in enumerate(orders):
            tokens = data[offsets[r]:offsets[r + 1]].tobytes().split()
            chosen = kept[ends[r]:ends[r + 1]]
            if order is not None:
                tokens = [tokens[i] for i in order[chosen].tolist()]
            elif not chosen.all():
                tokens = [tokens[i] for i in np.flatnonzero(chosen).tolist()]
            some = slice(first[r], first[r + 1])
            runs = [dict(zip(("start", "length", "period"), x)) for x in zip(
                start[some].tolist(), length[some].tolist(), period[some].tolist())]
            out.append((ids[r], len(chosen), runs, b" ".join(tokens).decode()))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct(
            [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                         ["doc_id", "n_words", "runs", "collapsed"])

    return documents.select(documents[doc_id].cast("long").alias("doc_id"), documents[text]).mapInArrow(run, SCHEMA)


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, offsets of the rows in them)."""
    start, end, row = words(data, offsets)
    count = np.bincount(row, minlength=len(offsets) - 1)
    return span_hashes(prefix_hashes(data), start, end), np.concatenate([[0], np.cumsum(count)])
