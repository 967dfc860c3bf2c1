"""Packing of tokenized documents into training sequences, balanced by attention cost.

A piece of n tokens costs n + n * n / SPAN: the linear layers and the attention inside the piece. A
document longer than a sequence gives whole sequences first, each on its own. What is left of it goes
to a window of documents, in which pieces are assigned in descending order of size, each to the
sequence of the lowest cost that has room for it. A piece that fits nowhere is cut: it fills the
sequence with the most room, and its rest is assigned in its turn.

A window holds a bounded number of tokens, of one task. Its sequences have just as much room as it has
tokens, but for a rest below one sequence, which goes on to the task's next window. The last rest of a
task is put into sequences whose sizes are the powers of two of its binary notation, so no sequence is
padded at all. Nothing is shuffled; a task that is run again gives the same rows, as it reads the same
rows in the same order.

Tokens are those of the vocabulary's own library. Plain texts are split into words on whole columns of
bytes, and each distinct word is encoded once for each worker while a cache of bounded size lasts. Texts
with contractions are split by the vocabulary's pattern; texts with unusual characters or added tokens
are given to the library whole.

Unusual rows: a null or empty text has the end token only; null and repeated ids are rows like any
others, each packed for itself. Further columns are not looked at.
"""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from marginloom.llm.bpe import distinct, spans
from marginloom.llm.textscan import prefix_hashes, slices, span_hashes

SPAN = 6144
WINDOW = 512  # sequences
CACHE_WORDS = 900_000
CHUNK = 1 << 20
SLICE = 1 << 21
END = 1
NAMES = ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ("doc_id bigint, start bigint, length bigint, token_ids binary, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")
# The vocabulary's pattern, for lower-cased plain texts.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_LETTERS = "".join(c for c in map(chr, range(0x80, 0x250)) if unicodedata.category(c)[0] == "L")
# The capital letter I with a dot becomes two characters in lower case.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\x7f" + _LETTERS.replace("İ", "") + "]")
CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)", re.IGNORECASE)
# Classes of bytes in plain texts: 0 other, 1 letter, 2 digit, 3 white space.
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KINDS[48:58] = 2
KINDS[[*range(9, 14), 32]] = 3


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, each of which the pattern finds as one."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if fresh:
            if len(self.known) + len(fresh) > CACHE_WORDS:
                self.known, fresh = {}, list(dict.fromkeys(words))
            self.known.update(zip(fresh, self.whole([w.decode() for w in fresh])))
        return [self.known[w] for w in words]

    def encode(self, text: str) -> bytes:
        """Ids of one text of any characters."""
        if UNUSUAL.search(text) or any(t in text for t in self.added):
            return self.whole([text])[0]
        out, lo = [], 0
        while lo < len(text):  # words never reach across a blank
            hi = text.find(" ", lo + CHUNK)
            hi = len(text) if hi < 0 else hi
            out += self.words([w.encode() for w in WORDS.findall(text[lo:hi].lower())])
            lo = hi
        return b"".join(out)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows in them) of rows of plain texts without contractions, all at once."""
        start, end = plain_words(data, offsets)
        code, first = distinct(span_hashes(prefix_hashes(data), start, end))
        raw = data.tobytes()
        found = self.words([raw[i:j] for i, j in zip(start[first].tolist(), end[first].tolist())])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[code])])
        return flat[spans(begin[code], sizes[code])], ends[np.searchsorted(start, offsets)]

    def column(self, texts: pa.Array) -> list[bytes]:
        """Ids of every row of a column; null: none."""
        values = texts.to_pylist()
        plain = np.array([not v or not (UNUSUAL.search(v) or CONTRACTION.search(v) or any(
            t in v for t in self.added)) for v in values], bool)
        out: list[bytes] = [b""] * len(values)
        rows = np.flatnonzero(plain)
        for lo, data, offsets in slices(texts.filter(pa.array(plain)), SLICE):
            ids, ends = self.rows(data, offsets)
            for k, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                out[rows[lo + k]] = ids[i:j].tobytes()
        for i in np.flatnonzero(~plain):
            out[i] = self.encode(values[i])
        return out


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words that the pattern finds in plain texts: runs of letters, single digits,
    and runs of other signs."""
    kind = KINDS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    edge[:-1] |= kind == 2
    edge = np.flatnonzero(edge)
    start, end = edge[:-1], edge[1:]
    some = kind[start] != 3 if len(data) else np.zeros(len(start), bool)
    return start[some], end[some]


def cost(size: int) -> float:
    return size + size * size / SPAN


def rooms(total: int, size: int, last: bool) -> list[int]:
    """Sequences for so many tokens: whole ones, and at the end the powers of two of the rest."""
    rest = total % size
    powers = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
    return [size] * (total // size) + (powers if last else [])


def assigned(sizes: list[int], capacity: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Pieces (document, start, length, sequence), and (document, start) of what no sequence took.

    `sizes` are tokens of documents; start counts within them.
    """
    room, load = np.array(capacity, np.int64), np.zeros(len(capacity))
    waiting = [(-n, d, 0) for d, n in enumerate(sizes)]
    heapq.heapify(waiting)
    pieces = []
    while waiting and room.any():
        n, d, start = heapq.heappop(waiting)
        n = -n
        fits = room >= n
        if fits.any():
            at = int(np.argmin(np.where(fits, load, np.inf)))
        else:
            most = room == room.max()
            at = int(np.argmin(np.where(most, load, np.inf)))
        taken = min(n, int(room[at]))
        pieces.append((d, start, taken, at))
        room[at] -= taken
        load[at] += cost(taken)
        if taken < n:
            heapq.heappush(waiting, (taken - n, d, start + taken))
    return pieces, sorted((d, start) for _, d, start in waiting)


class Shelf:
    """Documents of one task that wait for their window, and the pieces that are ready."""

    def __init__(self, first: int, size: int):
        self.next, self.size = first, size
        self.waiting: list[tuple] = []  # id, start, token bytes, tokens of the document
        self.tokens = 0
        self.ready: list[tuple] = []

    def put(self, key: int | None, ids: bytes) -> None:
        total, whole = len(ids) // 4, len(ids) // 4 // self.size * self.size
        for start in range(0, whole, self.size):
            self.ready.append((key, start, self.size, ids[4 * start:4 * (start + self.size)], total, self.next, 0))
            self.next += 1
        if whole < total:
            self.waiting.append((key, whole, ids[4 * whole:], total))
            self.tokens += total - whole
        if self.tokens >= WINDOW * self.size:
            self.pack(False)

    def pack(self, last: bool) -> None:
        capacity = rooms(self.tokens, self.size, last)
        pieces, left = assigned([len(w[2]) // 4 for w in self.waiting], capacity)
        filled = [0] * len(capacity)
        for d, start, n, at in pieces:
            key, before, ids, total = self.waiting[d]
            self.ready.append((key, before + start, n, ids[4 * start:4 * (start + n)], total,
                               self.next + at, filled[at]))
            filled[at] += n
        self.next += len(capacity)
        self.waiting = [(w[0], w[1] + start, w[2][4 * start:], w[3]) for d, start in left for w in [self.waiting[d]]]
        self.tokens = sum(len(w[2]) // 4 for w in self.waiting)

    def taken(self) -> pa.RecordBatch:
        kinds = [pa.binary() if name == "token_ids" else pa.int64() for name in NAMES]
        columns = list(zip(*self.ready)) if self.ready else [[]] * len(NAMES)
        self.ready = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], NAMES)


def pack_documents(documents: DataFrame, vocabulary: str, size: int = 2048, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """One row for each piece of a document, with its token ids as little-endian 32-bit integers.

    `start` counts the tokens of its document before it, `offset` those of its sequence. `doc_tokens`
    holds the end token. `size` is a power of two.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        shelf = Shelf(TaskContext.get().partitionId() << 36, size)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoder.column(batch.column(1))):
                shelf.put(key, ids + end)
                if len(shelf.ready) >= 4 * WINDOW:
                    yield shelf.taken()
        shelf.pack(True)
        yield shelf.taken()

    return documents.select(documents[doc_id].cast("long").alias("doc_id"), documents[text]).mapInArrow(run, SCHEMA)
