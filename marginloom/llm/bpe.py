"""Byte-level BPE by a deterministic tokenization automaton.

The automaton reads tokens. It accepts exactly the token sequences that applying the merges in
order would produce. It is compiled by inserting one gadget for every merge (u, v) -> w:

* reading w leads where reading v led before the merge, from every state in which u could be read:
  the state after w starts as a copy of the state after v, and w may be read wherever u could;
* the state after u loses its arc v.

A state is the token read last. Copies are not written out. A gadget records its time (the number of
the merge) and its two parents; the arc (s, t) is then looked up by walking to the parents of the
younger of the two tokens, at the time when it was made, until a removed arc or two bytes are met.
Arcs that have been looked up are kept in the transition table.

A word is encoded by following arcs from left to right, longer labels first, and stepping back where
no arc leads on. Decoding concatenates the bytes that label the arcs.

Texts are first split at added tokens and then by the pattern of the vocabulary. Texts without
contractions, added tokens and unusual characters are split on whole columns of bytes, and each
distinct word of a slice is encoded once; other texts take the pattern itself. Tokens of words are
kept in a cache of bounded size in every Python worker.

Nothing here calls a tokenizer library.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from marginloom.llm.textscan import prefix_hashes, slices, span_hashes
from marginloom.llm.workers import mapped

# Pattern of byte-level vocabularies; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space as the vocabulary's splitter understands it: the Unicode property.
PATTERN = PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(
    r"\S", r"\P{White_Space}")
CACHE_WORDS = 250_000
CACHE_ARCS = 300_000
LONG_WORD = 200
PART = 1 << 21
# Texts with other characters, or with a contraction, are split by the pattern itself.
_LETTERS = "".join(c for c in map(chr, range(0x80, 0x250)) if unicodedata.category(c)[0] == "L")
UNUSUAL = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\x00-\x7f" + _LETTERS + "]")
# Classes of bytes in plain texts: 0 other, 1 letter, 2 digit, 3 space, 4 other white space.
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KINDS[[*range(48, 58)]] = 2
KINDS[0x20] = 3
KINDS[[*range(9, 14)]] = 4


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges of one vocabulary file (JSON with model.vocab and model.merges)."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        letters = byte_letters()
        model = spec["model"]
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*model["vocab"].values(), *self.added.values()], default=-1) + 1
        self.labels: list[bytes] = [b""] * size
        self.ids: dict[bytes, int] = {}
        for token, label in raw.items():
            self.labels[model["vocab"][token]] = label
        for text, i in self.added.items():
            self.labels[i] = text.encode()
        self.byte = {}
        for token, label in raw.items():
            if len(label) == 1:
                self.byte[label] = self.ids[label] = model["vocab"][token]
        # Gadgets: time of making (-1 for bytes), left and right parent, time an arc was removed.
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.removed: dict[tuple[int, int], int] = {}
        for time, pair in enumerate(model["merges"]):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(model["vocab"][u], model["vocab"][v], model["vocab"][u + v], time)
        self.arcs: dict[int, bool] = {}
        # A token that its own bytes do not merge into can never be read.
        self.ids = {x: i for x, i in self.ids.items() if self._inside(i)}
        # Longest label with these first four bytes; labels of up to three bytes are just tried.
        self.longest: dict[bytes, int] = {}
        for label in self.ids:
            if len(label) >= 4:
                self.longest[label[:4]] = max(self.longest.get(label[:4], 4), len(label))
        self.label_start = np.cumsum([0] + [len(x) for x in self.labels])
        self.label_bytes = np.frombuffer(b"".join(self.labels), np.uint8)
        self.words: dict[bytes, bytes] = {}
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(
            regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")"
        ) if self.added else None

    def _gadget(self, u: int, v: int, w: int, time: int) -> None:
        self.removed.setdefault((u, v), time)
        label = self.labels[u] + self.labels[v]
        if label not in self.ids:
            self.made[w], self.left[w], self.right[w] = time, u, v
            self.ids[label] = w

    def arc(self, s: int, t: int) -> bool:
        """Whether token t can follow token s once all gadgets are in."""
        found = self._until(s, t, len(self.removed) + len(self.made))
        if len(self.arcs) > CACHE_ARCS:
            self.arcs.clear()
        self.arcs[s << 32 | t] = found
        return found

    def _until(self, s: int, t: int, now: int) -> bool:
        """Whether the arc is there before the gadget of time `now` is put in."""
        made, left, right, removed = self.made, self.left, self.right, self.removed
        while True:
            gone = removed.get((s, t))
            if gone is not None and gone < now:
                return False
            if made[s] < 0 and made[t] < 0:
                return True
            if made[s] > made[t]:
                now = made[s]
                s = right[s]
            else:
                # In a run of one token, merges go from the left: "u w" cannot stand for "u u u".
                now = made[t] + (s == left[t] == right[t])
                t = left[t]

    def _inside(self, token: int) -> bool:
        """Whether the merges turn the token's own bytes into the token."""
        if self.made[token] < 0:
            return True
        u, v = self.left[token], self.right[token]
        return self._inside(u) and self._inside(v) and self._until(u, v, self.made[token])

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word: the only path of the automaton that spells it.

        Every prefix of a word has at most one path, so a place where reading failed never needs
        to be tried again.
        """
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        ids, longest, arcs, n = self.ids.get, self.longest.get, self.arcs.get, len(word)
        path: list[int] = []
        dead: set[int] = set()
        at, last, size, again = 0, -1, 0, False
        while at < n:
            if not again:
                size = longest(word[at:at + 4], 3)
                if size > n - at:
                    size = n - at
            while size:
                token = ids(word[at:at + size])
                if token is not None:
                    if last < 0:
                        ok = True
                    else:
                        ok = arcs(last << 32 | token)
                        if ok is None:
                            ok = self.arc(last, token)
                    if ok and at + size not in dead:
                        break
                size -= 1
            again = not size
            if again:
                dead.add(at)
                token = path.pop()
                size = len(self.labels[token])
                at, size = at - size, size - 1
                last = path[-1] if path else -1
            else:
                path.append(token)
                at, last = at + size, token
        return path

    def _word(self, word: bytes) -> bytes:
        """Encode a word that is not in the cache, as 32-bit integers."""
        found = array("I", self.encode_word(word)).tobytes()
        if len(word) <= LONG_WORD:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    def forget(self) -> None:
        """Empty the caches: the workers stay for other stages, which need the memory."""
        self.words.clear()
        self.arcs.clear()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text of any characters; null: none."""
        parts = [text] if self.special is None or not text else self.special.split(text)
        out: list[bytes] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                for w in map(str.encode, self.split(part)):
                    out.append(self.words.get(w) or self._word(w))
        return np.frombuffer(b"".join(out), "<u4")

    def plain(self, text: str | None) -> bool:
        """Whether `encode_rows` splits the text as the pattern does."""
        return not text or (UNUSUAL.search(text) is None and not any(a in text for a in self.added))

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows in them) for rows of plain texts, all words at once."""
        start = plain_starts(data, offsets)
        end = np.append(start[1:], len(data))
        code, first = distinct(span_hashes(prefix_hashes(data), start, end))
        raw = data.tobytes()
        cached = self.words.get
        found = [cached(w) or self._word(w) for w in [
            raw[i:j] for i, j in zip(start[first].tolist(), end[first].tolist())]]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[code])])
        return flat[spans(begin[code], sizes[code])], ends[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become the replacement character."""
        start = self.label_start[ids]
        data = self.label_bytes[spans(start, self.label_start[np.asarray(ids, np.int64) + 1] - start)]
        return data.tobytes().decode("utf-8", "replace")


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 ... for every stretch, one after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of its value for every key, place of each value's first key)."""
    code, values = pd.factorize(keys)
    first = np.empty(len(values), np.int64)
    first[code[::-1]] = np.arange(len(keys))[::-1]
    return code, first


def plain_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words begin that the pattern finds in plain texts.

    A word is a run of one class with one space before it, if there is one. Of a run of white space
    before something else, the last character stands alone or, if it is a space, joins what follows.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    kind = KINDS[data]
    row = np.zeros(len(data) + 1, bool)
    row[offsets] = True
    blank = kind >= 3
    start = row[:-1].copy()
    before, blank_before = kind[:-1], blank[:-1]
    last = np.zeros(len(data), bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~row[1:-1]
    start[1:] |= np.where(blank[1:], ~blank_before | last[1:],
                          np.where(blank_before, before == 4, before != kind[1:]))
    return np.flatnonzero(start)


def encode_texts(automaton: Automaton, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of the rows) of an Arrow column; plain rows together, others one by one."""
    values = texts.to_pylist()
    plain = np.array([automaton.plain(v) for v in values], bool)
    counts, parts = np.zeros(len(values), np.int64), {}
    rows = np.flatnonzero(plain)
    for lo, data, offsets in slices(texts.filter(pa.array(plain))):
        ids, ends = automaton.encode_rows(data, offsets)
        parts[int(rows[lo])] = ids
        counts[rows[lo:lo + len(ends) - 1]] = np.diff(ends)
    if plain.all():
        return np.concatenate([np.zeros(0, np.uint32), *parts.values()]), np.concatenate(
            [[0], np.cumsum(counts)])
    other = {int(i): automaton.encode(values[i]) for i in np.flatnonzero(~plain)}
    for i, ids in other.items():
        counts[i] = len(ids)
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(ends[-1]), np.uint32)
    for i, ids in other.items():
        out[ends[i]:ends[i + 1]] = ids
    order = np.concatenate([np.zeros(0, np.uint32), *parts.values()])
    out[spans(ends[:-1][rows], counts[rows])] = order
    return out, ends


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about PART bytes of text, so memory does not depend on the rows of a batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + PART, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


_made: dict[str, Automaton] = {}


def _automaton(path: str, definition: str) -> Automaton:
    if path not in _made:
        _made.clear()
        _made[path] = Automaton(definition)
    return _made[path]


def encode_documents(documents: DataFrame, path: str, text: str = "text",
                     ids: bool = True, digests: bool = True) -> DataFrame:
    """Encode and decode every row of a table.

    Adds `n_tokens`, with `ids` the array `token_ids`, and with `digests` the hash of the ids and
    of the text that decoding them gives. A null or empty text has no tokens. `path` is read by the driver; its content, a vocabulary of fixed size,
    goes to the workers.
    """
    with open(path, encoding="utf-8") as file:
        definition = documents.sparkSession.sparkContext.broadcast(file.read())
    kept = [c for c in documents.columns if c != text]
    fields = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept]
    names = kept + ["n_tokens"] + ["token_ids"] * ids + ["ids_sha256", "decoded_sha256"] * digests
    fields += ["n_tokens bigint"] + ["token_ids array<int>"] * ids + [
        "ids_sha256 string", "decoded_sha256 string"] * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(path, definition.value)
        for batch in (part for whole in batches for part in parts(whole, len(kept))):
            coded, ends = encode_texts(automaton, batch.column(len(kept)))
            columns = batch.columns[:len(kept)] + [pa.array(np.diff(ends), pa.int64())]
            if ids:
                columns.append(pa.ListArray.from_arrays(
                    pa.array(ends.astype(np.int32)), pa.array(coded.view(np.int32))))
            if digests:
                rows = [coded[i:j] for i, j in zip(ends[:-1], ends[1:])]
                columns += [pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest()
                                      for r in rows], pa.string()),
                            pa.array([hashlib.sha256(automaton.decode(r).encode()).hexdigest()
                                      for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)
        automaton.forget()

    return mapped(documents.select(*kept, text), run, ", ".join(fields))
