"""Grouping of spelling variants by PartEnum signatures of letter multisets.

Two words are near if they differ by one inserted, deleted or replaced code point. A word is written as
a binary vector whose dimensions are (letter, how often it stood before): one changed letter changes
the vector in at most two places. Such pairs are found by partition and enumeration:

* the dimensions are cut into `parts` parts; at least one of them differs in at most
  k = floor(2 / parts) places;
* each part is cut into `pieces` pieces; in that part all but k pieces are equal. A word writes a
  signature for every part and every choice of all but k of its pieces: the hash of its letters there.

So near words share a signature for certain. With the parameters used, (1, 7), a signature holds five
sevenths of all letters, which keeps the buckets of short words small. Words that share a signature are
joined on it and verified by their edit distance inside the join, which only puts out near pairs.

A bucket of more than BUCKET words is joined on more: of two near words, either the first or the last
half of the shorter one's letters is at the same place in both, so the words of such a bucket meet under
(signature, length of the shorter word, side, half). No bucket is cut.

A word's form is its most frequent near word, if that is at least twice as frequent. Counts at least
double from form to form, so there are no cycles, and roots are found by doubling the steps.

Words, signatures and forms grow with the texts, but their compressed files look small enough for a broadcast
that the driver cannot hold, so their joins carry a merge hint.

Words are counted in the tasks first, then by the plain aggregation. Unusual rows: a null text has no
words; a row with a null id keeps its words unchanged, as do rows without letters; repeated rows count
again. Further columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginloom.llm.textscan import mix
from marginloom.session import materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SLIP = 97
BUCKET = 200
HELD = 200_000
# Letters by how frequent they usually are, so that the pieces hold about equally many; fixed value.
USUAL = "etaoinshrdlcumwfgypbvkjxqz"


def damaged(key: int, word: str) -> str:
    """The word, without one of its letters in one of 97 cases that the id decides."""
    h = zlib.crc32(f"{key}:{word}".encode())
    if h % SLIP:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def counted_words(documents: DataFrame, least_length: int, least_count: int, doc_id: str, text: str) -> DataFrame:
    """(word, n) of the words that are long and frequent enough, over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def taken():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(
                list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                # One entry a distinct word: equal words of a document are damaged alike.
                for word, n in Counter(RUN.findall((cell.as_py() or "").translate(LOWER))).items():
                    if len(word) >= least_length:
                        held[word if key is None else damaged(key, word)] += n
                if len(held) > HELD:
                    yield taken()
        yield taken()

    found = documents.select(documents[doc_id].cast("long").alias("id"), documents[text]).mapInArrow(
        run, "word string, n bigint")
    return found.filter(F.char_length("word") >= least_length).groupBy("word").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def choices(parts: int, pieces: int) -> list[list[int]]:
    """For each signature, the pieces (numbered through all parts) that it is made of."""
    k = 2 // parts
    return [[part * pieces + p for p in some] for part in range(parts)
            for some in combinations(range(pieces), pieces - k)]


def signatures(words: pa.Array, parts: int, pieces: int) -> np.ndarray:
    """Signature hashes, one row a word."""
    data = words.to_pylist()
    size = np.array([len(w) for w in data], np.int64)
    letters = np.frombuffer("".join(data).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(data)), size)
    order = np.lexsort((letters, row))
    letters = letters[order]  # rows stay where they are
    new = np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    before = np.arange(len(letters)) - np.repeat(first, np.diff(np.append(first, len(letters))))
    rank = letters.copy()
    for i, c in enumerate(USUAL):
        rank[letters == ord(c)] = i
    piece = (rank + 3 * before) % (parts * pieces)
    sums = np.zeros((len(data), parts * pieces), np.uint64)
    np.add.at(sums, (row, piece), mix(letters.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                                      + before.astype(np.uint64)))
    out = np.empty((len(data), len(choices(parts, pieces))), np.uint64)
    for s, some in enumerate(choices(parts, pieces)):
        h = np.full(len(data), s + 1, np.uint64)
        for p in some:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + sums[:, p])
        out[:, s] = h
    return out


def signed_words(words: DataFrame, parts: int, pieces: int) -> DataFrame:
    """(sig, word, n) for every signature of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                found = signatures(part.column(0), parts, pieces)
                at = pa.array(np.repeat(np.arange(part.num_rows), found.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.reshape(-1).view(np.int64)), *part.take(at).columns], ["sig", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "sig bigint, word string, n bigint")


def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(a, na, b, nb): the near pairs a < b of rows with equal keys."""
    left = rows.select(*keys, F.col("word").alias("a"), F.col("n").alias("na"))
    right = rows.select(*keys, F.col("word").alias("b"), F.col("n").alias("nb"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 1) & (
        F.levenshtein("a", "b", 1) == 1)
    return left.hint("merge").join(right, [left[k] == right[k] for k in keys]).filter(near).select("a", "na", "b", "nb")


def halves(rows: DataFrame) -> DataFrame:
    """Each row under both halves, for a shorter word of its own length and of one letter less."""
    size = F.char_length("word")
    cases = []
    for less in (0, 1):
        half = F.floor((size - less) / 2).cast("int")
        for side, part in ((0, F.left("word", half)), (1, F.right("word", half))):
            cases.append(F.struct((size - less).alias("size"), F.lit(side).alias("side"), part.alias("half")))
    return rows.withColumn("at", F.explode(F.array(*cases))).select(
        "sig", "word", "n", F.col("at.size").alias("size"), F.col("at.side").alias("side"), F.col("at.half").alias("half"))


def near_pairs(words: DataFrame, parts: int = 1, pieces: int = 7) -> DataFrame:
    """(a, na, b, nb): all near pairs a < b of distinct words with their counts."""
    rows = signed_words(words, parts, pieces)
    sizes = materialize(rows.groupBy("sig").agg(F.count("*").alias("m")).filter("m > 1"), "signatures")
    rows = materialize(rows.join(sizes.hint("merge"), "sig"), "signed")
    small, large = rows.filter(F.col("m") <= BUCKET), rows.filter(F.col("m") > BUCKET)
    # Words that share several signatures are found several times.
    return joined(small, ["sig"]).union(joined(halves(large), ["sig", "size", "side", "half"])).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of (word, form); follows forms to the last."""
    steps = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(steps.join(ahead.hint("merge"), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return steps


def spelling_groups(documents: DataFrame, least_length: int = 5, least_count: int = 3, doc_id: str = "doc_id",
                    text: str = "text", parts: int = 1, pieces: int = 7) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word."""
    words = materialize(counted_words(documents, least_length, least_count, doc_id, text), "words")
    pairs = near_pairs(words, parts, pieces)
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias(
        "m")).union(pairs.select("b", "nb", "a", "na"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(
        F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    best = materialize(best.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.m")).alias(
        "form_n")).join(words.hint("merge"), "word").withColumn("has", F.col("form_n") >= 2 * F.col("n")), "near")
    top = roots(best.filter("has").select("word", "form"))
    found = best.join(top.hint("merge"), "word", "left").select("word", "n_near", "root", *[
        F.when(F.col("has"), F.col(c)).alias(c) for c in ("form", "form_n")])
    return words.join(found.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
