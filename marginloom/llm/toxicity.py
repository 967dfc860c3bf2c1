"""Toxicity by a factorization machine over hashed terms.

A document is the set of its distinct lower-case words (runs of letters, digits and apostrophes),
each hashed into one of 2**24 buckets. The score is the logistic function of

    bias + sum of w[i] + sum over pairs i < j of <v[i], v[j]>,

so a pair of terms can weigh more or less than its parts do. The sum over pairs is computed from
the sums of v and v**2, in time linear in the terms.

The model is fitted on a bounded sample: the `SAMPLE` labelled rows with the smallest hashes of
their ids. Terms take part that occur in at least `MIN_ROWS` of them and whose presence goes with the label
(chi-square of `MIN_CHI` or more), `MAX_TERMS` at most: the chance terms of a small sample would
otherwise outweigh the few that matter. So do terms that matter only together: of the `PAIRED` most
frequent terms in up to `COMMON` of the rows, pairs whose common rows have other labels than the rows of
either term have (both chi-squares `PAIR_CHI` or more, which no pair of half a million reaches by chance).
Training is one task over that sample; all texts are scored whole.

Unusual rows: a null or empty text has the score of the bias; rows without a label, or with a null
one, are only scored; without any usable label all scores are the prior of
an empty sample, 1/3.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginloom.llm.textscan import lower_ascii, slices, word_hashes

BUCKETS = 1 << 24
SAMPLE = 20_000
MIN_ROWS = 4
MIN_CHI = 16.0
MAX_TERMS = 1 << 14
PAIRED = 1024
COMMON = 0.6
PAIR_CHI = 40.0
FACTORS = 4
EPOCHS = 30
BATCH = 128
RATE = 0.02
WEIGHT = 3.0  # of a row with label 1, of which there are few
DECAY = 2e-4
_inside = np.zeros(256, bool)
_inside[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True


def terms(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets of the distinct terms of each row, offsets of the rows)."""
    for lo, data, offsets in slices(texts):
        hashes, row = word_hashes(lower_ascii(data), offsets, ~_inside)
        key = np.unique((row.astype(np.uint64) << np.uint64(24)) | (hashes % np.uint64(BUCKETS)))
        row = (key >> np.uint64(24)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))])
        yield lo, (key % np.uint64(BUCKETS)).astype(np.int64), ends


class Model:
    """Weights of the known terms; index 0 stands for all others and weighs nothing."""

    def __init__(self, bias: float, buckets: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.buckets, self.w, self.v = bias, buckets, w, v
        self.place = np.zeros(BUCKETS, np.int32)
        self.place[buckets] = np.arange(1, len(buckets) + 1)
        self.table = np.concatenate([np.zeros((1, 1 + v.shape[1]), np.float32),
                                     np.concatenate([w[:, None], v], axis=1)])

    def score(self, found: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of rows with the given buckets."""
        at = self.place[found]
        known = at > 0
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[known]
        picked = self.table[at[known]].astype(float)
        n = len(ends) - 1
        sums = [np.bincount(row, picked[:, k], n) for k in range(picked.shape[1])]
        squares = np.bincount(row, (picked[:, 1:] ** 2).sum(axis=1), n)
        z = self.bias + sums[0] + 0.5 * (sum(s * s for s in sums[1:]) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bias=np.array(self.bias), buckets=self.buckets, w=self.w, v=self.v)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as x:
            return Model(float(x["bias"]), x["buckets"], x["w"], x["v"])


def paired_terms(back: np.ndarray, owner: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Terms of pairs whose common rows differ in the label from the rows of either term."""
    often = np.flatnonzero((rows >= PAIR_CHI) & (rows <= COMMON * len(labels)))
    often = np.sort(often[np.lexsort((often, -rows[often]))][:PAIRED])
    if len(often) < 2:
        return often[:0]
    number = np.full(len(rows), -1)
    number[often] = np.arange(len(often))
    at = number[back]
    both, marked = (np.zeros((len(often),) * 2, np.float32) for _ in range(2))
    for lo in range(0, len(labels), 4096):  # the sample's incidence, a slice of rows at a time
        some = (at >= 0) & (owner >= lo) & (owner < lo + 4096)
        x = np.zeros((min(4096, len(labels) - lo), len(often)), np.float32)
        x[owner[some] - lo, at[some]] = 1
        both += x.T @ x
        marked += x.T @ (x * labels[lo:lo + 4096, None].astype(np.float32))
    share = np.diag(marked) / np.maximum(np.diag(both), 1)
    expected = both * share
    spread = np.maximum(expected * (1 - share), 1e-9 + both * 1e-3)
    chi = (marked - expected) ** 2 / spread
    strong = (np.minimum(chi, chi.T) >= PAIR_CHI) & (both >= MIN_ROWS)
    return often[strong.any(axis=1)]


def fit(lists: list[np.ndarray], labels: np.ndarray) -> Model:
    """Adam on the logistic loss, over rows in a fixed random order."""
    rng = np.random.default_rng(1)
    everything = np.concatenate([np.zeros(0, np.int64), *lists])
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    buckets, back = np.unique(everything, return_inverse=True)
    rows = np.bincount(back, minlength=len(buckets))
    marked = np.bincount(back, labels[owner], len(buckets))
    share = labels.mean() if len(labels) else 0.0
    spread = np.maximum(rows * share * (1 - share) * (1 - rows / max(len(labels), 1)), 1e-9)
    chi = np.where(rows >= MIN_ROWS, (marked - rows * share) ** 2 / spread, 0)
    chosen = np.flatnonzero(chi >= MIN_CHI)
    chosen = chosen[np.lexsort((buckets[chosen], -chi[chosen]))][:MAX_TERMS]
    chosen = np.union1d(chosen, paired_terms(back, owner, rows, labels))
    number = np.full(len(buckets), -1)
    number[chosen] = np.arange(len(chosen))
    place, buckets = number[back], buckets[chosen]
    ends = np.searchsorted(owner[place >= 0], np.arange(len(lists) + 1))
    place = place[place >= 0]
    where = [place[a:b] for a, b in zip(ends, ends[1:])]
    n = len(buckets)
    rate = (labels.sum() + 0.5) / (len(labels) + 1.5)
    bias = np.array([np.log(rate / (1 - rate))])
    table = np.concatenate([np.zeros((n, 1)), rng.normal(0, 0.01, (n, FACTORS))], axis=1)
    first, second, steps = np.zeros_like(table), np.zeros_like(table), np.zeros(n)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(where))
        rate_now = RATE * (1 - epoch / EPOCHS)
        for lo in range(0, len(order), BATCH):
            rows_here = order[lo:lo + BATCH]
            at = np.concatenate([where[i] for i in rows_here])
            row = np.repeat(np.arange(len(rows_here)), [len(where[i]) for i in rows_here])
            x = table[at]
            sums = np.stack([np.bincount(row, x[:, k], len(rows_here)) for k in range(FACTORS + 1)], axis=1)
            squares = np.bincount(row, (x[:, 1:] ** 2).sum(axis=1), len(rows_here))
            z = bias[0] + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows_here]
            error *= 1 + (WEIGHT - 1) * labels[rows_here]
            bias -= 5 * rate_now * error.mean()
            slope = np.concatenate([np.ones((len(at), 1)), sums[row, 1:] - x[:, 1:]], axis=1) * error[row][:, None]
            used, back = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(back, slope[:, k], len(used)) for k in range(FACTORS + 1)], axis=1)
            grad = grad / len(rows_here) + DECAY * table[used]
            steps[used] += 1
            first[used] = 0.9 * first[used] + 0.1 * grad
            second[used] = 0.99 * second[used] + 0.01 * grad * grad
            t = steps[used][:, None]
            table[used] -= rate_now * (first[used] / (1 - 0.9**t)) / (np.sqrt(second[used] / (1 - 0.99**t)) + 1e-6)
    table = table.astype(np.float32)
    return Model(float(bias[0]), buckets, table[:, 0], table[:, 1:])


def train(documents: DataFrame, labels: DataFrame, usable: Column, label: str,
          doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on the labelled rows that `usable` selects; the sample is bounded by SAMPLE rows."""
    chosen = labels.filter(usable & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).orderBy(
        F.xxhash64("_id"), "_id", "_label").limit(SAMPLE)
    rows = documents.join(F.broadcast(chosen), F.col(doc_id) == F.col("_id")).select(  # SAMPLE rows of 12 bytes
        F.col("_id"), F.col("_label"), F.col(text).alias("_text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, found, ends in terms(batch.column(2)):
                size = len(ends) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, size), batch.column(1).slice(lo, size),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.astype(np.int32)))],
                    ["id", "label", "terms"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, labels_ = [], []
        for batch in batches:
            ends, values = np.asarray(batch.column(2).offsets), np.asarray(batch.column(2).values)
            lists += [values[a:b].astype(np.int64) for a, b in zip(ends, ends[1:])]
            labels_ += batch.column(1).to_pylist()
        model = fit(lists, np.array(labels_, float))
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], ["model"])

    kind = documents.schema[doc_id].dataType.simpleString()
    one = rows.mapInArrow(features, f"id {kind}, label int, terms array<int>").repartition(1)
    learned = one.sortWithinPartitions("id", "label").mapInArrow(learn, "model binary").collect()
    return Model.from_bytes(learned[0]["model"]) if learned else fit([], np.zeros(0))


_made: dict[int, Model] = {}


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model.to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _made:
            _made.clear()
            _made[key] = Model.from_bytes(shared.value)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, found, ends in terms(batch.column(1)):
                out[lo:lo + len(ends) - 1] = _made[key].score(found, ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], [doc_id, "score"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, score double")
