"""Exact top-k search for the inner product by pivot-table elimination.

For every vector the distances to many pivots are stored with it. By the triangle inequality, the
distance of a query and a candidate is at least the largest difference of their distances to a
pivot, which bounds their inner product from above: (|q|^2 + |x|^2 - bound^2) / 2. Candidates are
evaluated in the order of this bound, and a query stops once the next bound is below its k-th score.

Vectors are whole numbers. Candidates and queries are packed into blocks of bounded size, and every
query block meets every candidate block: a stated query set against all rows. Candidate blocks stay
where they are dealt; the query blocks are copied to each group of them. A meeting gives the k best
of its block for each query, and the best of those are the result.

Scores are whole numbers of any size: a block whose products may pass 2**53 is multiplied in Python's
integers. A score beyond a long is written as the largest or smallest long.

Unusual rows: vectors that are null, or hold null or non-finite components, take no part, as do rows with
a null id. Vectors of another length than the query are no candidates. Rows with the query's id are its
own. A query id with different vectors asks with all of them. Equal scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 16
SAMPLE = 1000
CANDIDATES = 4096
QUERIES = 512
BLOCKS_PER_GROUP = 2
LONG = (1 << 63) - 1


def whole_vectors(table: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(id, v) with v = floor(scale * component) as doubles, for the rows that take part."""
    # Doubles of 2**52 and more are whole already; Spark's floor would turn them into longs.
    def whole(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    good = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(F.lit(scale) * x.cast("double")) < float("inf"))) & F.col(vec_id).isNotNull()
    return table.filter(good).select(F.col(vec_id).cast("long").alias("id"), F.transform(vector, whole).alias("v"))


def choose_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Pivots far from one another, out of a bounded sample, for each length of vector."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    out = {}
    for dim in sorted({len(r["v"]) for r in sample}):
        x = np.unique(np.array([r["v"] for r in sample if len(r["v"]) == dim], float).reshape(-1, dim), axis=0)
        chosen = [int(np.argmax((x * x).sum(axis=1)))]
        near = np.full(len(x), np.inf)
        while len(chosen) < min(PIVOTS, len(x)):
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(np.argmax(near)))
        out[dim] = x[chosen]
    return out


def packed(vectors: DataFrame, size: int, pivots) -> DataFrame:
    """Blocks of up to `size` vectors of one length: ids, components and distances to the pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            ends, values = np.asarray(lists.offsets), np.asarray(lists.values)
            length = np.diff(ends)
            out = []
            for dim in np.unique(length):
                rows = np.flatnonzero(length == dim)
                x = values[(ends[rows][:, None] + np.arange(dim)[None, :]).reshape(-1)].reshape(len(rows), dim)
                table = pivots.value.get(int(dim), np.zeros((0, int(dim))))
                for lo in range(0, len(rows), size):
                    part = x[lo:lo + size]
                    small = np.abs(part).max(initial=0) < 2.0**31
                    far = np.sqrt(np.maximum(((part[:, None, :] - table[None]) ** 2).sum(axis=2), 0)) if len(
                        table) else np.zeros((len(part), 0))
                    out.append((int(dim), ids[rows[lo:lo + size]].tobytes(), part.astype("<i4" if small else "<f8").tobytes(),
                                far.tobytes()))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                ["dim", "ids", "vectors", "far"])

    return vectors.mapInArrow(run, "dim int, ids binary, vectors binary, far binary")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to the smaller id."""
    if scores.dtype == object:
        keep = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    else:
        keep = np.lexsort((ids, -scores))[:k]
    return scores[keep], ids[keep]


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers, as longs or as Python's integers."""
    if exact:
        return (x @ q).astype(np.int64)
    ints = [int(b) for b in q]
    return np.array([sum(int(a) * b for a, b in zip(row, ints)) for row in x], object)


def best_of_block(q: tuple, c: tuple, k: int) -> list[tuple[int, int, int, float]]:
    """(query, candidate, score, size) of the k best candidates of one block for each query of another."""
    (q_ids, q, q_far), (ids, x, far) = q, c
    # Products are exact in doubles below 2**53; beyond, Python's integers are multiplied.
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1) < 2.0**53
    x_norm = (x * x).sum(axis=1)
    out = []
    for i in range(len(q_ids)):
        q_norm = float((q[i] * q[i]).sum())
        bound = np.sqrt(q_norm) * np.sqrt(x_norm)
        if far.shape[1]:
            apart = np.abs(far - q_far[i]).max(axis=1)
            bound = np.minimum(bound, (q_norm + x_norm - apart * apart) / 2)
        # Room for rounding in the distances; what is beyond doubles is looked at first.
        bound = bound + 1 + 1e-9 * (q_norm + x_norm)
        bound[~np.isfinite(bound)] = np.inf
        bound[ids == q_ids[i]] = -np.inf
        order = np.argsort(-bound, kind="stable")
        order = order[:len(order) - int((bound == -np.inf).sum())]
        scores, found = np.zeros(0, np.int64 if exact else object), np.zeros(0, np.int64)
        at, step = 0, 64
        while at < len(order):
            if len(found) == k and bound[order[at]] < scores[-1]:
                break
            some = order[at:at + step]
            scores, found = best(np.concatenate([scores, products(x[some], q[i], exact)]),
                                 np.concatenate([found, ids[some]]), k)
            at, step = at + step, step * 2
        out += [(int(q_ids[i]), other, max(-LONG - 1, min(LONG, s)), float(s))
                for other, s in zip(found.tolist(), scores.tolist())]
    return out


def top_k(table: DataFrame, queries, vec_id: str, vector: str, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that the condition `queries` selects."""
    vectors = whole_vectors(table, vec_id, vector, scale)
    asked = whole_vectors(table.filter(queries), vec_id, vector, scale).distinct()
    context = table.sparkSession.sparkContext
    pivots = context.broadcast(choose_pivots(vectors))
    n = max(1, vectors.count())
    groups = -(-n // (CANDIDATES * BLOCKS_PER_GROUP))
    candidates = packed(vectors, CANDIDATES, pivots).withColumn(
        "group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    copies = packed(asked.repartition(-(-n // (50 * QUERIES)), "id"), QUERIES, pivots).select(
        F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
        F.col("far").alias("q_far"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("q_group"))
    meetings = candidates.hint("merge").join(copies.hint("merge"), (F.col("group") == F.col("q_group")) & (
        F.col("dim") == F.col("q_dim"))).select("dim", "ids", "vectors", "far", "q_ids", "q_vectors", "q_far")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(dim, ids, vectors, far):
            ids = np.frombuffer(ids, np.int64)
            kind = "<i4" if len(vectors) == 4 * len(ids) * dim else "<f8"
            return (ids, np.frombuffer(vectors, kind).reshape(len(ids), dim).astype(float),
                    np.frombuffer(far, float).reshape(len(ids), -1))

        for frame in frames:
            for r in frame.itertuples(index=False):
                yield pd.DataFrame(best_of_block(block(r.dim, r.q_ids, r.q_vectors, r.q_far),
                                                 block(r.dim, r.ids, r.vectors, r.far), k),
                                   columns=["query_id", "vec_id", "score", "size"])

    found = meetings.mapInPandas(run, "query_id bigint, vec_id bigint, score bigint, size double")
    # The size ranks scores that a long cannot tell apart.
    order = Window.partitionBy("query_id").orderBy(F.col("size").desc(), F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")
