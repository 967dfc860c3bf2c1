"""Near duplicates of embeddings by a subspace pigeonhole join.

For unit vectors, cosine >= t is squared distance <= 2 - 2t. The vectors are rotated by a fixed random
rotation and split into blocks of coordinates. The squared distances of the blocks sum up to the
whole, so in at least one block it is at most the block's share of the budget, in proportion to its
coordinates. Each block is a range join; what it finds is verified on the whole vectors in double
precision. A pair is counted in the first block that finds it, so the union of the blocks needs no
list of pairs.

Range join: vectors are put in the order of a grid over their first rotated coordinates and packed, once
each, into pieces of bounded size with the box that holds them. Spark joins the pieces whose boxes
are near enough to each other, without shuffling them. Where two pieces meet, each block drops the vectors
that are too far from the other piece's box in that block. The squared distances of the others within the
block are one product of matrices in single precision, with room for its rounding; what passes is
measured again. So the disk holds a vector twice, in the shuffle and in its piece, however many
meetings it takes part in. What leaves a task is one row a vector: its links there and the smallest
vector it is connected to there.

Boxes tell vectors apart only where they vary by more than the radius. Vectors spread evenly over all
directions meet nearly all others in every block; the product is what makes these meetings cheap.

Equal vectors are one class from the start, named by a 64-bit hash, and are counted, not paired. Components
may be of any size: a vector is scaled by the power of two of its largest component before anything is squared.

Unusual rows: vectors that are null, zero, or hold null or non-finite components link with nothing
and are kept; vectors of different length are not compared; a null id stays null, and its class is
named by its other ids. An empty vector is a zero vector. Rows with a repeated id are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginloom.llm.components import components, forest
from marginloom.llm.workers import mapped
from marginloom.session import materialize

BLOCK = 32
ORDERED = 8  # rotated coordinates that order the pieces
PIECE = 8192
SLACK = 1e-6  # room for rotated coordinates in single precision
ROUNDING = 1e-5  # room for products in single precision
ROWS, WIDTH = 256, 512
CHECKED = 1 << 16
HELD = 1 << 20


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors divided by a power of two, with a largest component from 0.5 to 1: nothing is rounded."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def rotated(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors of scaled ones in single precision."""
    return ((x / norms(x)[:, None]) @ rotation(x.shape[1])).astype(np.float32)


def block_slices(dim: int) -> list[slice]:
    """Blocks of about BLOCK coordinates."""
    edges = np.linspace(0, dim, max(1, round(dim / BLOCK)) + 1).round().astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def budgets(dim: int, threshold: float) -> np.ndarray:
    return np.array([(2 - 2 * threshold) * (s.stop - s.start) / dim for s in block_slices(dim)])


def named(rows: DataFrame, threshold: float, whole: bool = True) -> DataFrame:
    """(id, node) of every row; `whole`: (node, m, dim, place, x) of the distinct vectors of a batch.

    `x` holds the vector in single precision, if that is exact, or else in double.
    """
    def vectors(batch: pa.RecordBatch) -> Iterator[tuple]:
        lists = batch.column(1)
        ends, values = np.asarray(lists.offsets), np.asarray(lists.values) + 0.0  # no negative zeros
        length = np.diff(ends)
        for dim in np.unique(length):
            rows_ = np.flatnonzero(length == dim)
            x = values[(ends[rows_][:, None] + np.arange(dim)).reshape(-1)].reshape(len(rows_), dim)
            with np.errstate(over="ignore"):
                short = (x.astype(np.float32) == x).all(axis=1)
            cells = [(v.astype("<f4") if s else v.astype("<f8")).tobytes() for v, s in zip(x, short)]
            salt = [int(dim).to_bytes(16, "little"), b""]
            node = np.frombuffer(b"".join(blake2b(c, digest_size=8, salt=salt[0]).digest() for c in cells), "<i8")
            yield rows_, int(dim), x, cells, node

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, _, _, _, node in vectors(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_)), pa.array(node)], ["id", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.sqrt(2 - 2 * threshold + SLACK)
        for batch in batches:
            for _, dim, x, cells, node in vectors(batch):
                node, first, count = np.unique(node, return_index=True, return_counts=True)
                grid = np.floor(rotated(scaled(x[first]))[:, :ORDERED] / width).clip(-100, 100).astype(np.int8)
                place = (grid.astype(np.int16) + 128).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(count.astype(np.int64)), pa.array(np.full(len(node), dim, np.int32)),
                     pa.array([p.tobytes() for p in place], pa.binary()), pa.array([cells[i] for i in first], pa.binary())],
                    ["node", "m", "dim", "place", "x"])

    if not whole:
        return mapped(rows, ids, "id bigint, node bigint")
    return mapped(rows, run, "node bigint, m bigint, dim int, place binary, x binary")


def packed(distinct: DataFrame, parts: int) -> DataFrame:
    """(piece, dim, short, node, m, x, lo, hi): vectors near each other, each once, as arrays in bytes.

    `lo` and `hi` are the corners of the box of their rotated unit vectors.
    """
    def piece(dim: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        node, m, cells = zip(*rows)
        short = all(len(c) == 4 * dim for c in cells)
        x = unpacked(cells, dim)
        r = rotated(scaled(x))
        return pa.RecordBatch.from_pylist([{
            "piece": min(node), "dim": dim, "short": short, "node": np.array(node, "<i8").tobytes(),
            "m": np.array(m, "<i8").tobytes(), "x": x.astype("<f4" if short else "<f8").tobytes(),
            "lo": r.min(axis=0).tolist(), "hi": r.max(axis=0).tolist()}], pa.schema([
                ("piece", pa.int64()), ("dim", pa.int32()), ("short", pa.bool_()), ("node", pa.binary()), ("m", pa.binary()),
                ("x", pa.binary()), ("lo", pa.list_(pa.float32())), ("hi", pa.list_(pa.float32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        of = None
        for batch in batches:
            node, m, dim, x = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("node", "m", "dim", "x"))
            for row in zip(node, m, dim, x):
                if held and row[2] == of and held[-1][0] == row[0]:
                    held[-1][1] += row[1]
                    continue
                if held and (row[2] != of or len(held) >= PIECE):
                    yield piece(of, held)
                    held = []
                of = row[2]
                held.append([row[0], row[1], row[3]])
        if held:
            yield piece(of, held)

    order = ["dim", "place", "node"]
    return mapped(distinct.repartitionByRange(parts, *order).sortWithinPartitions(*order), run, (
        "piece bigint, dim int, short boolean, node binary, m binary, x binary, lo array<float>, hi array<float>"))


def unpacked(cells: tuple[bytes, ...], dim: int) -> np.ndarray:
    """Vectors from their bytes, which hold single or double precision."""
    out = np.empty((len(cells), dim))
    size = np.array([len(c) for c in cells])
    for width, kind in ((4, "<f4"), (8, "<f8")):
        some = np.flatnonzero(size == width * dim)
        out[some] = np.frombuffer(b"".join(cells[i] for i in some), kind).reshape(len(some), dim)
    return out


class Side:
    """One of two pieces that meet."""

    def __init__(self, dim: int, short: bool, node: bytes, m: bytes, x: bytes):
        self.node, self.m = np.frombuffer(node, "<i8"), np.frombuffer(m, "<i8")
        self.x = scaled(np.frombuffer(x, "<f4" if short else "<f8").reshape(len(self.node), dim).astype(float))
        self.r = rotated(self.x)
        self.norm = norms(self.x)
        self.lo, self.hi = self.r.min(axis=0).astype(float), self.r.max(axis=0).astype(float)

    def near(self, other: Side, limits: np.ndarray) -> list[np.ndarray]:
        """For each block, the vectors that the other's box is within the limits of, there and on the whole."""
        gap = np.maximum(np.maximum(self.r - other.hi, other.lo - self.r), 0) ** 2
        apart = np.add.reduceat(gap, [s.start for s in block_slices(gap.shape[1])], axis=1)
        whole = apart.sum(axis=1) <= limits.sum()
        return [np.flatnonzero(whole & (apart[:, b] <= limit)) for b, limit in enumerate(limits)]


def compare(left: Side, right: Side, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (positions in left and right) of two pieces, or of one with itself."""
    dim, same = left.x.shape[1], left is right
    parts, budget = block_slices(dim), budgets(dim, threshold)
    ours, theirs = (s.near(o, budget + SLACK) for s, o in ((left, right), (right, left)))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for block, (rows, others) in enumerate(zip(ours, theirs)):
        p, q = left.r[rows, parts[block]], right.r[others, parts[block]]
        one, square, squares = np.ones((len(p), 1), np.float32), (p * p).sum(axis=1), (q * q).sum(axis=1)
        # The product of these rows is the squared distance.
        p = np.hstack([p, square[:, None], one])
        q = np.vstack([-2 * q.T, np.ones((1, len(q)), np.float32), squares[None]])
        tiles = [(at, np.ascontiguousarray(q[:, at:at + WIDTH])) for at in range(0, q.shape[1], WIDTH)]
        limit = np.float32(budget[block] + SLACK + ROUNDING)
        for lo, (at, tile) in product(range(0, len(p), ROWS), tiles):
            if same and rows[lo] >= others[min(at + WIDTH, len(others)) - 1]:
                continue  # within one piece, each pair is looked at once
            apart = p[lo:lo + ROWS] @ tile
            if apart.min() > limit:
                continue
            found = np.flatnonzero((apart <= limit).reshape(-1))
            i, j = rows[lo + found // apart.shape[1]], others[at + found % apart.shape[1]]
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), CHECKED):
                a, b = i[k:k + CHECKED], j[k:k + CHECKED]
                within = [((left.r[a, s].astype(float) - right.r[b, s]) ** 2).sum(axis=1) <= budget[n] + SLACK
                          for n, s in enumerate(parts[:block + 1])]
                new = within[block] & ~np.any(within[:block], axis=0) if block else within[0]
                a, b = a[new], b[new]
                linked = np.einsum("ij,ij->i", left.x[a], right.x[b]) / (left.norm[a] * right.norm[b]) >= threshold
                out.append((a[linked], b[linked]))
    return tuple(np.concatenate(c) for c in zip(*out))


def within_reach(threshold: float) -> Column:
    """The boxes of pieces a and b are near enough for a link."""
    over, under = (F.zip_with(x, y, lambda p, q: p.cast("double") - q) for x, y in (
        ("a_lo", "b_hi"), ("b_lo", "a_hi")))
    gaps = F.zip_with(over, under, lambda p, q: F.greatest(p, q, F.lit(0.0)))
    whole = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)
    return whole <= 2 - 2 * threshold + 1e-3


def links(pieces: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) from the meetings of pieces in a task."""
    def summed(found: list[tuple]) -> pa.RecordBatch:
        node, count, root = (np.concatenate(c) for c in zip(*found))
        some, at = np.unique(node, return_inverse=True)
        total = np.zeros(len(some), np.int64)
        np.add.at(total, at, count)
        names, roots = forest(node, root)
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(total), pa.array(
            roots[np.searchsorted(names, some)])], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left, found = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["a_piece"] != last:
                    last, left = row["a_piece"], Side(*(row["a_" + c] for c in ("dim", "short", "node", "m", "x")))
                right = left if row["b_piece"] == last else Side(*(row["b_" + c] for c in ("dim", "short", "node", "m", "x")))
                i, j = compare(left, right, threshold)
                if not len(i):
                    continue
                size = len(left.node)
                if left is right:
                    nodes, j_ = left.node, j
                else:
                    nodes, j_ = np.concatenate([left.node, right.node]), size + j
                count = np.bincount(i, right.m[j], len(nodes)) + np.bincount(j_, left.m[i], len(nodes))
                some, root = forest(nodes[i], nodes[j_])
                order = np.argsort(nodes)
                found.append((some, count[order[np.searchsorted(nodes, some, sorter=order)]].astype(np.int64), root))
                if sum(len(f[0]) for f in found) > HELD:
                    yield summed(found)
                    found = []
        if found:
            yield summed(found)

    a, b = (pieces.select(*[F.col(c).alias(f"{side}_{c}") for c in pieces.columns]) for side in "ab")
    # Every partition of pieces meets every other one; nothing is shuffled or broadcast. The lengths of
    # vectors are no join key, as there are few.
    met = a.join(b.hint("shuffle_replicate_nl"), (F.col("a_piece") <= F.col("b_piece")) & (
        F.col("a_dim") <= F.col("b_dim")) & (F.col("a_dim") >= F.col("b_dim")) & within_reach(threshold))
    return mapped(met.drop("a_lo", "a_hi", "b_lo", "b_hi"), run, "node bigint, links bigint, root bigint")


def near_duplicates(table: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id",
                    vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    parts = max(1, -(-table.count() // PIECE))
    pieces = materialize(packed(named(rows.filter(good), threshold), parts), "pieces")
    found = materialize(links(pieces, threshold), "vector-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per = found.groupBy("node").agg(F.sum("links").alias("links"))
    ids = named(rows.filter(good), threshold, whole=False)
    # No table of classes or rows is broadcast: all of them grow with the vectors.
    classes = ids.groupBy("node").agg(F.count("*").alias("m"), F.min("id").alias("least")).join(
        per.hint("merge"), "node", "left").join(roots.hint("merge"), "node", "left")
    known = materialize(classes.select("node", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                                       F.coalesce("root", "node").alias("component")), "classes")
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest.hint("merge"), "component").select("node", "n_links", "component_id")
    linked = ids.join(known.hint("merge"), "node").select("id", "n_links", "component_id")
    alone = rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(vec_id), "n_links", "component_id", F.coalesce(
        F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
