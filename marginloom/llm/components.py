"""Connected components of a table of links, by contraction of the graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginloom.llm.workers import mapped
from marginloom.session import materialize

JUMPS = 3


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all ends of the links: the smallest node that these links connect it with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (before == root).all():
            return nodes, nodes[root]


def stars(links: DataFrame) -> DataFrame:
    """Links (a, b) with a < b that connect the same nodes; those of one batch are reduced to stars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root = forest(*(batch.column(i).to_numpy() for i in (0, 1)))
            some = node != root
            yield pa.RecordBatch.from_arrays([pa.array(root[some]), pa.array(node[some])], ["a", "b"])

    return mapped(links, run, "a bigint, b bigint").distinct()


def hooks(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest neighbour, followed over a few such steps."""
    # Minima are combined before the shuffle, so a node with very many links is no hot key.
    parent = materialize(edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select("a", "b")).groupBy("node").agg(F.least("node", F.min("root")).alias("root")), "hooks")
    out = parent
    for _ in range(JUMPS):
        step = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root").select("node", F.col("next").alias("root"))
    return out


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node can reach. Nodes are longs.

    Every round maps each node to a smaller one connected with it and keeps the links between what
    is left. At least half of the nodes of every open component go, so the number of rounds is at
    most the logarithm of its size. The maps of all rounds, one after another, lead to the root:
    the smallest node of a component is always mapped to itself.
    """
    edges = materialize(stars(links.select(F.col(left).alias("a"), F.col(right).alias("b")).filter(
        "a <> b")), "edges")
    maps = []
    while not edges.isEmpty():
        found = materialize(hooks(edges), "labels")
        maps.append(found)
        for end in ("a", "b"):
            edges = edges.join(found.select(F.col("node").alias(end), F.col("root").alias("r" + end)), end)
        edges = materialize(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias(
            "b")).filter("a <> b").distinct(), "edges")
    if not maps:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))

    def follow(labels: DataFrame, found: DataFrame) -> DataFrame:
        step = found.select(F.col("node").alias("root"), F.col("root").alias("next"))
        return labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))

    return materialize(reduce(follow, maps), "roots")
