"""Links of the Jaccard join through rows without an id and between sets of unequal sizes."""

from __future__ import annotations

import numpy as np
import pytest
from test_operators import BASE, shingles

from marginloom.llm import jaccard
from marginloom.llm.shipping import ship


def brute_force(rows, width, percent):
    sets = [shingles(text, width) for _, text in rows]
    top = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    top[a] = top[b] = min(top[a], top[b])
    out = []
    for (key, text), x, t in zip(rows, sets, top):
        ids = [k for (k, _), s in zip(rows, top) if s == t and k is not None]
        out.append((key, len(x), min(ids, default=None) if x else key))
    return sorted(map(str, out))


@pytest.mark.parametrize("percent, seed", [(90, 1), (80, 2), (50, 3)])
def test_links_through_rows_without_id(spark, percent, seed):
    ship(spark)
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(12):
        words = [f"g{group}w{i}" for i in range(90)]
        for step in range(6):  # a chain: each differs a little from the one before
            for _ in range(max(1, (100 - percent) // 12)):
                words[rng.integers(90)] = f"x{rng.integers(1 << 30)}"
            rows += [(None if step % 2 or group == 0 else len(rows), " ".join(words))] * (1 + step % 3)
    rows += [(None, None), (None, ""), (999, None)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_force(rows, 3, percent)


def test_sizes_two_bands_apart(spark):
    ship(spark)
    rows = [(1, BASE), (2, " ".join(BASE.split()[:62]))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()
    assert {r.component_id for r in got} == {1}


def test_open_blocks_get_hubs_of_their_own(spark):
    """Blocks with one smallest class in common are tried with other hubs, and with few pairs, before all meets all."""
    size = 40
    blocks = spark.range(3).selectExpr("id as key").crossJoin(spark.range(1, size).selectExpr("0L as a", "id as b"))
    classes = spark.range(size).selectExpr("id as node", "100L as n", "id as at", *[f"0L as {c}" for c in jaccard.SKETCH])
    roots = classes.selectExpr("node", "node as root")
    pairs = {(r.a, r.b) for r in jaccard.hubs_in_turn(blocks, classes, roots, 0.9, 0).collect()}
    assert all(a < b for a, b in pairs) and len(pairs) <= 3 * jaccard.HUBS * size
    assert {n for _, n in pairs} | {n for n, _ in pairs} == set(range(size)) and any(a and b for a, b in pairs)
    one = classes.selectExpr("node", "0L as root")
    assert jaccard.hubs_in_turn(blocks, classes, one, 0.9, 0).isEmpty()
