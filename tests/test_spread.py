"""Operators that must not put a long prefix, a hot code, a NULL group or a large file into one task."""

from __future__ import annotations

import hashlib
import os
import random
from datetime import date, timedelta

import pytest
from fixtures import rows
from pyspark.sql import functions as F

from marginloom.functions.hashing import hash_key
from marginloom.operators import intervals, ordering, ranking
from marginloom.operators.paging import text_order
from marginloom.plans import releases
from marginloom.sources.inventory import digest, file_inventory


def test_positions_follow_the_order(spark):
    rng = random.Random(3)
    values = [None, *[f"{'x' * rng.randrange(40)}{rng.randrange(30)}" for _ in range(400)]]
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, i int").repartition(5)
    got = ordering.with_ordinal(frame, ["v", "i"], "n", start=7, pieces=6).collect()
    expected = sorted(((v is not None, (v or "").encode(), i) for i, v in enumerate(values)))
    assert [r.i for r in sorted(got, key=lambda r: r.n)] == [i for _, _, i in expected]
    assert sorted(r.n for r in got) == list(range(7, 7 + len(values)))
    assert ordering.with_ordinal(frame.limit(0), ["v"], "n").count() == 0


def test_a_common_prefix_fills_many_ranges(spark):
    texts = spark.range(20_000).select(F.concat(F.lit("prefix " * 10), F.lpad("id", 8, "0")).alias("v"))
    sizes = [r.n for r in ordering.ranged(texts, ["v"], 8).groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 20_000 / 4
    order = {r.value: r.ordinal for r in text_order(texts).collect()}
    assert [order[v] for v in sorted(order)] == list(range(1, 20_001))


def brute_overlap(left, right):
    end = date(9999, 12, 31)
    return sorted((a, b) for a, (x, y) in left.items() for b, (s, t) in right.items()
                  if (x < s < (y or end)) or (s < x < (t or end)))


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(4)

    def some(n):
        out = {}
        for i in range(n):
            start = date(1960, 1, 1) + timedelta(rng.randrange(9000))
            out[i] = (start, rng.choice([None, start + timedelta(rng.choice([0, 1, 5, 90, 4000]))]))
        out[n], out[n + 1] = (date(1, 1, 1), date(9999, 12, 31)), (date(9999, 12, 30), None)  # the longest and the last
        return out

    left, right = some(60), some(60)
    frames = [spark.createDataFrame([("c", i, *v) for i, v in side.items()],
                                    f"code string, {name} int, {name}_from date, {name}_to date")
              for name, side in (("a", left), ("b", right))]
    got = intervals.overlapping(*frames, ["code"], ("a_from", "a_to"), ("b_from", "b_to"))
    assert sorted((r.a, r.b) for r in got.collect()) == brute_overlap(left, right)


def test_a_code_with_many_versions_stays_linear(spark):
    n = 30_000
    days = spark.range(n).select(
        F.lit("S").alias("scheme"), F.lit("hot").alias("code"), F.date_add(F.lit("1900-01-01").cast("date"), (
            F.col("id") * 2).cast("int")).alias("valid_from"))
    versions = days.withColumn("valid_to", F.date_add("valid_from", 2))
    moved = days.withColumn("valid_from", F.date_add("valid_from", 1)).withColumn("valid_to", F.date_add("valid_from", 1))
    assert releases.overlapping_versions(versions, versions).count() == 0
    assert releases.overlapping_versions(moved, versions).count() == n


@pytest.mark.parametrize("pieces", [10**6, 7])
def test_null_groups_are_cut_and_ranked_like_others(spark, pieces):
    frame = spark.createDataFrame([(None if i % 3 else i % 2, i) for i in range(300)], "g int, i int")
    keyed = ranking.with_group_size(frame, ["g"]).withColumn("k", hash_key("t", "i"))
    got = ranking.rank_within(keyed, ["g"], "k", ["i"], rows_per_piece=pieces)
    for group in (None, 0, 1):
        mine = sorted((r["k"], r["i"], r["rank"]) for r in got.collect() if r["g"] == group)
        assert [r for _, _, r in mine] == list(range(1, len(mine) + 1)) and len(mine) in (200, 50)


def test_files_of_any_size(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "small").write_bytes(b"abc")
    (tmp_path / "a" / "empty").write_bytes(b"")
    (tmp_path / "a" / "odd name%20é").write_bytes(b"x" * 1000)
    with open(tmp_path / "a" / "large", "wb") as file:
        file.seek((3 << 30) - 1)
        file.write(b"z")
    got = {os.path.basename(r.path): (r.sha256, r.bytes) for r in file_inventory(spark, str(tmp_path)).collect()}
    assert len(got) == 4 and got["large"][1] == 3 << 30
    assert got["large"][0] == digest(f"file:{tmp_path}/a/large")
    assert got["small"] == (hashlib.sha256(b"abc").hexdigest(), 3) and got["empty"][1] == 0
    stepped = file_inventory(spark, str(tmp_path / "a"), "[se]*", whole=0)
    assert rows(stepped.select("sha256", "bytes")) == sorted([got["small"], got["empty"]], key=repr)
