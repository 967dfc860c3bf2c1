"""Plans whose driver memory or time must not grow faster than the input."""

from __future__ import annotations

import pytest
from fixtures import REFERENCE, margins
from pyspark.sql import functions as F

from marginloom import registry, session
from marginloom.operators import intervals
from marginloom.plans import audit, releases, run, star, synthesize
from marginloom.plans.margins import Cells
from marginloom.registry import audit as registered
from marginloom.session import materialize, materialize_all
from marginloom.sources.sinks import write_sorted


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def homes(spark):
    place = [F.lit(text).alias(name) for name, text in zip(audit.PLACE, ("000001", "001", "01"))]
    members = spark.range(1, 401).select(
        *place, F.col("id").alias("household_id"), F.lit(2).cast("long").alias("n"), F.lit(1).cast("long").alias("refs"),
        F.lit(2).cast("long").alias("adults"))
    households = spark.range(1, 400).select(
        F.col("id").alias("household_id"), *place, F.when(F.col("id") == 7, 3).otherwise(2).cast("short").alias("size"))
    return materialize(members, "members"), materialize(households, "households")


def test_audit_never_broadcasts_members_or_households(homes):
    """Their files are small at any size that compresses well, their rows are not."""
    broken, orphans = audit.counted_families(*homes)
    assert "Broadcast" not in plan(broken) + plan(orphans)
    assert [r.household_id for r in broken.collect()] == [7]
    assert [r.household_id for r in orphans.collect()] == [400]


def test_customers_and_orders_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(star.placed_orders(spark, "/root/testdata/sf0.001"))


def test_points_take_only_sizes_that_fit_into_the_longest_interval(spark):
    """Overlaps agree with a comparison of all pairs, and a day is not multiplied by sizes that no interval has."""
    rows = [("a", i % 3, f"2000-01-{1 + i * 5 % 28:02d}", length) for i, length in enumerate((1, 2, 3, 4, 7, 8, 9, 16, 0, -2) * 4)]
    df = spark.createDataFrame(rows, "s string, k int, d string, n int").select(
        "s", "k", F.col("d").cast("date").alias("a"), F.expr("date_add(cast(d as date), n)").alias("b"))
    other = df.select("s", "k", F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    open_ended = other.withColumn("y", F.when(F.dayofmonth("x") != 11, F.col("y")))
    for right in (other, open_ended):
        end = F.coalesce("y", F.lit("9999-12-31").cast("date"))
        expected = df.join(right, ["s", "k"]).filter(
            ((F.col("x") < F.col("a")) & (F.col("a") < end)) | ((F.col("a") < F.col("x")) & (F.col("x") < F.col("b"))))
        found = intervals.overlapping(df, right, ["s", "k"], ("a", "b"), ("x", "y"))
        assert sorted(map(tuple, found.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))
        assert found.count() > 0
    longest = intervals._top_level(F.lit(120))
    assert intervals.with_cells(df, ["s", "k"], "a", longest).count() == 7 * df.count()
    tops = spark.range(-1, 1025).select("id", intervals._top_level(F.col("id")).alias("top")).collect()
    assert all(r.top == (r.id.bit_length() - 1 if r.id > 0 else None) for r in tops)


def test_manifest_of_a_run_is_the_sum_of_its_batches(spark):
    """A run's tables are digested once, batch by batch."""
    tables = {"a": spark.range(100).selectExpr("id", "id % 3 as province"),
              "b": spark.range(10).selectExpr("id * 7 as id", "id % 2 as province")}
    batches = run.batch_manifest(tables, "province").select("province", "table", "rows", "content")
    batches = batches.unionByName(batches)  # a batch recorded twice counts once
    assert releases.manifest_mismatches(run.recorded_manifest(batches), tables).isEmpty()
    assert dict(run.recorded_manifest(batches).dtypes) == dict(releases.table_manifest(tables).dtypes)


def test_margins_read_lines_once_and_count_every_order(spark, tmp_path):
    """An order keeps its size if the supplier of a line is unknown; that line is in no cell."""
    lines = [(1, 10, "O", 5.0), (1, 99, "O", 5.0), (2, 10, "F", 60.0), *[(3, 10, "F", 60.0)] * 8, (4, 10, "O", 5.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linestatus string, l_quantity double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "o_orderkey long, o_custkey long").write.parquet(
        f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 1), (8, 2)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 0), (2, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    found = star.margins(spark, str(tmp_path))
    assert sorted(map(tuple, found.households.collect())) == [("000001", 1, 1), ("000001", 2, 1), ("000002", 6, 1)]
    assert sorted(map(tuple, found.countries.select("municipality", "sex", "code", "n").collect())) == [
        ("000001", "F", "100", 1), ("000001", "M", "100", 1), ("000002", "F", "201", 8)]
    assert plan(star.counted_lines(spark, str(tmp_path))).count("ReadSchema: struct<l_orderkey") == 1


def test_publication_gates_write_persons_once(spark, monkeypatch):
    """Damage is a projection of stored tables; another stored copy only adds to what is written."""
    written = []
    monkeypatch.setattr(registered, "materialize_all", lambda **frames: written.extend(frames) or materialize_all(**frames))
    assert registered.publication_gates(spark, "/root/testdata/sf0.001").count() == 7
    assert sorted(written) == ["households", "individuals"]


def test_queries_store_only_what_they_read_more_than_once(spark, monkeypatch):
    """Reference tables need no persons, and a package of counted cells generates them once."""
    written = []
    folder = session.work_folder
    monkeypatch.setattr(session, "work_folder", lambda spark, purpose: written.append(purpose) or folder(spark, purpose))
    expected = {"municipalities_page": ["counted"], "map_regions": ["counted"],
                "suppressed_package": ["counted", "countries", "drawn", "households", "persons", "region_cells"],
                "distribution": ["counted", "countries", "drawn", "households", "persons"]}
    registry.load()
    for name, tables in expected.items():
        written.clear()
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        assert sorted(written) == tables


def test_the_draw_moves_no_expanded_person(spark, monkeypatch):
    """Persons of a cell are expanded together, so the window of the draw needs no further exchange."""
    plans = []
    monkeypatch.setattr(synthesize, "materialize", lambda df, purpose: plans.append(plan(df)) or materialize(df, purpose))
    cells = Cells.build(margins(spark))
    assert synthesize.individuals(cells, REFERENCE).count() == 60
    assert len(plans) == 1 and plans[0].count("Window [") == 1 and plans[0].count("Exchange hashpartitioning") == 1


def test_a_manifest_makes_no_decimal_for_each_row(spark):
    """Digests are summed as two longs; the sum is that of 60 bits of each row's sha256, as before."""
    df = spark.range(500).selectExpr("id", "id % 3 as province", "if(id % 7 = 0, null, concat('\"', id)) as t")
    digest = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    bits = sum(int(r.d[:15], 16) for r in df.select(digest.alias("d")).collect())
    manifest = releases.table_manifest({"t": df})
    assert [tuple(r) for r in manifest.collect()] == [("t", 500, str(bits))]
    assert "decimal(38,0)" not in plan(manifest) and releases.table_manifest({"t": df.limit(0)}).first().content == "0"


def test_the_report_of_a_run_is_read_from_its_profile(spark):
    m = margins(spark)
    cells = Cells.build(m)
    persons = materialize(synthesize.assign_households(synthesize.individuals(cells, REFERENCE), cells, REFERENCE), "persons")
    homes = materialize(synthesize.households(cells), "households")
    profile = audit.person_profile(persons, m, REFERENCE)
    assert audit.profile_summary(profile, homes, m).collect() == audit.summary(persons, homes, m, REFERENCE).collect()


def test_pairs_move_hashes_and_count_like_a_full_join(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(audit, "materialize", lambda df, purpose: plans.append(plan(df)) or materialize(df, purpose))
    shape = "person_id long, y short, u short, t string"
    before = spark.createDataFrame([(1, 1923, None, "a"), (2, 5, 6, "b"), (3, 1, 1, "c"), (3, 1, 1, "c"), (5, 1, 1, "e"),
                                    (None, 1, 1, "n"), (7, 2, 2, None)], shape)
    after = spark.createDataFrame([(1, None, 1923, "a"), (2, 5, 6, "b"), (3, 1, 1, "c"), (3, 1, 2, "c"), (6, 1, 1, "e"),
                                   (None, 1, 1, "n"), (7, 2, 2, None)], shape)
    found = audit.paired(before, after).first()
    assert (found.changed, found.distinct_before, found.distinct_after) == (7, 6, 6)
    assert "SortMergeJoin" not in plans[0]


def test_blocks_of_ids_are_written_without_a_sample(spark, tmp_path):
    df = spark.range(250_000).selectExpr("id", "cast(id div 150000 as string) as p")
    write_sorted(df, f"{tmp_path}/t", ["id"], ["p"], dense_id="id")
    files = spark.read.parquet(f"{tmp_path}/t").select("id", F.input_file_name().alias("f"))
    assert files.count() == 250_000 and files.select("f").distinct().count() <= 4
    assert files.groupBy("f").agg(F.max("id") - F.min("id")).count() >= 2
