"""Paging, read queries, releases and text order."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from fixtures import rows
from pyspark.sql import functions as F

from marginloom.operators import paging
from marginloom.operators.gates import set_difference
from marginloom.operators.reconcile import compare_margins, hierarchy_margins, row_diff
from marginloom.plans import queries as Q
from marginloom.plans import releases as R

VALUES = [(1, Decimal("0.000000"), "demo"), (2, None, "missing"),
          (3, Decimal("1.234567"), "estimated")]


@pytest.fixture(scope="module")
def observations(spark):
    day = date(2024, 1, 1)
    data = [("r", "s", i, f"c{i}", f"Näme {i}", day, v, status, "municipality", "R1")
            for i, v, status in VALUES]
    return spark.createDataFrame(
        data, "release_id string, series_code string, territory_id long, territory_code string, "
        "territory_name string, period date, value decimal(20,6), status string, level string, "
        "parent_code string")


@pytest.mark.parametrize("direction,expected", [("asc", [1, 3, 2]), ("desc", [3, 1, 2])])
def test_nulls_come_last_both_ways(observations, direction, expected):
    page = Q.observation_table(observations, "r", "s", "2024-01-01", sort_by="value",
                               direction=direction)
    assert [r.territory_id for r in page.collect()] == expected
    assert page.filter("territory_id = 3").first().value == Decimal("1.234567")


def test_pages_of_one_equal_the_whole_list(spark):
    df = spark.createDataFrame([(i, (i * 7) % 4 or None) for i in range(1, 8)], "id long, v int")
    for direction in ("asc", "desc"):
        whole = [r.id for r in paging.keyset_page(df, "v", "id", direction).collect()]
        seen, after = [], None
        while True:
            got = paging.keyset_page(df, "v", "id", direction, after, 2).collect()
            page, after = paging.next_cursor(got, 1, "id")
            seen += [r.id for r in page]
            if after is None:
                break
        assert seen == whole


def test_unknown_anchor_gives_an_empty_page(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id long, v int")
    assert paging.keyset_page(df, "v", "id", after=99).count() == 0
    assert [r.id for r in paging.keyset_page(df, "v", "id", after=1).collect()] == [2]
    assert paging.keyset_page(df, "v", "id", after=2).count() == 0


def test_search_is_literal_and_ignores_case(observations):
    def found(text):
        return Q.observation_table(observations, "r", "s", "2024-01-01", search=text).count()

    assert (found("näme 1"), found("C2"), found("%"), found("_")) == (1, 1, 0, 0)


def test_status_order_follows_the_label(observations):
    page = Q.observation_table(observations, "r", "s", "2024-01-01", sort_by="status")
    assert [r.status for r in page.collect()] == ["demo", "missing", "estimated"]


@pytest.mark.parametrize("call", [
    lambda t: Q.persons(t, 1, "12"), lambda t: Q.persons(t, 1, "000001", age_min=5, age_max=4),
    lambda t: Q.persons(t, 1, "000001", age_max=101), lambda t: Q.persons(t, 1, "000001", limit=0),
    lambda t: Q.persons(t, 1, "000001", sort_by="name"),
    lambda t: Q.households(t, 1, "000001", direction="up"),
    lambda t: Q.comparison(t, 1, "000001", "other"), lambda t: Q.distribution(t, 1, region="1")])
def test_invalid_arguments(observations, call):
    with pytest.raises(ValueError):
        call(observations)


def test_text_order_is_binary(spark):
    a = spark.createDataFrame([("b",), ("Z",), (None,)], "x string")
    b = spark.createDataFrame([("b",), ("é",), ("a",)], "x string")
    assert rows(paging.text_order(a, b)) == [("Z", 1), ("a", 2), ("b", 3), ("é", 4)]


def test_crosswalk_and_coverage_pages(spark):
    table = spark.createDataFrame(
        [(1, "r", "merger", "exact", "b"), (2, "r", "split", "structural", "a"),
         (3, "q", "split", "structural", "c")],
        "id long, release_id string, kind string, weight_basis string, from_code string")
    assert [r.id for r in Q.crosswalks(table, "r", sort_by="from_code").collect()] == [2, 1]
    assert Q.crosswalks(table, "r", kind="merger").count() == 1


RELEASE = ("id string, dataset_id string, reference_period date, published_at timestamp, "
           "supersedes_release_id string, revision_reason string")
DAY = date(2024, 1, 1)


def release(name, hour, supersedes=None, reason=None):
    return (name, "d", DAY, datetime(2024, 2, 1, hour), supersedes, reason)


@pytest.mark.parametrize("new,conflict", [
    (release("c", 3, "b", "fixed"), False), (release("c", 3, "a", "fixed"), True),
    (release("c", 3, "b", " "), True), (release("c", 3, "b"), True), (release("c", 3), True),
    (("c", "e", DAY, datetime(2024, 2, 1), None, None), False),
    (("c", "e", DAY, datetime(2024, 2, 1), None, "why"), True)])
def test_revisions_name_the_current_predecessor(spark, new, conflict):
    stored = spark.createDataFrame([release("a", 1), release("b", 2, "a", "r")], RELEASE)
    frame = spark.createDataFrame([new], RELEASE)
    assert (R.revision_conflicts(frame, stored).count() == 1) is conflict


def test_publishing_twice_adds_nothing(spark):
    stored = spark.createDataFrame([release("a", 1), release("b", 2, "a", "r")], RELEASE)
    assert R.unpublished(stored, stored, ["id"]).count() == 0
    assert rows(R.latest_releases(stored).select("id")) == [("b",)]
    chain = R.supersession(stored)
    assert rows(chain.select("id", "superseded_by", "is_current")) == [
        ("a", "b", False), ("b", None, True)]


def test_release_diff_tells_null_from_missing(spark):
    schema = "k string, value int"
    before = spark.createDataFrame([("a", 1), ("b", None), ("c", 3), ("d", None)], schema)
    after = spark.createDataFrame([("a", 2), ("b", None), ("c", 3), ("e", None)], schema)
    assert rows(R.release_diff(before, after, ["k"])) == [("a", 1, 2), ("d", None, None),
                                                           ("e", None, None)]


def test_manifest_ignores_order_and_sees_changes(spark):
    df = spark.range(50).withColumn("v", F.when(F.col("id") > 10, F.col("id")))
    manifest = R.table_manifest({"t": df})
    assert R.manifest_mismatches(manifest, {"t": df.orderBy(F.desc("id"))}).count() == 0
    assert R.manifest_mismatches(manifest, {"t": df.fillna(0)}).count() == 1
    assert R.manifest_mismatches(manifest, {"t": df.unionByName(df.limit(1))}).count() == 1


def test_reconciliation_helpers(spark):
    schema = "k string, n long"
    left = spark.createDataFrame([("a", 1), ("b", 0)], schema)
    right = spark.createDataFrame([("a", 2), ("c", 5)], schema)
    assert rows(compare_margins(left, right, ["k"])) == [("a", 1, 2), ("b", 0, 0), ("c", 0, 5)]
    assert rows(set_difference(left, right, ["k"])) == [("b", "left"), ("c", "right")]
    changed = row_diff(left, left.withColumn("n", F.nullif("n", F.lit(0))), ["k"], ["n"])
    assert [r.k for r in changed.collect()] == ["b"]


def test_hierarchy_in_one_pass(spark):
    cells = spark.createDataFrame([("a", "p", 1, 2), ("b", "p", 1, 3), ("c", "q", 2, 4)],
                                  "m string, p string, k int, n long")
    found = hierarchy_margins(cells, [["m"], ["p"], []], ["k"])
    assert rows(found.filter("level = 1").select("p", "k", "n")) == [("p", 1, 5), ("q", 2, 4)]
    assert rows(found.filter("level = 2").select("k", "n")) == [(1, 5), (2, 4)]
