"""Damaged persons and margins: as many rows come out of the stages as go in."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

import pytest
from fixtures import REFERENCE, margins
from pyspark.sql import functions as F

from marginloom.plans import synthesize
from marginloom.plans.margins import Cells
from marginloom.plans.synthesize import Sizing
from marginloom.session import materialize

SIZINGS = [Sizing(), Sizing(chunk_rows=2, rows_per_piece=2)]


@pytest.fixture(scope="module")
def cells(spark):
    return Cells.build(margins(spark))


@pytest.fixture(scope="module")
def damaged(cells):
    """60 persons, of which four are in no cell."""
    plain = replace(cells, countries=None)
    people = synthesize.individuals(plain, REFERENCE)
    year = F.when(F.col("person_id") == 3, 1950).otherwise(F.col("birth_year")).cast("short")
    place = F.when(F.col("person_id") != 11, F.col("municipality"))
    sex = F.when(~F.col("person_id").isin(20, 21), F.col("sex"))
    return materialize(people.withColumns({"birth_year": year, "municipality": place, "sex": sex}), "damaged")


@pytest.mark.parametrize("sizing", SIZINGS)
def test_persons_without_a_cell_stay(cells, damaged, sizing):
    placed = materialize(synthesize.assign_households(damaged, cells, REFERENCE, sizing), "placed")
    got = synthesize.enrich(placed, cells, REFERENCE, sizing=sizing, status="status").collect()
    assert sorted(r.person_id for r in got) == list(range(1, 61))
    lost = [r for r in got if r.status == "no_cell"]
    assert {r.person_id for r in lost} == {3, 11, 20, 21}
    assert {(r.household_id, r.reference_adult, r.citizenship_code) for r in lost} == {(None, False, "100")}


@pytest.mark.parametrize("sizing", SIZINGS)
def test_drawn_persons_without_a_slot_stay(cells, sizing):
    fewer = replace(cells, countries=cells.countries.filter("code <> '999'").withColumn("foreign_pool", F.col("n")))
    assert synthesize.individuals(fewer, REFERENCE, sizing=sizing).count() == 60
    base = synthesize.individuals(replace(cells, countries=None), REFERENCE)
    got = synthesize.enrich(base, fewer, REFERENCE, sizing=sizing, status="status").collect()
    assert Counter((r.status, r.citizenship_code) for r in got) == {
        ("not_drawn", "100"): 45, ("drawn", "436"): 6, ("no_slot", "100"): 9}


def test_wrong_pool_sizes_lose_nobody(cells):
    wrong = replace(cells, persons=cells.persons.withColumns({
        "foreign_pool": F.lit(0).cast("long"), "pool_id": F.col("pool_id") + 1000}))
    codes = synthesize.individuals(wrong, REFERENCE).groupBy("citizenship_code").count().collect()
    assert {r[0]: r[1] for r in codes} == {"100": 45, "436": 6, "999": 9}


def test_foreigners_of_unknown_sex_stay(cells):
    unknown = replace(cells, persons=cells.persons.withColumn("sex", F.when(F.col("sex") == "F", "F")))
    assert synthesize.individuals(unknown, REFERENCE).count() == 60
