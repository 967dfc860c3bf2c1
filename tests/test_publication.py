"""Published tables, snapshot records, catalog rows and fixtures that must not be published."""

from __future__ import annotations

import json
from datetime import date

import pytest
from fixtures import REFERENCE, margins, rows
from pyspark.sql import functions as F

from marginloom import schemas
from marginloom.operators.gates import schema_matches
from marginloom.plans import audit, publish, queries, synthesize
from marginloom.plans import releases as R
from marginloom.plans.margins import Cells
from marginloom.session import materialize


@pytest.fixture(scope="module")
def published(spark):
    m = margins(spark)
    cells = Cells.build(m)
    people = materialize(synthesize.individuals(cells, REFERENCE), "i")
    persons = materialize(synthesize.assign_households(people, cells, REFERENCE), "p")
    homes = materialize(synthesize.households(cells), "h")
    names = m.locality.select(
        "municipality", F.concat(F.lit("Comune "), "municipality").alias("name"),
        F.lit("P").alias("province_name"), F.lit("R").alias("region_name"))
    places = publish.municipalities(m, 1, names)
    tables = {"population_persons": publish.published_persons(persons, 1, REFERENCE),
              "population_households": publish.published_households(homes, 1),
              "population_municipalities": places,
              "population_provinces": publish.provinces(places, "0" * 64),
              "population_regions": publish.regions(places)}
    tables["population_cells"] = publish.population_cells(tables["population_persons"], places)
    tables["population_validation"] = publish.population_validation(
        m, tables["population_cells"], tables["population_households"], 1)
    stored = {name: materialize(df, name) for name, df in tables.items()}
    return m, persons, homes, stored


def check(published, failed, **changes):
    m, _, _, tables = published
    used = {**tables, **changes}
    return failed(publish.publication_gates(
        used["population_persons"], used["population_households"],
        used["population_municipalities"], used["population_validation"], m, REFERENCE))


def test_tables_have_their_declared_schema(published, failed):
    for name, df in published[3].items():
        assert schema_matches(df, schemas.PUBLIC[name]), name
    assert check(published, failed) == set()


@pytest.mark.parametrize("column,value,gate", [
    ("sex", "X", "persons_valid"), ("age", 99, "persons_valid"),
    ("citizenship_code", 0, "persons_valid"), ("municipality_code", 5, "persons_valid"),
    ("reference_date", date(2020, 1, 1), "persons_valid"), ("person_id", 2, "person_identity"),
    ("age_is_lower_bound", None, "persons_valid"), ("data_kind", "real", "persons_valid"),
    ("household_id", None, "household_relationships")])
def test_damaged_published_persons(published, failed, column, value, gate):
    people = published[3]["population_persons"]
    first = people.filter("household_id is not null").agg(F.min("person_id")).first()[0]
    if column == "person_id":
        value = first + 1
    broken = people.withColumn(column, F.when(F.col("person_id") == first, F.lit(value)).otherwise(
        F.col(column)).cast(people.schema[column].dataType))
    assert gate in check(published, failed, population_persons=broken)


def test_validation_reads_zero_error_and_zeros_are_kept(published):
    summary = queries.validation(published[3]["population_validation"], 1)
    found = {r.kind: (r.cells, r.mismatched_cells, r.max_absolute_error) for r in summary.collect()}
    assert found == {"sex_age": (606, 0, 0), "foreign_age": (606, 0, 0),
                     "citizenship": (18, 0, 0), "household_size": (18, 0, 0)}


def test_read_queries(published):
    tables = published[3]
    spread = queries.distribution(tables["population_cells"], 1, municipality="970012")
    assert rows(spread.filter("age = 3").select("age", "sex", "persons")) == [(3, "F", 4), (3, "M", 2)]
    assert queries.distribution(tables["population_cells"], 1, province="980", sex="M").agg(
        F.sum("persons")).first()[0] == 10
    home = queries.household(tables["population_households"], tables["population_persons"], 1, 1)
    assert len(home.first().members) == home.first().size
    region = queries.map_regions(tables["population_regions"],
                                 tables["population_municipalities"], 1).collect()
    assert [(r.code, r.persons, r.households) for r in region] == [("97", 40, 10), ("98", 20, 5)]
    bins = queries.age_histogram(tables["population_cells"])
    assert bins.count() == 11 and bins.filter("bin = 10").first().label == "100+"
    towns = queries.territory_list(tables["population_municipalities"], search="970")
    assert towns.count() == 2


def test_snapshot_record(spark, published):
    m, persons, homes, _ = published
    report = audit.summary(persons, homes, m, REFERENCE)
    contract = spark.createDataFrame([("a", "urn:a", "1" * 64, 5), ("b", "urn:b", "2" * 64, 6)],
                                     "name string, url string, sha256 string, bytes long")
    evidence = spark.createDataFrame([("a", "p", "1" * 64, "urn:a", "2024")], schemas.EVIDENCE)
    sources = publish.provenance(contract, evidence)
    assert rows(sources.select("name", "confirmed")) == [("a", True), ("b", False)]
    checks = audit.record_gates(persons, homes, m, REFERENCE).frame()
    record = publish.snapshot_record(report, 1, "run", "3" * 64, REFERENCE, "2024-12-31", True,
                                     sources, checks)
    assert schema_matches(record, schemas.PUBLIC["population_snapshots"])
    row = record.first()
    assert (row.persons, row.households, row.municipalities) == (60, 15, 3)
    assert json.loads(row.report)["unassigned_adults"] == 60 - 3 * 14
    assert {p["name"] for p in json.loads(row.provenance)} == {"a", "b"}
    assert all(c["passed"] for c in json.loads(row.publication_checks))
    assert queries.snapshots(record, 5).columns == [
        c for c in record.columns if c not in ("report", "provenance", "publication_checks")]


def test_fixtures_are_refused_unless_allowed():
    publish.refuse_fixture(True, allow_fixture=True)
    publish.refuse_fixture(False, allow_fixture=False)
    with pytest.raises(ValueError):
        publish.refuse_fixture(True, allow_fixture=False)


def test_catalog_rows(spark):
    demo = spark.createDataFrame(
        [("DEMO002", "Due", date(2025, 1, 1), 5), ("DEMO001", "Uno", date(2025, 1, 1), 7)],
        "territory_code string, territory_name string, period date, population long")
    loaded = R.demo_observations(demo, "r", "DEMO")
    assert schema_matches(loaded, schemas.PUBLIC["observations_v2"])
    assert rows(loaded.select("territory_id", "territory_code")) == [(1, "DEMO001"), (2, "DEMO002")]
    regional = R.regional_observations(demo.withColumn("level", F.lit("region")), "r", "S", "s",
                                       "persons", first_id=10)
    assert rows(regional.select("territory_id", "parent_code")) == [(10, "IT"), (11, "IT")]
    quality = R.quality_rows(spark.createDataFrame([("c", True)], "check_name string, passed boolean"),
                             "r")
    assert schema_matches(quality, schemas.PUBLIC["quality_v2"])
    files = spark.createDataFrame([("k", "0" * 64, 3)], "kind string, sha256 string, bytes long")
    assert schema_matches(R.artifact_rows(files, "r"), schemas.PUBLIC["artifacts_v2"])


def test_metadata_fingerprint_ignores_order(spark):
    codes = spark.createDataFrame([("L", "1"), ("L", "2")], "codelist string, code string")
    parts = spark.createDataFrame([("dimension", "A")], "kind string, id string")
    one = R.metadata_fingerprint(codes, parts).first()[0]
    assert one == R.metadata_fingerprint(codes.orderBy(F.desc("code")), parts).first()[0]
    assert one != R.metadata_fingerprint(codes.limit(1), parts).first()[0]
