"""Published population tables, their gates and the snapshot record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginloom import schemas
from marginloom.functions.demography import (
    ADULT_AGE,
    OPEN_AGE,
    cohort_reference_year,
)
from marginloom.operators import gates, reconcile
from marginloom.plans.margins import DOMESTIC, Margins, expected_margins

VALIDATION_KEYS = ["municipality_code", "kind", "sex", "category"]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project to the declared columns of a public table; absent columns become NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.PUBLIC[table].fields])


def published_persons(persons: DataFrame, snapshot_id: int, reference: str) -> DataFrame:
    cohort = cohort_reference_year(reference)
    age = F.coalesce(F.lit(cohort) - F.col("birth_year"), F.lit(OPEN_AGE))
    return conform(persons.select(
        "*", F.lit(snapshot_id).alias("snapshot_id"),
        F.col("municipality").cast("int").alias("municipality_code"),
        F.lit(reference).cast("date").alias("reference_date"), age.alias("age"),
        F.col("birth_year").isNull().alias("age_is_lower_bound")), "population_persons")


def published_households(households: DataFrame, snapshot_id: int) -> DataFrame:
    return conform(households.select(
        "*", F.lit(snapshot_id).alias("snapshot_id"),
        F.col("municipality").cast("int").alias("municipality_code")), "population_households")


def municipalities(margins: Margins, snapshot_id: int, names: DataFrame | None = None,
                   points: DataFrame | None = None) -> DataFrame:
    """Reference table with totals; names(municipality, name, province_name, region_name) and
    points(municipality, geometry, longitude, latitude) are joined when given."""
    people = margins.demography.groupBy("municipality").agg(F.sum("n").alias("persons"))
    homes = margins.households.groupBy("municipality").agg(F.sum("n").alias("households"))
    df = margins.locality.join(people, "municipality", "left").join(
        homes, "municipality", "left").fillna(0, ["persons", "households"])
    for extra in (names, points):
        if extra is not None:
            df = df.join(extra, "municipality", "left")
    return conform(df.select(
        "*", F.lit(snapshot_id).alias("snapshot_id"),
        F.col("municipality").cast("int").alias("code"),
        F.col("province").cast("short").alias("province_code"),
        F.col("region").cast("short").alias("region_code")), "population_municipalities")


def provinces(places: DataFrame, source_sha256: str | None = None) -> DataFrame:
    df = places.groupBy("snapshot_id", F.col("province_code").alias("code")).agg(
        F.min("region_code").alias("region_code"), F.min("province_name").alias("name"))
    return conform(df.withColumn("source_sha256", F.lit(source_sha256)), "population_provinces")


def regions(places: DataFrame) -> DataFrame:
    df = places.groupBy("snapshot_id", F.col("region_code").alias("code")).agg(
        F.min("region_name").alias("name"))
    return conform(df, "population_regions")


def population_cells(persons: DataFrame, places: DataFrame) -> DataFrame:
    """Counts first, geography after: the join touches cells, never persons."""
    keys = ["snapshot_id", "municipality_code"]
    counted = persons.groupBy(*keys, "sex", "age", "citizenship_code").agg(
        F.count(F.lit(1)).alias("persons"))
    geography = places.select(
        "snapshot_id", F.col("code").alias("municipality_code"), "region_code", "province_code")
    return conform(counted.join(geography, keys), "population_cells")


def actual_margins(cells: DataFrame, households: DataFrame,
                   domestic: str = DOMESTIC) -> DataFrame:
    """The four kinds of margins from the published cells and households."""
    keys = ["snapshot_id", "municipality_code"]
    columns = [*keys, "kind", "sex", "category", "n"]

    def kind(df: DataFrame, name: str, category: str) -> DataFrame:
        return df.groupBy(*keys, "sex", F.col(category).cast("int").alias("category")).agg(
            F.sum("persons").cast("long").alias("n")
        ).withColumn("kind", F.lit(name)).select(*columns)

    foreign = cells.filter(F.col("citizenship_code") != int(domestic))
    sizes = households.withColumn("sex", F.lit("*")).withColumn("persons", F.lit(1))
    return (
        kind(cells, "sex_age", "age")
        .unionByName(kind(foreign, "foreign_age", "age"))
        .unionByName(kind(cells, "citizenship", "citizenship_code"))
        .unionByName(kind(sizes, "household_size", "size"))
    )


def population_validation(margins: Margins, cells: DataFrame, households: DataFrame,
                          snapshot_id: int) -> DataFrame:
    expected = expected_margins(margins).withColumn(
        "municipality_code", F.col("municipality").cast("int"))
    actual = actual_margins(cells, households).filter(F.col("snapshot_id") == snapshot_id)
    compared = reconcile.compare_margins(expected, actual, VALIDATION_KEYS)
    return conform(compared.withColumn("snapshot_id", F.lit(snapshot_id)),
                   "population_validation")


def invalid_identities(df: DataFrame, identity: str) -> DataFrame:
    return df.groupBy(identity).agg(F.count(F.lit(1)).alias("copies")).filter(
        (F.col("copies") != 1) | F.col(identity).isNull() | (F.col(identity) < 1))


def invalid_persons(persons: DataFrame, places: DataFrame, reference: str) -> DataFrame:
    """Persons that violate geography, domains, cohort arithmetic or the housing rules."""
    cohort = cohort_reference_year(reference)
    known = places.select("snapshot_id", F.col("code").alias("municipality_code"),
                          F.lit(True).alias("_known"))
    by, upper, age = (F.col(c) for c in ("birth_year", "birth_year_upper_bound", "age"))
    reference_day = F.lit(reference).cast("date")
    bad = (
        F.col("_known").isNull() | F.col("sex").isNull() | ~F.col("sex").isin("M", "F")
        | age.isNull() | ~age.between(0, OPEN_AGE)
        | F.col("citizenship_code").isNull() | ~F.col("citizenship_code").between(1, 999)
        | F.col("reference_adult").isNull()
        | ~F.col("reference_date").eqNullSafe(reference_day)
        | ~F.col("data_kind").eqNullSafe("synthetic")
        | ~F.col("age_is_lower_bound").eqNullSafe(by.isNull())
        | (by.isNull() == upper.isNull())
        | (upper.isNotNull() & ((age != OPEN_AGE) | (upper != cohort - OPEN_AGE)))
        | (by.isNotNull() & ((age != F.lit(cohort) - by) | (age >= OPEN_AGE)))
        | (F.col("household_id").isNull() & ((age < ADULT_AGE) | F.col("reference_adult")))
    )
    joined = persons.join(known, ["snapshot_id", "municipality_code"], "left")
    return joined.filter(F.coalesce(bad, F.lit(True))).drop("_known")


def invalid_households(persons: DataFrame, households: DataFrame) -> DataFrame:
    members = persons.filter(F.col("household_id").isNotNull()).groupBy("household_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("municipality_code").alias("lo"),
        F.max("municipality_code").alias("hi"), F.count_if("reference_adult").alias("refs"),
        F.count_if(F.col("reference_adult") & (F.col("age") < ADULT_AGE)).alias("minors"))
    left = households.select("household_id", "size", "municipality_code", "data_kind",
                             F.lit(True).alias("_h"))
    bad = (
        F.col("_h").isNull() | F.col("n").isNull() | F.col("size").isNull()
        | (F.col("size") != F.col("n")) | F.col("municipality_code").isNull()
        | (F.col("municipality_code") != F.col("lo"))
        | ~F.col("data_kind").eqNullSafe("synthetic") | (F.col("lo") != F.col("hi"))
        | (F.col("refs") != 1) | (F.col("minors") != 0)
    )
    return left.join(members, "household_id", "full").filter(
        F.coalesce(bad, F.lit(True))).drop("_h")


def publication_gates(persons: DataFrame, households: DataFrame, places: DataFrame,
                      validation: DataFrame, margins: Margins, reference: str) -> gates.Gates:
    found = gates.Gates()
    found.empty("person_identity", invalid_identities(persons, "person_id"))
    found.empty("household_identity", invalid_identities(households, "household_id"))
    found.empty("persons_valid", invalid_persons(persons, places, reference))
    found.empty("household_relationships", invalid_households(persons, households))
    found.rows(validation, zero_error=F.col("expected") != F.col("actual"))
    for name, df, source in (("person_total", persons, margins.demography),
                             ("household_total", households, margins.households)):
        counts = reconcile.attach_scalars(df.agg(F.count(F.lit(1)).alias("actual")),
                                          source.agg(F.sum("n").alias("expected")))
        found.rows(counts, **{name: F.col("actual") != F.coalesce("expected", F.lit(0))})
    return found


def provenance(contract: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per source of a contract(name, url, sha256, bytes) that the evidence confirms."""
    keys = ["sha256", "url"]
    return contract.join(evidence.select(*keys, "retrieved_at").distinct(), keys, "left").select(
        "name", "url", "sha256", "bytes", "retrieved_at",
        F.col("retrieved_at").isNotNull().alias("confirmed"))


def snapshot_record(report: DataFrame, snapshot_id: int, run_id: str, manifest_sha256: str,
                    reference: str, household_reference: str, is_fixture: bool,
                    provenance_rows: DataFrame, checks: DataFrame) -> DataFrame:
    """The snapshot row: report, provenance and checks as JSON of one-row frames."""
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias(name))

    df = report.select("persons", "households", "municipalities",
                       F.to_json(F.struct(*report.columns)).alias("report"))
    df = reconcile.attach_scalars(df, one(provenance_rows, "provenance"))
    df = reconcile.attach_scalars(df, one(checks, "publication_checks"))
    return conform(df.select(
        "*", F.lit(snapshot_id).alias("id"), F.lit(run_id).alias("run_id"),
        F.lit(manifest_sha256).alias("manifest_sha256"), F.lit(reference).alias("reference_date"),
        F.lit(household_reference).alias("household_reference"),
        F.lit(is_fixture).alias("is_fixture"), F.current_timestamp().alias("published_at"),
        F.lit("synthetic").alias("data_kind"), F.lit(0).alias("located_persons")),
        "population_snapshots")


def refuse_fixture(is_fixture: bool, allow_fixture: bool) -> None:
    if is_fixture and not allow_fixture:
        raise ValueError("Only populations from official aggregates are published")
