"""Publication of a finished population, from its stored run to tables that readers find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom import schemas
from marginloom.operators import gates
from marginloom.plans import audit, publish
from marginloom.plans.margins import DOMESTIC, Margins
from marginloom.plans.releases import table_manifest
from marginloom.plans.run import Run
from marginloom.session import path_exists
from marginloom.sources import commits

ORDER = {
    "population_persons": ["municipality_code", "person_id"],
    "population_households": ["household_id"],
    "population_cells": ["region_code", "province_code", "municipality_code"],
    "population_municipalities": ["code"],
    "population_validation": ["municipality_code", "kind"],
}


def source_digest(manifest: DataFrame) -> str:
    """Digest of the rows of a run's tables, in any order, from their manifest."""
    return manifest.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(
        ":", "table", F.col("rows").cast("string"), "content")))), 256)).first()[0]


def run_report(result: Run, source: str, margins: Margins, reference: str, domestic: str = DOMESTIC) -> DataFrame:
    """The report that the run has stored, if it is about these very rows; otherwise it is made again."""
    spark = result.persons.sparkSession
    made = audit.summary(result.persons, result.households, margins, reference, domestic=domestic)
    if not all(path_exists(spark, f"{result.path}/{name}") for name in ("manifest", "report")):
        return made
    recorded = spark.read.parquet(f"{result.path}/manifest").filter(F.col("table").isin("persons", "households"))
    return spark.read.schema(made.schema).json(f"{result.path}/report") if source_digest(recorded) == source else made


def next_snapshot(spark: SparkSession, root: str) -> int:
    """One more than the largest published snapshot; ids are in the release names."""
    numbers = commits.commits(spark, root).select(
        F.split_part("release", F.lit("-"), F.lit(-1)).try_cast("long").alias("n"))
    return numbers.agg(F.coalesce(F.max("n"), F.lit(0)) + 1).first()[0]


def published_snapshot(spark: SparkSession, root: str, run_id: str) -> str | None:
    """The release in which a run was published."""
    found = commits.commits(spark, root).filter(F.col("release").startswith(f"population-{run_id}-")).first()
    return None if found is None else found["release"]


def population_tables(result: Run, margins: Margins, reference: str, snapshot: int, names: DataFrame | None = None,
                      points: DataFrame | None = None) -> dict[str, DataFrame | Callable[[commits.Tables], DataFrame]]:
    """Tables in the order in which they are written; what is counted is counted from those written before."""
    return {
        "population_persons": publish.published_persons(result.persons, snapshot, reference),
        "population_households": publish.published_households(result.households, snapshot),
        "population_municipalities": publish.municipalities(margins, snapshot, names, points),
        "population_provinces": lambda t: publish.provinces(t["population_municipalities"]),
        "population_regions": lambda t: publish.regions(t["population_municipalities"]),
        "population_cells": lambda t: publish.population_cells(t["population_persons"], t["population_municipalities"]),
        "population_validation": lambda t: publish.population_validation(
            margins, t["population_cells"], t["population_households"], snapshot),
    }


def publish_population(spark: SparkSession, root: str, result: Run, margins: Margins, reference: str,
                       household_reference: str, names: DataFrame | None = None,
                       points: DataFrame | None = None, provenance: DataFrame | None = None,
                       is_fixture: bool = False, allow_fixture: bool = False,
                       domestic: str = DOMESTIC) -> str:
    """Publish a run as the next snapshot and give the name of its release.

    The gates read the tables as they were written, once; the snapshot row with their report is written with
    the commit. A run that is published already keeps its snapshot and nothing is written; if its
    tables have changed since, it is refused.
    """
    publish.refuse_fixture(is_fixture, allow_fixture)
    source = source_digest(table_manifest({"persons": result.persons, "households": result.households}))
    release = published_snapshot(spark, root, result.run_id)
    snapshot = next_snapshot(spark, root) if release is None else int(release.rsplit("-", 1)[1])
    release = release or f"population-{result.run_id}-{snapshot}"
    tables = population_tables(result, margins, reference, snapshot, names, points)

    def check(stored: dict[str, DataFrame]) -> gates.Gates:
        return publish.publication_gates(
            stored["population_persons"], stored["population_households"], stored["population_municipalities"],
            stored["population_validation"], margins, reference)

    if provenance is None:
        provenance = spark.createDataFrame([], "name string, url string, sha256 string, bytes long")

    def records(checks: list[gates.Check]) -> commits.Tables:
        rows = spark.createDataFrame([(c.name, c.passed, c.violations) for c in checks],
                                     "check_name string, passed boolean, violations bigint")
        return {"population_snapshots": publish.snapshot_record(
            run_report(result, source, margins, reference, domestic), snapshot, result.run_id, source, reference,
            household_reference, is_fixture, provenance, rows)}

    commits.commit_release(spark, root, release, source, tables, ORDER, check, records)
    return release


def population_table(spark: SparkSession, root: str, release: str, table: str) -> DataFrame:
    return commits.read_table(spark, root, release, table, schemas.PUBLIC[table])
