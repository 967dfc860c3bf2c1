"""A complete run: identity, staged tables, audit, report, resume and later verification."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom import __version__, schemas
from marginloom.functions.hashing import content_id
from marginloom.operators.gates import Check, QualityError
from marginloom.plans import audit, releases, synthesize
from marginloom.plans.margins import DOMESTIC, Cells, Margins, coherence_gates
from marginloom.session import materialize, path_exists
from marginloom.sources.sinks import guarded, write_report, write_sorted

ALGORITHM = "ordered-population/1"


@dataclass(frozen=True)
class Run:
    run_id: str
    path: str
    individuals: DataFrame
    persons: DataFrame
    households: DataFrame


def margin_tables(margins: Margins) -> dict[str, DataFrame]:
    named = {"locality": margins.locality, "demography": margins.demography,
             "households": margins.households, "foreigners": margins.foreigners,
             "countries": margins.countries}
    return {name: df for name, df in named.items() if df is not None}


def run_identity(margins: Margins, parameters: dict[str, object]) -> str:
    """Digest of the input rows (in any order), the parameters and the version of the rules."""
    text = json.dumps({"algorithm": ALGORITHM, "version": __version__, **parameters},
                      sort_keys=True)
    rows = F.concat_ws(":", "table", F.col("rows").cast("string"), "content")
    digest = releases.table_manifest(margin_tables(margins)).agg(
        content_id(F.lit(text), F.array_join(F.array_sort(F.collect_list(rows)), "|")).alias("id"))
    return digest.first()["id"]


def run(spark: SparkSession, margins: Margins, reference: str, folder: str,
        domestic: str = DOMESTIC, provinces: Sequence[str] | None = None,
        fixture: bool | None = None, max_population: int | None = None,
        sizing: synthesize.Sizing = synthesize.Sizing()) -> Run:
    """Generate, store and audit a population below `folder`/run_id=....

    Stored provinces are skipped, so an interrupted run continues where it stopped; ids are offsets
    over the whole input, so the result does not depend on how often that happened. `provinces`
    limits the work of this call. The audit and the manifest follow once every province is stored.
    """
    guarded(coherence_gates(margins, fixture, max_population, domestic),
            f"{folder}/quarantine", spark)
    run_id = run_identity(margins, {"reference": reference, "domestic": domestic})
    path = f"{folder}/run_id={run_id}"
    wanted = margins.locality.select("province").distinct()
    if provinces is not None:
        wanted = wanted.filter(F.col("province").isin(list(provinces)))
    todo = materialize(wanted.join(stored_provinces(spark, path), "province", "left_anti"), "todo")
    if not todo.isEmpty():
        _generate(margins, reference, path, domestic, todo, sizing)
        # Written after the tables: a province is finished once its digests are there.
        written = load(spark, path, margins.countries is not None)
        parts = {name: df.join(todo, "province", "left_semi").select(*df.columns)
                 for name, df in _tables(written).items()}
        batches = todo.withColumn("table", F.explode(F.array(*[F.lit(n) for n in parts])))
        digests = batches.join(batch_manifest(parts, "province"), ["province", "table"], "left").fillna(
            {"rows": 0, "content": "0"}).select("province", "table", "rows", "content")
        digests.coalesce(1).write.mode("append").parquet(f"{path}/completed")
    result = load(spark, path, margins.countries is not None)
    missing = margins.locality.select("province").distinct().join(
        stored_provinces(spark, path), "province", "left_anti")
    if missing.isEmpty():
        # The gates and the report read the same stored profile.
        profile = audit.person_profile(result.persons, margins, reference)
        guarded(audit.record_gates(result.persons, result.households, margins, reference,
                                   result.individuals, domestic, profile), f"{path}/quarantine", spark)
        write_report(audit.profile_summary(profile, result.households, margins, domestic), f"{path}/report")
        # The manifest is written last: a run without one is not finished.
        recorded_manifest(completed(spark, path)).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/manifest")
    return result


COMPLETED = "province string, table string, rows bigint, content string"


def completed(spark: SparkSession, path: str) -> DataFrame:
    """(province, table, rows, content) of the finished batches."""
    if not path_exists(spark, f"{path}/completed"):
        return spark.createDataFrame([], COMPLETED)
    return spark.read.schema(COMPLETED).parquet(f"{path}/completed")


def stored_provinces(spark: SparkSession, path: str) -> DataFrame:
    """Provinces recorded as complete; the record is written after their tables."""
    return completed(spark, path).select("province").distinct()


def batch_manifest(tables: dict[str, DataFrame], batch: str) -> DataFrame:
    """Rows and an order-free digest for each table and batch."""
    frames = [releases.manifest_of(df, batch).withColumn("table", F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, frames)


def recorded_manifest(batches: DataFrame) -> DataFrame:
    """The manifest of whole tables as the sum of their batches, without reading their rows again."""
    return batches.distinct().groupBy("table").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("content").cast("decimal(38,0)")).cast("string").alias("content"))


def damaged_batches(spark: SparkSession, path: str, with_citizenship: bool = True) -> DataFrame:
    """(province, table, rows, found_rows) where a stored batch is not what was recorded for it."""
    found = batch_manifest(_tables(load(spark, path, with_citizenship)), "province").withColumnsRenamed(
        {"rows": "found_rows", "content": "found_content"})
    both = completed(spark, path).distinct().join(found, ["province", "table"], "full").fillna(
        {"found_rows": 0, "found_content": "0"})
    same = F.col("rows").eqNullSafe(F.col("found_rows")) & F.col("content").eqNullSafe(F.col("found_content"))
    return both.filter(~same).select("province", "table", "rows", "found_rows")


def _generate(margins: Margins, reference: str, path: str, domestic: str, todo: DataFrame,
              sizing: synthesize.Sizing) -> None:
    """Write the tables of the provinces in `todo`; the others keep their files."""
    cells = Cells.build(margins, domestic)

    def only(df: DataFrame) -> DataFrame:
        return df.join(todo, "province", "left_semi")

    part = replace(cells, persons=only(cells.persons), households=only(cells.households))
    if cells.countries is not None:
        places = only(margins.locality).select("municipality")
        part = replace(part, countries=cells.countries.join(places, "municipality", "left_semi"))
    spark = cells.persons.sparkSession
    schema = _individual_schema(cells.countries is not None)
    write_sorted(synthesize.individuals(part, reference, domestic, sizing),
                 f"{path}/individuals", ["person_id"], ["province"], dense_id="person_id")
    # Households are assigned to the stored individuals: the audit can then show that stage four
    # changed nothing, and the lineage ends here.
    stored = only(spark.read.schema(schema).parquet(f"{path}/individuals"))
    write_sorted(synthesize.assign_households(stored, part, reference, sizing),
                 f"{path}/persons", ["person_id"], ["province"], dense_id="person_id")
    write_sorted(synthesize.households(part, sizing), f"{path}/households", ["household_id"],
                 ["province"], dense_id="household_id")


def load(spark: SparkSession, path: str, with_citizenship: bool = True) -> Run:
    """Stored tables in the declared column order (partition columns are read back last)."""
    def table(name: str, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{name}").select(*schema.names)

    persons = schemas.PERSONS if with_citizenship else audit.without_citizenship(schemas.PERSONS)
    return Run(path.rsplit("run_id=", 1)[-1], path,
               table("individuals", _individual_schema(with_citizenship)),
               table("persons", persons), table("households", schemas.HOUSEHOLDS))


def verify(spark: SparkSession, path: str, margins: Margins, reference: str,
           domestic: str = DOMESTIC) -> list[Check]:
    """Audit a stored run again and compare its tables with the manifest."""
    if not path_exists(spark, f"{path}/manifest"):
        raise QualityError([Check("finished", False, 1)])
    stored = load(spark, path, margins.countries is not None)
    found = audit.record_gates(stored.persons, stored.households, margins, reference,
                               stored.individuals, domestic)
    found.empty("batches", damaged_batches(spark, path, margins.countries is not None))
    manifest = spark.read.parquet(f"{path}/manifest")
    found.empty("manifest", releases.manifest_mismatches(manifest, _tables(stored)))
    return found.require()


def _tables(result: Run) -> dict[str, DataFrame]:
    return {"individuals": result.individuals, "persons": result.persons,
            "households": result.households}


def _individual_schema(with_citizenship: bool):
    return (schemas.INDIVIDUALS if with_citizenship
            else audit.without_citizenship(schemas.INDIVIDUALS))
