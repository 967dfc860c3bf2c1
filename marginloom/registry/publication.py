"""Stored runs: resumed, verified and published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.plans import publication, run, star
from marginloom.registry import query
from marginloom.registry.sql import PERSONS, PUBLISHED
from marginloom.session import materialize, work_folder
from marginloom.sources import commits

BATCHES = """SELECT province, 'individuals' AS "table", count(*) AS rows FROM individuals GROUP BY ALL
  UNION ALL SELECT province, 'persons', count(*) FROM persons GROUP BY ALL
  UNION ALL SELECT province, 'households', count(*) FROM dwellings GROUP BY ALL"""


def stored_run(spark: SparkSession, folder: str, interrupted: bool = False):
    """A run over the margins of the star schema; interrupted, it is made in two calls."""
    m, root = star.margins(spark, folder), work_folder(spark, "runs")
    if interrupted:
        run.run(spark, m, star.REFERENCE, root, provinces=["000", "003"])
    return m, run.run(spark, m, star.REFERENCE, root)


@query(PERSONS + " SELECT *, CAST(1 AS BIGINT) AS times FROM (" + BATCHES + ")")
def resumed_run(spark: SparkSession, folder: str) -> DataFrame:
    """What is recorded for every batch of a run that was interrupted after two of them."""
    _, result = stored_run(spark, folder, True)
    return run.completed(spark, result.path).groupBy("province", "table").agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("times"))


@query(PERSONS + """ SELECT province, 'persons' AS "table", count(*) AS rows,
    count(*) FILTER (person_id % 50 <> 7) AS found_rows
  FROM persons WHERE province = '002' GROUP BY ALL HAVING rows <> found_rows""")
def verified_run(spark: SparkSession, folder: str) -> DataFrame:
    """The batches whose stored tables are not what was recorded, after one has lost rows."""
    _, result = stored_run(spark, folder)
    left = materialize(result.persons.filter("province = '002' and person_id % 50 <> 7").drop("province"), "left")
    left.write.mode("overwrite").parquet(f"{result.path}/persons/province=002")
    return run.damaged_batches(spark, result.path)


@query(PUBLISHED + """ SELECT "table", rows, CAST(1 AS BIGINT) AS commits, CAST(0 AS BIGINT) AS abandoned FROM (
  SELECT 'population_persons' AS "table", count(*) AS rows FROM population_persons
  UNION ALL SELECT 'population_households', count(*) FROM population_households
  UNION ALL SELECT 'population_municipalities', count(*) FROM places
  UNION ALL SELECT 'population_provinces', count(DISTINCT province_code) FROM places
  UNION ALL SELECT 'population_regions', count(DISTINCT region_code) FROM places
  UNION ALL SELECT 'population_cells', count(*) FROM population_cells
  UNION ALL SELECT 'population_validation', count(*) FROM population_validation
  UNION ALL SELECT 'population_snapshots', 1)""")
def publish_population(spark: SparkSession, folder: str) -> DataFrame:
    """A run published twice: the rows that readers find, and how often it was written."""
    m, result = stored_run(spark, folder)
    root = work_folder(spark, "published")
    for _ in range(2):
        release = publication.publish_population(
            spark, root, result, m, star.REFERENCE, "2023-12-31", is_fixture=True, allow_fixture=True)
    found = commits.commits(spark, root).filter(F.col("release") == release)
    return found.select(F.explode("tables").alias("t")).select(
        "t.table", "t.rows", F.lit(spark.read.schema(commits.COMMITS).json(f"{root}/commits").count())
        .cast("long").alias("commits"), F.lit(len(commits.abandoned(spark, root))).cast("long").alias("abandoned"))
