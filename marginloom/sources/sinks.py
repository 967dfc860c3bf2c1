"""Sinks. A target is written only after its gates passed; nothing is updated in place."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginloom.operators.gates import Check, Gates, QualityError, schema_matches
from marginloom.plans.releases import unpublished
from marginloom.session import path_exists


ID_BLOCK = 100_000


def write_sorted(df: DataFrame, path: str, order: Sequence[str], partition_by: Sequence[str] = (),
                 files: int | None = None, dense_id: str | None = None) -> None:
    """ZSTD Parquet, range-clustered by the order so that row-group statistics prune reads.

    Range partitioning splits a dominant partition value over many files, but samples the rows, for
    which it computes them twice. `dense_id` names an id without large gaps that the order ends with: blocks of
    it are ranges that need no sample.
    """
    keys = [*partition_by, *order]
    if dense_id is not None:
        ranged = df.repartition(*partition_by, F.floor(F.col(dense_id) / ID_BLOCK))
    else:
        ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    writer = ranged.sortWithinPartitions(*keys).write.mode("overwrite").option(
        "compression", "zstd").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_checked(df: DataFrame, path: str, schema: T.StructType,
                   identity: Sequence[str] | None = None,
                   partition_by: Sequence[str] = ()) -> DataFrame:
    """Append rows that match the declared schema; with an identity, known rows are skipped."""
    if not schema_matches(df, schema):
        raise QualityError([Check("schema", False, 1)])
    new = df
    if identity and path_exists(df.sparkSession, path):
        stored = df.sparkSession.read.schema(schema).parquet(path)
        new = unpublished(df, stored, list(identity))
    writer = new.write.mode("append").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def guarded(gates: Gates, quarantine: str, spark: SparkSession) -> list[Check]:
    """Require the gates; a failure leaves a record of every check in the quarantine folder."""
    checks = gates.evaluate()
    if all(c.passed for c in checks):
        return checks
    rows = [(uuid.uuid4().hex, c.name, c.passed, c.violations) for c in checks]
    spark.createDataFrame(
        rows, "attempt string, check_name string, passed boolean, violations bigint"
    ).withColumn("recorded_at", F.current_timestamp()).coalesce(1).write.mode("append").json(
        quarantine)
    raise QualityError(checks)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)
