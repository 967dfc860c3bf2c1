"""Tables of a release that become readable together.

Below a root, `data/release=R/attempt=A/table` holds what an attempt wrote, and `commits` one small
file for each finished attempt. The file is written last, and Spark publishes a file by renaming it, so
a release is either whole or not there. Readers find tables through the commits only. An attempt that
fails leaves folders that nobody reads; `abandoned` lists them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginloom.operators.gates import Check, Gates, QualityError
from marginloom.plans.releases import table_manifest
from marginloom.session import path_exists
from marginloom.sources.sinks import guarded, write_sorted

COMMITS = ("release string, source string, attempt string, committed_at timestamp, "
           "tables array<struct<table:string,rows:bigint,content:string>>")


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The commit of every release. Of attempts that finished at the same time, the first one counts."""
    if not path_exists(spark, f"{root}/commits"):
        return spark.createDataFrame([], COMMITS)
    stored = spark.read.schema(COMMITS).json(f"{root}/commits")
    return stored.groupBy("release").agg(F.min_by(F.struct(*stored.columns), F.struct(
        "committed_at", "attempt")).alias("_c")).select("_c.*")


def committed(spark: SparkSession, root: str, release: str):
    return commits(spark, root).filter(F.col("release") == release).first()


def _folder(root: str, release: str, attempt: str) -> str:
    return f"{root}/data/release={release}/attempt={attempt}"


def read_table(spark: SparkSession, root: str, release: str, table: str, schema: T.StructType) -> DataFrame:
    """A table of a committed release."""
    found = committed(spark, root, release)
    if found is None or table not in {t["table"] for t in found["tables"]}:
        raise ValueError(f"Nothing is committed as {table} of {release}")
    return spark.read.schema(schema).parquet(f"{_folder(root, release, found['attempt'])}/{table}").select(
        *schema.names)


Tables = dict[str, DataFrame]


def commit_release(spark: SparkSession, root: str, release: str, source: str,
                   tables: dict[str, DataFrame | Callable[[Tables], DataFrame]],
                   order: dict[str, Sequence[str]] | None = None,
                   gates: Callable[[Tables], Gates] | None = None,
                   records: Callable[[list[Check]], Tables] | None = None):
    """Write the tables, check what was written, and commit; the commit's row.

    `source` is the digest of what the release is made from. A release that is committed already is
    not written again; another source under its name is refused. `order` sorts a table's files, so that
    their statistics prune reads. A table may be a function of those before it, as stored. `gates` get the
    tables as stored; if they fail, nothing is committed. `records` are tables made from the passed checks.
    """
    known = committed(spark, root, release)
    if known is not None:
        if known["source"] != source:
            raise QualityError([Check("release_source", False, 1)])
        return known
    attempt = uuid.uuid4().hex
    folder = _folder(root, release, attempt)
    stored = {}

    def store(name: str, df: DataFrame) -> None:
        keys = (order or {}).get(name)
        if keys:
            write_sorted(df, f"{folder}/{name}", keys)
        else:
            df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        stored[name] = spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    for name, df in tables.items():
        store(name, df(dict(stored)) if callable(df) else df)
    checks = [] if gates is None else guarded(gates(stored), f"{root}/quarantine", spark)
    for name, df in ({} if records is None else records(checks)).items():
        store(name, df)
    manifest = table_manifest(stored).agg(F.array_sort(F.collect_list(F.struct(
        "table", "rows", "content"))).alias("tables"))
    manifest.select(F.lit(release).alias("release"), F.lit(source).alias("source"), F.lit(attempt).alias("attempt"),
                    F.current_timestamp().alias("committed_at"), "tables").coalesce(1).write.mode(
        "append").json(f"{root}/commits")
    return committed(spark, root, release)


def abandoned(spark: SparkSession, root: str) -> list[str]:
    """Attempts that no commit names: they failed, or are still being written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [str(a.getPath().getName()).removeprefix("attempt=") for r in files.listStatus(path)
             for a in files.listStatus(r.getPath())]
    known = {r.attempt for r in commits(spark, root).filter(F.col("attempt").isin(found)).collect()}
    return sorted(set(found) - known)
