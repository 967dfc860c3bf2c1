"""Digests of files, and their comparison with a contract."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.operators.gates import Gates, set_difference

# Files below this size are read into a row and digested by Spark; larger ones are read in steps.
WHOLE_FILE = 64 << 20
STEP = 8 << 20


def file_inventory(spark: SparkSession, path: str, pattern: str | None = None,
                   whole: int = WHOLE_FILE) -> DataFrame:
    """(path, sha256, bytes) for every file below a folder, of any size.

    Listing does not read the files. A file of `whole` bytes or more is one row of a task that reads
    it in steps, so its size is bounded by nothing; its path must be one that Arrow can open (local,
    HDFS, S3 or GCS).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    # The filter on the length reaches the listing, so no large file is opened here.
    small = files.filter(F.col("length") < whole).select(
        "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    large = files.filter(F.col("length") >= whole).select("path", F.col("length").alias("bytes"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = batch.column(0).to_pylist(), batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest(p) for p in paths], pa.string()), sizes],
                ["path", "sha256", "bytes"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stepped = large.repartition(tasks, "path").mapInArrow(digested, "path string, sha256 string, bytes bigint")
    # A scan leaves empty files out; the listing has them.
    names = spark.createDataFrame([(unquote(name),) for name in files.inputFiles()], "path string").withColumn(
        "path", F.regexp_replace("path", "^file:/+", "file:/"))
    empty = names.join(files.select("path"), "path", "left_anti").select(
        "path", F.sha2(F.lit("").cast("binary"), 256).alias("sha256"), F.lit(0).cast("bigint").alias("bytes"))
    return small.union(stepped).union(empty)


def digest(path: str) -> str:
    """SHA-256 of a file that is read in steps."""
    from pyarrow.fs import FileSystem

    # Spark writes local paths with one slash, which Arrow takes for a relative one.
    uri = "file://" + path[5:] if path.startswith("file:/") and path[6:7] != "/" else path
    system, name = FileSystem.from_uri(uri)
    found = hashlib.sha256()
    with system.open_input_stream(name) as stream:
        while step := stream.read(STEP):
            found.update(step)
    return found.hexdigest()


def inventory_gates(found_files: DataFrame, contract: DataFrame, key: str = "name") -> Gates:
    """contract(name, sha256, bytes): same names, same digests, same sizes."""
    gates = Gates()
    gates.empty("inventory", set_difference(contract, found_files, [key]))
    joined = contract.join(
        found_files.select(key, F.col("sha256").alias("_sha"), F.col("bytes").alias("_bytes")),
        key)
    gates.rows(joined, digest=F.col("sha256") != F.col("_sha"),
               size=F.col("bytes") != F.col("_bytes"))
    return gates
