"""Keys that tell rows apart where ids are null or repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(*columns: str) -> Column:
    """64-bit hash of a whole row, never null: rows with equal keys are copies of one another.

    Nulls do not enter Spark's hash, so which columns are null is hashed as well.
    """
    return F.xxhash64(F.concat(*[F.col(c).isNull().cast("string") for c in columns]), *columns)


def single_rows(df: DataFrame, key: str, copies: str) -> DataFrame:
    """One row of each key and the number of its copies; copies are combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.count("*").alias(copies), *[F.first(c).alias(c) for c in rest])


def emitted(df: DataFrame, copies: Column, columns: list[str]) -> DataFrame:
    """Every row as often as `copies` says."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*columns)
