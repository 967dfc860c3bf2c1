"""JSON documents, newline JSON and Parquet with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginloom import schemas
from marginloom.functions.polygons import from_geojson
from marginloom.operators.gates import QualityError, Check, schema_matches


def read_national(spark: SparkSession, path: str) -> DataFrame:
    """Newline JSON, one municipality per line, with count arrays."""
    return spark.read.schema(schemas.NATIONAL_INPUT).option("mode", "FAILFAST").json(path)


def read_citizenship(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CITIZENSHIP_INPUT).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, member: str, row: T.StructType) -> DataFrame:
    """Rows of one array member of a single JSON document (`{"member": [...]}`).

    The document is one file; it suits inputs of national size. Larger inputs use newline JSON.
    """
    schema = T.StructType([T.StructField(member, T.ArrayType(row))])
    document = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    return document.select(F.explode(member).alias("_r")).select("_r.*")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Newline JSON of observations, typed to DATE and DECIMAL(20,6)."""
    return spark.read.schema(schemas.OBSERVATIONS).option("mode", "FAILFAST").json(path)


def read_table(spark: SparkSession, path: str, expected: T.StructType) -> DataFrame:
    """Parquet whose stored names and types equal the declared ones."""
    df = spark.read.parquet(path)
    if not schema_matches(df, expected):
        raise QualityError([Check("schema", False, 1)])
    return df


def read_features(spark: SparkSession, path: str, snapshot: str,
                  code: str = "code") -> DataFrame:
    """GeoJSON feature collection to (key, geometry); key is "snapshot:code"."""
    feature = T.StructType.fromDDL(
        f"properties struct<{code}:string>, geometry string")
    rows = read_document(spark, path, "features", feature)
    return rows.select(
        F.concat_ws(":", F.lit(snapshot), F.col(f"properties.{code}")).alias("key"),
        from_geojson(F.col("geometry")).alias("geometry"))


def constant_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Small reference tables such as labels or the root territory."""
    return spark.createDataFrame(rows, ddl)
