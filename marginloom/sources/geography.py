"""Attribute records of geographic layers to territory versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginloom.operators.gates import Gates


def scheme(prefix: str, snapshot: str, checksum: str) -> str:
    return f"{prefix}:{snapshot}:{checksum}"


def territories(regions: DataFrame, provinces: DataFrame, municipalities: DataFrame,
                snapshot: str, scheme_name: str, root_code: str = "IT",
                root_name: str = "Italia") -> DataFrame:
    """Versions with one-day validity. Inputs: regions(code, name), provinces(code, region, name)
    and municipalities(code text, province, name); numeric codes are padded to 2, 3 and 6."""
    spark = regions.sparkSession

    def padded(column: str, width: int) -> F.Column:
        return F.lpad(F.col(column).cast("int").cast("string"), width, "0")

    layers = (
        spark.range(1).select(F.lit(root_code).alias("code"), F.lit(root_name).alias("name"),
                              F.lit("country").alias("level"),
                              F.lit(None).cast("string").alias("parent")),
        regions.select(padded("code", 2).alias("code"), "name", F.lit("region").alias("level"),
                       F.lit(root_code).alias("parent")),
        provinces.select(padded("code", 3).alias("code"), "name",
                         F.lit("province").alias("level"), padded("region", 2).alias("parent")),
        municipalities.select("code", "name", F.lit("municipality").alias("level"),
                              padded("province", 3).alias("parent")),
    )
    rows = layers[0]
    for layer in layers[1:]:
        rows = rows.unionByName(layer)
    day = F.lit(snapshot).cast("date")
    key = F.concat_ws(":", F.lit(snapshot), "code")
    parent = F.when(F.col("parent").isNotNull(), F.concat_ws(":", F.lit(snapshot), "parent"))
    return rows.select(
        key.alias("key"), F.lit(scheme_name).alias("scheme"), "code", "name", "level",
        day.alias("valid_from"), F.date_add(day, 1).alias("valid_to"), day.alias("snapshot"),
        parent.alias("parent_key"))


def layer_gates(municipalities: DataFrame, found: Gates | None = None) -> Gates:
    """Six-digit text code that equals the numeric one (columns code, number)."""
    found = found or Gates()
    good = F.col("code").rlike(r"\A[0-9]{6}\z") & (
        F.col("code").try_cast("int") == F.col("number"))
    return found.rows(municipalities, municipality_code=~F.coalesce(good, F.lit(False)))


def census_counts(records: DataFrame, snapshot: str, population: str,
                  households: str) -> DataFrame:
    """(key, measure, value) of the two census counts of a layer, when they are present."""
    sides = F.array(F.struct(F.lit("population").alias("measure"),
                             F.col(population).cast("long").alias("value")),
                    F.struct(F.lit("households").alias("measure"),
                             F.col(households).cast("long").alias("value")))
    return records.select(F.concat_ws(":", F.lit(snapshot), "code").alias("key"),
                          F.explode(sides).alias("_s")).select("key", "_s.*")


def census_gates(records: DataFrame, columns: list[str], found: Gates | None = None) -> Gates:
    found = found or Gates()
    checks = {f"census_{c}": F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) != F.floor(c))
              for c in columns}
    return found.rows(records, **checks)
