"""Normalisation of published slices to series and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published codes and the labels they stand for.
SEX_LABELS = {"1": "M", "2": "F", "9": "TOTAL"}
SEX_TITLES = {"M": "maschi", "F": "femmine", "TOTAL": "totale"}
OCCUPANCY = {"NUM_DW_AV": "TOTAL", "NUM_OCC_DW_AV": "occupied", "NUM_UNOCC_DW_AV": "unoccupied"}
OCCUPANCY_TITLES = {"TOTAL": "totale", "occupied": "occupate", "unoccupied": "non occupate"}
POPULATION_TITLE = "Popolazione al 1° gennaio"
HOUSEHOLDS_TITLE = "Famiglie al 31 dicembre"
DWELLINGS_TITLE = "Abitazioni al 31 dicembre"
OPEN_AGE_CODE = "Y_GE100"
OPEN_SIZE_CODE = "N6_GE"


def mapped(column: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for p in values.items() for v in p]), column)


def class_code(column: Column, letter: str, total: str, open_code: str, open_range: str) -> Column:
    """struct(range, reason) of a class code: "Y17" is 17:18, the open class its range, the total TOTAL.

    A code is read as a whole or has a reason why not: missing, unknown, or too_large for a long.
    """
    digits = F.regexp_extract(column, rf"\A{letter}0*([0-9]+)\z", 1)
    number = F.when(digits.rlike(r"\A[0-9]{1,18}\z"), digits).cast("long")
    span = F.when(column == total, "TOTAL").when(column == open_code, open_range).when(
        number.isNotNull(), F.concat(number.cast("string"), F.lit(":"), (number + 1).cast("string")))
    reason = F.when(column.isNull(), "missing").when(span.isNotNull(), None).when(
        digits != "", "too_large").otherwise("unknown")
    return F.struct(span.alias("range"), reason.alias("reason"))


def age_class(column: Column) -> Column:
    return class_code(column, "Y", "TOTAL", OPEN_AGE_CODE, "100:1000")


def size_class(column: Column) -> Column:
    return class_code(column, "N", "TOT", OPEN_SIZE_CODE, "6:1000")


def label_class(column: Column, values: dict[str, str]) -> Column:
    """struct(range, reason) of a code with a fixed list of labels."""
    return F.struct(F.try_element_at(F.create_map(*[F.lit(v) for p in values.items() for v in p]), column)
                    .alias("range"), F.when(column.isNull(), "missing").when(
                        ~column.isin(list(values)), "unknown").alias("reason"))


def code_violations(rows: DataFrame, keys: list[str], classes: dict[str, Column]) -> DataFrame:
    """(*keys, column, code, reason) for every code of a row that is not read."""
    found = F.array(*[F.struct(F.lit(name).alias("column"), F.col(name).alias("code"),
                               parsed["reason"].alias("reason")) for name, parsed in classes.items()])
    return rows.select(*keys, F.explode(F.filter(found, lambda v: v["reason"].isNotNull())).alias("v")).select(
        *keys, "v.*")


def age_range(column: Column) -> Column:
    return age_class(column)["range"]


def size_range(column: Column) -> Column:
    return size_class(column)["range"]


def population_series(rows: DataFrame) -> DataFrame:
    """Adds series_code, title, unit and dimensions to rows with SEX and AGE codes.

    Codes that are not read give NULL in the dimensions; `code_violations` lists them.
    """
    sex = label_class(F.col("SEX"), SEX_LABELS)["range"]
    age = F.col("AGE")
    age_title = F.when(age == "TOTAL", "tutte le età").when(
        age == OPEN_AGE_CODE, "100 anni e più").otherwise(
        F.concat(F.regexp_extract(age, r"\A.(.*)\z", 1), F.lit(" anni")))
    return rows.withColumns({
        "series_code": F.concat_ws("_", F.lit("population_jan1"), F.lower(sex), F.lower(age)),
        "title": F.concat(F.lit(f"{POPULATION_TITLE} — "), mapped(sex, SEX_TITLES), F.lit(", "),
                          age_title),
        "unit": F.lit("persons"),
        "dimensions": F.create_map(F.lit("measure"), F.lit("population_jan1"), F.lit("sex"), sex,
                                   F.lit("age"), age_range(age)),
    })


def household_series(rows: DataFrame) -> DataFrame:
    size = F.col("NUM_MEMB")
    total = size == "TOT"
    label = F.when(size == OPEN_SIZE_CODE, "6 e più").otherwise(F.regexp_extract(size, r"\A.(.*)\z", 1))
    return rows.withColumns({
        "series_code": F.when(total, "census_households_total").otherwise(
            F.concat(F.lit("census_households_"), F.lower(size))),
        "title": F.when(total, f"{HOUSEHOLDS_TITLE} — totale").otherwise(
            F.concat(F.lit(f"{HOUSEHOLDS_TITLE} — "), label, F.lit(" componenti"))),
        "unit": F.lit("households"),
        "dimensions": F.create_map(F.lit("measure"), F.lit("households_dec31"),
                                   F.lit("household_size"), size_range(size)),
    })


def dwelling_series(rows: DataFrame) -> DataFrame:
    kind = mapped(F.col("INDICATOR"), OCCUPANCY)
    return rows.withColumns({
        "series_code": F.concat(F.lit("census_dwellings_"), F.lower(kind)),
        "title": F.concat(F.lit(f"{DWELLINGS_TITLE} — "), mapped(kind, OCCUPANCY_TITLES)),
        "unit": F.lit("dwellings"),
        "dimensions": F.create_map(F.lit("measure"), F.lit("dwellings_dec31"),
                                   F.lit("occupancy"), kind),
    })


def note_bag(rows: DataFrame) -> Column:
    """Non-empty NOTE_* columns as JSON with sorted keys."""
    names = sorted(c for c in rows.columns if c.startswith("NOTE_"))
    if not names:
        return F.lit("{}")
    pairs = F.create_map(*[v for n in names for v in (F.lit(n), F.coalesce(n, F.lit("")))])
    return F.to_json(F.map_filter(pairs, lambda k, v: v != ""))


def as_observations(rows: DataFrame, period: str, territory: Column) -> DataFrame:
    """Rows with series columns and OBS_VALUE to observations; upstream flags are kept."""
    def text(name: str) -> Column:
        return F.coalesce(name, F.lit("")) if name in rows.columns else F.lit("")

    return rows.select(
        territory.alias("territory_key"), "series_code", F.lit(period).cast("date").alias("period"),
        F.col("OBS_VALUE").cast("decimal(20,6)").alias("value"),
        F.lit("unflagged_upstream").alias("status"), text("OBS_STATUS").alias("upstream_status"),
        note_bag(rows).alias("upstream_note"), text("UNIT_MEAS").alias("upstream_unit"),
        text("UNIT_MULT").alias("upstream_unit_multiplier"))


def series_registry(*frames: DataFrame) -> DataFrame:
    """Distinct series definitions; dimensions are compared through their sorted entries."""
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    entries = F.array_sort(F.map_entries("dimensions"))
    return rows.select("series_code", "title", "unit", entries.alias("_d")).distinct().select(
        F.col("series_code").alias("code"), "title", "unit",
        F.map_from_entries("_d").alias("dimensions"))
