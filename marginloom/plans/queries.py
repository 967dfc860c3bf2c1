"""Read queries over the published tables.

Each function returns a DataFrame; filters are plain predicates on stored columns, so partition
pruning (snapshot or release), row-group statistics and column pruning apply before sort and limit.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginloom.functions.demography import OPEN_AGE
from marginloom.operators.paging import check_page, equals, id_page, keyset_page, matches
from marginloom.operators.reconcile import margin_summary

# Labels under which a status is shown, hence sorted.
STATUS_LABELS = {
    "demo": "Dimostrativo", "missing": "Mancante", "observed": "Osservato",
    "suppressed": "Riservato", "unflagged_upstream": "—", "estimated": "Stimato",
}
PERSON_SORTS = ("person_id", "age", "sex", "citizenship_code", "household_id")
HOUSEHOLD_SORTS = ("household_id", "size")
OBSERVATION_SORTS = ("territory_id", "name", "code", "value", "status")
CROSSWALK_SORTS = {"id": "id", "date": "effective_date", "description": "description",
                   "from_code": "from_code", "to_code": "to_code", "usage": "weight_basis"}
VALIDATION_KINDS = ("sex_age", "foreign_age", "citizenship", "household_size")


def padded(column: str, width: int) -> Column:
    return F.lpad(F.col(column).cast("string"), width, "0")


def check_code(value: str | None, digits: int) -> int | None:
    if value is not None and not re.fullmatch(rf"[0-9]{{{digits}}}", value):
        raise ValueError(f"Code must have {digits} digits")
    return None if value is None else int(value)


def check_ages(age_min: int, age_max: int) -> None:
    if not 0 <= age_min <= age_max <= OPEN_AGE:
        raise ValueError("Ages must satisfy 0 <= min <= max <= 100")


def person_fields(df: DataFrame) -> DataFrame:
    return df.select(
        "person_id", "household_id", padded("municipality_code", 6).alias("municipality_code"),
        "sex", "birth_year", "birth_year_upper_bound", "age", "age_is_lower_bound",
        padded("citizenship_code", 3).alias("citizenship_code"), "reference_adult", "data_kind")


def household_fields(df: DataFrame) -> DataFrame:
    return df.select("household_id", padded("municipality_code", 6).alias("municipality_code"),
                     "size", "data_kind")


def snapshots(table: DataFrame, limit: int) -> DataFrame:
    hidden = ("report", "provenance", "publication_checks")
    return table.drop(*hidden).orderBy(F.desc("published_at"), F.desc("id")).limit(limit)


def snapshot(table: DataFrame, snapshot_id: int) -> DataFrame:
    return table.filter(F.col("id") == snapshot_id)


def municipalities(table: DataFrame, snapshot_id: int, region: str | None = None,
                   search: str | None = None, after: int = 0, limit: int = 500) -> DataFrame:
    df = equals(table, snapshot_id=snapshot_id, region_code=check_code(region, 2))
    df = df.filter(matches(search, ["name", padded("code", 6)]))
    return id_page(df, "code", after, limit).select(
        padded("code", 6).alias("code"), "name",
        padded("province_code", 3).alias("province_code"), "province_name",
        padded("region_code", 2).alias("region_code"), "region_name", "persons", "households",
        "longitude", "latitude")


def map_regions(regions: DataFrame, places: DataFrame, snapshot_id: int) -> DataFrame:
    totals = places.filter(F.col("snapshot_id") == snapshot_id).groupBy("region_code").agg(
        F.sum("persons").cast("long").alias("persons"),
        F.sum("households").cast("long").alias("households"))
    shown = regions.filter(F.col("snapshot_id") == snapshot_id)
    return shown.join(totals, shown.code == totals.region_code).orderBy("code").select(
        padded("code", 2).alias("code"), "name", "persons", "households", "geometry")


def map_boundaries(table: DataFrame, snapshot_id: int, width: int,
                   region: str | None = None) -> DataFrame:
    df = equals(table, snapshot_id=snapshot_id, region_code=check_code(region, 2))
    return df.filter(F.col("geometry").isNotNull()).orderBy("code").select(
        padded("code", width).alias("code"), "geometry")


def persons(table: DataFrame, snapshot_id: int, municipality: str, sex: str | None = None,
            citizenship: str | None = None, age_min: int = 0, age_max: int = OPEN_AGE,
            sort_by: str = "person_id", direction: str = "asc", after: int | None = None,
            limit: int = 500) -> DataFrame:
    check_page(sort_by, PERSON_SORTS, direction, limit)
    check_ages(age_min, age_max)
    df = equals(table, snapshot_id=snapshot_id, municipality_code=check_code(municipality, 6),
                sex=sex, citizenship_code=check_code(citizenship, 3))
    df = df.filter(F.col("age").between(age_min, age_max))
    order = (F.coalesce("household_id", F.lit(0)) if sort_by == "household_id"
             else F.col(sort_by))
    return person_fields(keyset_page(df, order, "person_id", direction, after, limit))


def person(table: DataFrame, snapshot_id: int, person_id: int) -> DataFrame:
    return person_fields(equals(table, snapshot_id=snapshot_id, person_id=person_id))


def households(table: DataFrame, snapshot_id: int, municipality: str, size: int | None = None,
               sort_by: str = "household_id", direction: str = "asc",
               after: int | None = None, limit: int = 500) -> DataFrame:
    check_page(sort_by, HOUSEHOLD_SORTS, direction, limit)
    df = equals(table, snapshot_id=snapshot_id, municipality_code=check_code(municipality, 6),
                size=size)
    return household_fields(keyset_page(df, sort_by, "household_id", direction, after, limit))


def household(table: DataFrame, people: DataFrame, snapshot_id: int,
              household_id: int) -> DataFrame:
    """One row with its members (at most six, by construction) as a sorted array."""
    members = person_fields(equals(people, snapshot_id=snapshot_id, household_id=household_id))
    listed = members.groupBy("household_id").agg(
        F.array_sort(F.collect_list(F.struct(*members.columns))).alias("members"))
    df = household_fields(equals(table, snapshot_id=snapshot_id, household_id=household_id))
    return df.join(listed, "household_id", "left")


def distribution(cells: DataFrame, snapshot_id: int, municipality: str | None = None,
                 region: str | None = None, sex: str | None = None,
                 citizenship: str | None = None, age_min: int = 0, age_max: int = OPEN_AGE,
                 province: str | None = None) -> DataFrame:
    check_ages(age_min, age_max)
    df = equals(cells, snapshot_id=snapshot_id, municipality_code=check_code(municipality, 6),
                region_code=check_code(region, 2), province_code=check_code(province, 3),
                sex=sex, citizenship_code=check_code(citizenship, 3))
    return df.filter(F.col("age").between(age_min, age_max)).groupBy("age", "sex").agg(
        F.sum("persons").cast("long").alias("persons")).orderBy("age", "sex")


def validation(table: DataFrame, snapshot_id: int, municipality: str | None = None) -> DataFrame:
    df = equals(table, snapshot_id=snapshot_id, municipality_code=check_code(municipality, 6))
    return margin_summary(df, ["kind"]).orderBy("kind")


def comparison(table: DataFrame, snapshot_id: int, municipality: str, kind: str,
               sort_by: str = "category", direction: str = "asc") -> DataFrame:
    """Expected and actual cells; `sort_by` may also be the difference."""
    if kind not in VALIDATION_KINDS:
        raise ValueError(f"Unknown kind: {kind}")
    check_page(sort_by, ("category", "sex", "expected", "actual", "difference"), direction, 1)
    df = equals(table, snapshot_id=snapshot_id, municipality_code=check_code(municipality, 6),
                kind=kind)
    column = F.col("actual") - F.col("expected") if sort_by == "difference" else F.col(sort_by)
    order = column.desc() if direction == "desc" else column.asc()
    return df.orderBy(order, "category", "sex").select(
        "kind", "sex", "category", "expected", "actual")


def sources(table: DataFrame) -> DataFrame:
    return table.orderBy("id")


def releases(table: DataFrame, limit: int) -> DataFrame:
    return table.orderBy(F.desc("published_at"), "id").limit(limit)


def release(table: DataFrame, release_id: str) -> DataFrame:
    return table.filter(F.col("id") == release_id)


def quality(table: DataFrame, release_id: str) -> DataFrame:
    return table.filter(F.col("release_id") == release_id).orderBy("check_name")


def artifacts(table: DataFrame, release_id: str) -> DataFrame:
    return table.filter(F.col("release_id") == release_id).orderBy("kind")


def observations(table: DataFrame, release_id: str, series: str, period: str,
                 level: str | None = None, after: int = 0, limit: int = 500) -> DataFrame:
    df = equals(table, release_id=release_id, series_code=series, level=level)
    return id_page(df.filter(F.col("period") == F.lit(period).cast("date")), "territory_id",
                   after, limit)


def status_label(column: str = "status") -> Column:
    label = None
    for status, text in STATUS_LABELS.items():
        test = F.col(column) == status
        label = F.when(test, text) if label is None else label.when(test, text)
    return label


def observation_table(table: DataFrame, release_id: str, series: str, period: str,
                      level: str | None = None, parent_code: str | None = None,
                      status: str | None = None, search: str | None = None,
                      sort_by: str = "territory_id", direction: str = "asc",
                      after: int | None = None, limit: int = 500) -> DataFrame:
    check_page(sort_by, OBSERVATION_SORTS, direction, limit)
    df = equals(table, release_id=release_id, series_code=series, level=level,
                parent_code=parent_code, status=status)
    df = df.filter(F.col("period") == F.lit(period).cast("date")).filter(
        matches(search, ["territory_name", "territory_code"]))
    order = {"name": F.col("territory_name"), "code": F.col("territory_code"),
             "status": status_label()}.get(sort_by)
    return keyset_page(df, F.col(sort_by) if order is None else order, "territory_id", direction,
                       after, limit)


def coverage(table: DataFrame, release_id: str, limit: int = 500) -> DataFrame:
    return table.filter(F.col("release_id") == release_id).orderBy(
        "period", "series_code").limit(limit)


def territories(table: DataFrame, release_id: str, snapshot_day: str, level: str,
                after: int = 0, limit: int = 500) -> DataFrame:
    df = equals(table, release_id=release_id, level=level).filter(
        F.col("snapshot") == F.lit(snapshot_day).cast("date"))
    return id_page(df, "territory_id", after, limit)


def crosswalks(table: DataFrame, release_id: str, kind: str | None = None,
               weight_basis: str | None = None, sort_by: str = "id", direction: str = "asc",
               after: int | None = None, limit: int = 500) -> DataFrame:
    check_page(sort_by, CROSSWALK_SORTS, direction, limit)
    df = equals(table, release_id=release_id, kind=kind, weight_basis=weight_basis)
    return keyset_page(df, CROSSWALK_SORTS[sort_by], "id", direction, after, limit)


def boundary(table: DataFrame, release_id: str, territory_id: int) -> DataFrame:
    return equals(table, release_id=release_id, territory_id=territory_id)


def age_histogram(cells: DataFrame, age: str = "age", sex: str = "sex",
                  n: str = "persons") -> DataFrame:
    """Eleven bins (the last is 100+) with both sexes; empty bins are present as zero."""
    step = F.least(F.floor(F.col(age) / 10), F.lit(10)).cast("int")
    counted = cells.groupBy(step.alias("bin")).agg(
        *[F.coalesce(F.sum(F.when(F.col(sex) == code, F.col(n))), F.lit(0)).cast("long")
          .alias(name) for code, name in (("M", "male"), ("F", "female"))])
    bins = cells.sparkSession.range(11).select(F.col("id").cast("int").alias("bin"))
    label = F.when(F.col("bin") == 10, "100+").otherwise(F.concat_ws(
        "-", (F.col("bin") * 10).cast("string"), (F.col("bin") * 10 + 9).cast("string")))
    return bins.join(counted, "bin", "left").select(
        "bin", label.alias("label"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("male", "female")])


def territory_list(places: DataFrame, region: str | None = None, province: str | None = None,
                   search: str | None = None) -> DataFrame:
    df = equals(places, region_code=check_code(region, 2), province_code=check_code(province, 3))
    return df.filter(matches(search, ["name", padded("code", 6)])).orderBy("name", "code")


def largest_first(places: DataFrame) -> DataFrame:
    return places.orderBy(F.desc("persons"), "code")
