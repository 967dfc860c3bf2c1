"""Admission of published count tables: every total must reconcile before anything is used.

Text columns are gated first and cast afterwards. A missing cell becomes zero only once the
exhaustive total has reconciled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginloom.functions.demography import OPEN_AGE
from marginloom.operators import gates
from marginloom.operators.reconcile import compare_margins

# Fixed values of the published tables.
TOTAL_AGE = 999
SIZES = ("N1", "N2", "N3", "N4", "N5", "N6_GE")
TOTAL_SIZE = "TOT"


def count_reason(column: str, limit: int | None = None) -> F.Column:
    """Why a text is no count: missing, not_a_count, too_large for a long, above_limit; NULL if it is one."""
    plain = F.col(column).rlike(r"\A[0-9]+\z")
    value = count_of(column)
    above = F.lit(False) if limit is None else value > limit
    return F.when(F.col(column).isNull(), "missing").when(~plain, "not_a_count").when(
        value.isNull(), "too_large").when(above, "above_limit")


def count_of(column: str) -> F.Column:
    """The plain digits of a column as a long; NULL for anything else, also beyond 18 digits."""
    value = F.regexp_replace(column, r"\A0+(?=[0-9])", "")
    return F.when(value.rlike(r"\A[0-9]{1,18}\z"), value).cast("long")


def not_count(column: str, limit: int | None = None) -> F.Column:
    """Violation predicate: `typed` would lose the value, or it exceeds the caller's limit."""
    lost = count_of(column).isNull()
    return lost if limit is None else lost | (count_of(column) > limit)


def typed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast digit columns; anything else becomes NULL (and has been reported by the gates)."""
    return rows.withColumns({c: count_of(c) for c in columns})


def age_table_gates(rows: DataFrame, total: bool = True,
                    found: gates.Gates | None = None) -> gates.Gates:
    """rows(code, age, male, female[, total]) as text: domains, sums and complete ages per area."""
    found = found or gates.Gates()
    columns = ["age", "male", "female"] + (["total"] if total else [])
    numbers = typed(rows, columns)
    checks = {"observed_counts": _any(not_count(c) for c in columns)}
    found.rows(rows, **checks)
    domain = F.col("age").between(0, OPEN_AGE) | (F.col("age") == TOTAL_AGE)
    checks = {"age_domain": ~domain}
    if total:
        checks["sex_sum"] = F.col("male") + F.col("female") != F.col("total")
    found.rows(numbers, **checks)
    found.empty("ages_complete", age_violations(numbers))
    return found


def age_violations(numbers: DataFrame) -> DataFrame:
    """Areas that lack an age, repeat one, or whose ages do not sum to the total row."""
    is_total = F.col("age") == TOTAL_AGE
    per_area = numbers.groupBy("code").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("age").alias("ages"),
        *[F.sum(F.when(~is_total, F.col(c)).otherwise(-F.col(c))).alias(f"{c}_gap")
          for c in ("male", "female")],
        F.count_if(is_total).alias("totals"))
    expected = OPEN_AGE + 2
    return per_area.filter(
        (F.col("rows") != expected) | (F.col("ages") != expected) | (F.col("totals") != 1)
        | ~F.col("male_gap").eqNullSafe(F.lit(0)) | ~F.col("female_gap").eqNullSafe(F.lit(0)))


def age_cells(rows: DataFrame) -> DataFrame:
    """(municipality, sex, age, n) of an admitted age table, total rows removed."""
    numbers = typed(rows, ["age", "male", "female"]).filter(F.col("age") != TOTAL_AGE)
    sides = F.array(F.struct(F.lit("M").alias("sex"), F.col("male").alias("n")),
                    F.struct(F.lit("F").alias("sex"), F.col("female").alias("n")))
    return numbers.select(F.col("code").alias("municipality"), F.col("age").cast("int").alias("age"),
                          F.explode(sides).alias("_s")).select(
        "municipality", "_s.sex", "age", "_s.n")


def household_gates(rows: DataFrame, found: gates.Gates | None = None) -> gates.Gates:
    """rows(ref_area, num_memb, obs_value) as text."""
    found = found or gates.Gates()
    found.rows(rows, household_counts=not_count("obs_value"),
               household_category=~F.col("num_memb").isin(*SIZES, TOTAL_SIZE))
    found.unique("household_unique", rows, ["ref_area", "num_memb"])
    found.empty("household_totals", household_table(rows).filter(
        ~F.col("parts").eqNullSafe(F.col("published"))))
    return found


def household_table(rows: DataFrame) -> DataFrame:
    """Per area: one column per size with derived zeros, published total, number of zeros."""
    numbers = typed(rows, ["obs_value"])
    value = F.col("obs_value")

    def of(name: str) -> F.Column:
        return F.sum(F.when(F.col("num_memb") == name, value))

    parts = F.sum(F.when(F.col("num_memb") != TOTAL_SIZE, value))
    table = numbers.groupBy("ref_area").agg(
        *[of(s).alias(s) for s in SIZES], of(TOTAL_SIZE).alias("published"),
        F.coalesce(parts, F.lit(0)).alias("parts"))
    missing = sum(F.col(s).isNull().cast("int") for s in SIZES)
    return table.withColumn("derived_zeros", missing).fillna(0, list(SIZES))


def household_cells(rows: DataFrame, area: str = "municipality") -> DataFrame:
    """(area, size, n) with zeros for missing sizes; call after the gates."""
    sizes = F.array(*[F.col(s) for s in SIZES])
    return household_table(rows).select(
        F.col("ref_area").alias(area), F.posexplode(sizes).alias("_p", "n")).select(
        area, (F.col("_p") + 1).alias("size"), "n")


def citizenship_gates(rows: DataFrame, labels: DataFrame, year: str,
                      found: gates.Gates | None = None,
                      limit: int | None = None) -> gates.Gates:
    """rows(year, code, country_code, country_label, male, female, total) as text.

    Counts above `limit` are reported, not dropped; None sets no limit.
    """
    found = found or gates.Gates()
    known = labels.select(F.col("code").alias("country_code"), F.col("label").alias("_label"))
    joined = rows.join(known, "country_code", "left")
    found.rows(
        joined,
        reference_year=F.col("year") != year,
        country_label=~F.col("country_label").eqNullSafe(F.col("_label")) | F.col(
            "_label").isNull(),
        area_code=~F.col("code").rlike(r"\A(?:[0-9]{1,6}|IT)\z"),
        citizenship_counts=_any(not_count(c, limit) for c in ("male", "female", "total")))
    numbers = typed(rows, ["male", "female", "total"])
    found.rows(numbers, citizenship_sex_sum=F.col("male") + F.col("female") != F.col("total"))
    found.unique("citizenship_unique", rows, ["code", "country_code"])
    return found


def citizenship_cells(rows: DataFrame) -> DataFrame:
    sides = F.array(F.struct(F.lit("M").alias("sex"), F.col("male").alias("n")),
                    F.struct(F.lit("F").alias("sex"), F.col("female").alias("n")))
    return typed(rows, ["male", "female"]).select(
        F.col("code").alias("municipality"), F.col("country_code").alias("code"),
        F.explode(sides).alias("_s")).select("municipality", "_s.sex", "code", "_s.n")


def membership_violations(membership: DataFrame, child: str = "child", group: str = "group",
                          parent: str = "parent") -> DataFrame:
    """Two coding systems matched through their members, never by name: every group must map to
    exactly one parent, and no two groups to the same one."""
    per_group = membership.groupBy(group).agg(
        F.count_distinct(parent).alias("parents"), F.min(parent).alias("parent"),
        F.count_if(F.col(parent).isNull()).alias("unmatched"))
    shared = per_group.groupBy("parent").agg(F.count(F.lit(1)).alias("groups"))
    return per_group.join(shared, "parent", "left").filter(
        (F.col("parents") != 1) | (F.col("unmatched") > 0)
        | (F.coalesce("groups", F.lit(0)) != 1))


def parent_mismatches(children: DataFrame, membership: DataFrame, parents: DataFrame,
                      keys: Sequence[str], area: str = "municipality",
                      parent: str = "parent") -> DataFrame:
    """Parent cells that are not the sum of their members.

    membership(area, parent) may list several parents per area (province, region, macro-region,
    country), so all levels reconcile in one pass; members are summed before the comparison.
    """
    summed = children.join(membership.select(area, parent), area).groupBy(parent, *keys).agg(
        F.sum("n").cast("long").alias("n"))
    published = parents.select(parent, *keys, "n")
    return compare_margins(summed, published, [parent, *keys]).filter("expected <> actual")


def hierarchy_membership(locality: DataFrame, levels: dict[str, str],
                         root: str | None = None) -> DataFrame:
    """(municipality, level, parent) for several levels; `levels` maps a level to its column."""
    entries = [F.struct(F.lit(name).alias("level"), F.col(column).alias("parent"))
               for name, column in levels.items()]
    if root is not None:
        entries.append(F.struct(F.lit("country").alias("level"), F.lit(root).alias("parent")))
    return locality.select("municipality", F.explode(F.array(*entries)).alias("_e")).select(
        "municipality", "_e.level", "_e.parent")


def macro_region(region: F.Column, groups: dict[str, Sequence[str]]) -> F.Column:
    """Macro-region code of a region, from a reviewed grouping."""
    pairs = [F.lit(v) for code, members in groups.items() for m in members for v in (m, code)]
    return F.element_at(F.create_map(*pairs), region)


def joint_completeness(parents: DataFrame, areas: DataFrame, sexes: Sequence[str],
                       ages: Sequence[str]) -> DataFrame:
    """Missing or unexpected (area, sex, age) cells of a joint table that must be complete."""
    wanted = areas.select(
        "area", F.explode(F.array(*[F.lit(s) for s in sexes])).alias("sex")).select(
        "area", "sex", F.explode(F.array(*[F.lit(a) for a in ages])).alias("age"))
    return gates.set_difference(wanted, parents, ["area", "sex", "age"])


def joint_total_violations(parents: DataFrame, total_age: str = "TOTAL", total_sex: str = "9",
                           ) -> DataFrame:
    """Rows of (area, sex, age, n) whose age total or both-sexes total does not add up."""
    is_total = F.col("age") == total_age
    by_age = parents.groupBy("area", F.col("sex").alias("key")).agg(
        F.sum(F.when(is_total, F.col("n"))).alias("published"),
        F.sum(F.when(~is_total, F.col("n"))).alias("parts"))
    by_sex = parents.groupBy("area", F.col("age").alias("key")).agg(
        F.sum(F.when(F.col("sex") == total_sex, F.col("n"))).alias("published"),
        F.sum(F.when(F.col("sex") != total_sex, F.col("n"))).alias("parts"))
    return by_age.withColumn("rule", F.lit("age_total")).unionByName(
        by_sex.withColumn("rule", F.lit("sex_total"))).filter(
        ~F.col("published").eqNullSafe(F.col("parts")))


def demo_gates(rows: DataFrame, code_pattern: str = r"\ADEMO[0-9]{3}\z",
               first_period: str = "2025-01-01",
               found: gates.Gates | None = None) -> gates.Gates:
    """rows(territory_code, territory_name, period, population) as text, one period only."""
    found = found or gates.Gates()
    period, population = F.col("period"), F.col("population")
    good = (
        F.col("territory_code").rlike(code_pattern)
        & (F.length(F.trim("territory_name")) > 0)
        & period.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
        & period.try_cast("date").isNotNull() & (period >= first_period)
        & population.rlike(r"\A[0-9]+\z") & population.try_cast("long").isNotNull())
    found.aggregate("nonempty", rows, F.count(F.lit(1)) > 0)
    found.rows(rows, valid_values=~F.coalesce(good, F.lit(False)))
    found.unique("unique_key", rows, ["territory_code", "period"])
    found.aggregate("single_period", rows, F.count_distinct("period") == 1)
    return found


def demo_rows(rows: DataFrame) -> DataFrame:
    return rows.select("territory_code", "territory_name", F.col("period").cast("date"),
                       F.col("population").cast("long"))


def sample_gates(rows: DataFrame, selection: dict[str, str], territories: DataFrame,
                 units: dict[str, Sequence[str]], statuses: Sequence[str],
                 attribute_codes: DataFrame, attributes: dict[str, str],
                 regional: Sequence[str], national: str, expected_rows: int,
                 tolerance: int = 0, free_attributes: Sequence[str] = (
                     "NOTE_REF_AREA", "OBS_STATUS", "UNIT_MEAS", "UNIT_MULT"),
                 found: gates.Gates | None = None) -> gates.Gates:
    """A slice of disjoint regions and their national control, as text columns.

    territories(code, note) lists the expected areas with their reviewed note; `attributes` maps an
    attribute column to its codelist in attribute_codes(codelist, code).
    """
    found = found or gates.Gates()

    def text(name: str) -> F.Column:
        return F.coalesce(name, F.lit(""))

    found.aggregate("row_count", rows, F.count(F.lit(1)) == expected_rows)
    found.unique("unique_key", rows, ["REF_AREA"])
    found.empty("territorial_coverage", gates.set_difference(
        rows.select(F.col("REF_AREA").alias("code")), territories, ["code"]))
    value = F.when(F.col("OBS_VALUE").rlike(r"\A[0-9]{1,19}\z"), F.col("OBS_VALUE")).try_cast(
        "long")
    closed = [a for a in attributes if a not in free_attributes]
    found.rows(
        rows,
        selected_slice=_any(~F.col(k).eqNullSafe(F.lit(v)) for k, v in selection.items()),
        nonnegative_int64=value.isNull(),
        reviewed_flags=~text("OBS_STATUS").isin(list(statuses)),
        reviewed_units=_any(~text(k).isin(list(v)) for k, v in units.items()),
        blank_notes=_any(text(k) != "" for k in closed))
    noted = rows.join(territories.select(F.col("code").alias("REF_AREA"), "note"), "REF_AREA")
    found.rows(noted, reviewed_notes=text("NOTE_REF_AREA") != F.coalesce("note", F.lit("")))
    used = F.array(*[F.struct(F.lit(c).alias("codelist"), text(a).alias("code"))
                     for a, c in attributes.items()])
    found.empty("attribute_domains", rows.select(F.explode(used).alias("_u")).select(
        "_u.*").filter("code <> ''").join(attribute_codes, ["codelist", "code"], "left_anti"))
    difference = (
        F.sum(F.when(F.col("REF_AREA").isin(list(regional)), value))
        - F.sum(F.when(F.col("REF_AREA") == national, value)))
    found.aggregate("national_reconciliation", rows, F.abs(difference) <= tolerance)
    return found


def _any(conditions) -> F.Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | F.coalesce(condition, F.lit(True))
    return result
