"""Independent audit: everything is recomputed from the stored records, not from the generator."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginloom import schemas
from marginloom.functions.demography import (
    ADULT_AGE,
    OPEN_AGE,
    age_from_cohort,
    cohort_reference_year,
)
from marginloom.operators import gates, reconcile
from marginloom.plans.margins import DOMESTIC, STATELESS, Margins, totals
from marginloom.session import materialize

RARE_CELL = 5
PACKAGE_CELL = 10
SENIOR_AGE = 65
PLACE = ["municipality", "province", "region"]


def aged(persons: DataFrame, reference: str) -> DataFrame:
    cohort = cohort_reference_year(reference)
    return persons.withColumn(
        "age", age_from_cohort(F.col("birth_year"), F.col("birth_year_upper_bound"), cohort))


def without_citizenship(schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != "citizenship_code"])


def identity_profile(df: DataFrame, identity: str) -> DataFrame:
    """records, distinct_ids, min_id, max_id and whether the ids are a dense interval."""
    profile = df.agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct(identity).alias("distinct_ids"),
        F.min(identity).alias("min_id"), F.max(identity).alias("max_id"))
    dense = (F.col("records") == F.col("distinct_ids")) & (
        F.col("max_id") - F.col("min_id") + 1 == F.col("records"))
    return profile.withColumn("dense", F.coalesce(dense, F.col("records") == 0))


def household_profile(persons: DataFrame) -> DataFrame:
    """Members, references, adults and the extremes of geography and age per household."""
    place = F.struct("municipality", "province", "region")
    return persons.filter(F.col("household_id").isNotNull()).groupBy("household_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if("reference_adult").alias("refs"),
        F.count_if(F.col("age") >= ADULT_AGE).alias("adults"),
        F.min(place).alias("low"), F.max(place).alias("high"),
        F.min("age").alias("youngest"), F.max("age").alias("oldest"),
    )


def family_violations(persons: DataFrame, households: DataFrame, reference: str) -> DataFrame:
    """Households whose members do not match size, geography or the adult rules.

    Members are aggregated before the join, so persons are shuffled once, by household.
    """
    members = household_profile(aged(persons, reference))
    place = F.struct("municipality", "province", "region")
    same = F.col("low").eqNullSafe(place) & F.col("high").eqNullSafe(place)
    return households.join(members, "household_id", "left").filter(
        (F.coalesce("members", F.lit(0)) != F.col("size"))
        | (F.coalesce("refs", F.lit(0)) != 1)
        | (F.coalesce("adults", F.lit(0)) < 1)
        | ~F.coalesce(same, F.lit(False))
    ).select("household_id", "municipality", "size", "members", "refs", "adults")


def rare_cells(df: DataFrame, quasi_identifiers: Sequence[str], k: int = RARE_CELL) -> DataFrame:
    """How many cells hold fewer than k records, and how many records are in them."""
    cells = df.groupBy(*quasi_identifiers).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < k)
    return cells.agg(F.count(F.lit(1)).alias("rare_cells"),
                     F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("records"))


def family_statistics(persons: DataFrame, reference: str) -> DataFrame:
    minors, seniors = F.col("youngest") < ADULT_AGE, F.col("oldest") >= SENIOR_AGE
    return household_profile(aged(persons, reference)).agg(
        F.count_if(minors).alias("households_with_minors"),
        F.count_if(F.col("youngest") >= SENIOR_AGE).alias("households_only_65_plus"),
        F.count_if(minors & seniors).alias("households_minors_and_65_plus"))


def residuals(persons: DataFrame) -> DataFrame:
    """Persons per municipality and how many are in no household."""
    return persons.groupBy("municipality").agg(
        F.count(F.lit(1)).alias("persons"),
        F.count_if(F.col("household_id").isNull()).alias("unassigned"))


def region_cells(persons: DataFrame, reference: str) -> DataFrame:
    return aged(persons, reference).groupBy("region", "sex", "age").agg(
        F.count(F.lit(1)).alias("n"))


def release_package(cells: DataFrame, minimum: int = PACKAGE_CELL,
                    official: bool = True) -> DataFrame:
    """Region x sex x decade (90+ pooled) of (region, sex, age, n), all or nothing.

    Suppressing single cells could be undone from the additive margins, so one rare cell withholds
    the whole table.
    """
    decade = F.least(F.floor(F.col("age") / 10) * 10, F.lit(90)).cast("int")
    table = cells.groupBy("region", "sex", decade.alias("age_lower")).agg(
        F.sum("n").cast("long").alias("persons"))
    smallest = table.agg(F.min("persons")).scalar()
    return table.filter((smallest >= minimum) & F.lit(official))


def margin_frames(persons: DataFrame, reference: str, domestic: str = DOMESTIC) -> dict[str, DataFrame]:
    """Counted margins of a persons or individuals table."""
    rows = aged(persons, reference)
    count = F.count(F.lit(1)).alias("n")
    frames = {"sex_age": rows.groupBy("municipality", "sex", "age").agg(count)}
    if "citizenship_code" in persons.columns:
        frames["countries"] = rows.groupBy("municipality", "sex", "citizenship_code").agg(
            count).withColumnRenamed("citizenship_code", "code")
        frames["foreigners"] = rows.filter(F.col("citizenship_code") != domestic).groupBy(
            "municipality", "sex", "age").agg(count)
    return frames


def _equal(found: gates.Gates, name: str, expected: DataFrame, actual: DataFrame,
           keys: Sequence[str]) -> None:
    cells = reconcile.compare_margins(expected.filter("n > 0"), actual, keys)
    found.empty(name, cells.filter("expected <> actual"))


def profiled(records: DataFrame, reference: str, rules: dict[str, F.Column] | None = None) -> DataFrame:
    """One stored pass over persons or individuals that all margins and row rules are read from.

    Two grouping sets: the cells (geography, sex, age, citizenship) and, where there are households,
    the members of a household in one place. Counters only, so both are combined before they are
    shuffled. `rules` describe violations (NULL is one); their counters have the same names.
    """
    rows = aged(records, reference)
    cell = [*PLACE, "sex", "age", *[c for c in ("citizenship_code",) if c in records.columns]]
    sets, columns = [cell], list(cell)
    counters = [F.count(F.lit(1)).alias("n"), F.min("person_id").alias("min_id"), F.max("person_id").alias("max_id")]
    if "household_id" in records.columns:
        sets.append([*PLACE, "household_id"])
        columns.append("household_id")
        counters += [F.count_if(F.col("household_id").isNull()).alias("unassigned"),
                     F.count_if("reference_adult").alias("refs"),
                     F.count_if(F.col("age") >= ADULT_AGE).alias("adults"),
                     F.min("age").alias("youngest"), F.max("age").alias("oldest")]
    counters += [F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in (rules or {}).items()]
    home = F.grouping("sex") == 1 if len(sets) > 1 else F.lit(False)
    return materialize(rows.groupingSets(sets, *columns).agg(*counters, home.alias("of_household")), "profile")


def person_rules(reference: str, with_codes: bool) -> dict[str, F.Column]:
    """Violations that one row of persons shows by itself; `age` is derived first."""
    cohort = cohort_reference_year(reference)
    exact = F.col("birth_year").between(cohort - OPEN_AGE + 1, cohort) & F.col(
        "birth_year_upper_bound").isNull()
    open_class = F.col("birth_year").isNull() & (
        F.col("birth_year_upper_bound") == cohort - OPEN_AGE)
    minor = F.coalesce(F.col("age") < ADULT_AGE, F.lit(False))
    homeless = F.col("household_id").isNull()
    domains = (
        F.col("sex").isNull() | ~F.col("sex").isin("M", "F") | F.col("reference_adult").isNull()
        | ~F.col("data_kind").eqNullSafe("synthetic")
        | (F.coalesce("reference_adult", F.lit(False)) & (minor | homeless))
        | (minor & homeless))
    rules = {"birth_domains": ~F.coalesce(exact | open_class, F.lit(False)), "person_domains": domains}
    if with_codes:
        rules["citizenship_domain"] = F.col("citizenship_code").isNull()
    return rules


def person_profile(persons: DataFrame, margins: Margins, reference: str) -> tuple[DataFrame, DataFrame]:
    """The stored cells and household members that the gates of a run read.

    The few cells are stored by themselves: most gates read them, and no gate reads all members for them.
    """
    profile = profiled(persons, reference, person_rules(reference, margins.countries is not None))
    homes = profile.filter("of_household")
    return materialize(profile.filter("not of_household"), "cells"), homes


def profile_margins(cells: DataFrame, domestic: str = DOMESTIC) -> dict[str, DataFrame]:
    """Counted margins from the cells of a profile."""
    total = F.sum("n").alias("n")
    frames = {"sex_age": cells.groupBy("municipality", "sex", "age").agg(total)}
    if "citizenship_code" in cells.columns:
        frames["countries"] = cells.groupBy("municipality", "sex", F.col("citizenship_code").alias("code")).agg(total)
        frames["foreigners"] = cells.filter(F.col("citizenship_code") != domestic).groupBy(
            "municipality", "sex", "age").agg(total)
    return frames


def paired(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """One stored row: distinct ids of both sides and the rows in which a later stage changed one.

    Rows meet by id once; duplicates are seen in the same partitioning. Of a row only its id and a 64-bit
    hash of the rest move, which also tells which columns are NULL. As in a full join, every row of one
    side is compared with every row of the other side with its id.
    """
    if before is None:
        ids = after.groupBy("person_id").agg(F.count(F.lit(1)).alias("_n"))
        return materialize(ids.agg(F.count(F.lit(1)).alias("distinct_after")), "paired")
    attributes = [c for c in before.columns if c != "person_id"]
    rest = F.xxhash64(*attributes, *[F.col(c).isNull() for c in attributes]).alias("_hash")
    sides = [df.select("person_id", rest, F.lit(b).alias("_b"), F.lit(1 - b).alias("_a")) for b, df in ((1, before), (0, after))]
    per = sides[0].unionByName(sides[1]).repartition("person_id").groupBy("person_id", "_hash").agg(
        F.sum("_b").alias("_b"), F.sum("_a").alias("_a")).groupBy("person_id").agg(
        F.sum("_b").alias("_b"), F.sum("_a").alias("_a"), F.sum(F.col("_b") * F.col("_a")).alias("_same"))
    # NULL is no id that rows could meet by.
    met = F.col("person_id").isNotNull() & (F.col("_b") > 0) & (F.col("_a") > 0)
    changed = F.when(met, F.col("_b") * F.col("_a") - F.col("_same")).otherwise(F.col("_b") + F.col("_a"))
    return materialize(per.agg(
        F.coalesce(F.sum(changed), F.lit(0)).cast("long").alias("changed"),
        F.count_if(F.col("_b") > 0).alias("distinct_before"), F.count_if(F.col("_a") > 0).alias("distinct_after")), "paired")


def _identity(found: gates.Gates, name: str, cells: DataFrame, distinct: DataFrame, expected: DataFrame) -> None:
    """The ids are 1 to the expected number of records, each once."""
    profile = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.min("min_id").alias("min_id"),
                        F.max("max_id").alias("max_id"))
    profile = reconcile.attach_scalars(reconcile.attach_scalars(profile, distinct.toDF("distinct_ids")), expected)
    found.aggregate(name, profile, F.bool_and(
        (F.col("records") == F.col("distinct_ids")) & (F.col("records") == F.coalesce("expected", F.lit(0)))
        & (F.coalesce("min_id", F.lit(1)) == 1) & (F.coalesce("max_id", F.lit(0)) == F.col("records"))))


def individual_gates(individuals: DataFrame, margins: Margins, reference: str,
                     found: gates.Gates | None = None, domestic: str = DOMESTIC,
                     distinct: DataFrame | None = None) -> gates.Gates:
    """Stages 1 to 3, before any household exists. `distinct` is the number of ids, if it is known."""
    found = found or gates.Gates()
    with_codes = margins.countries is not None
    expected = schemas.INDIVIDUALS if with_codes else without_citizenship(schemas.INDIVIDUALS)
    found.schema("pre_household_schema", individuals, expected)
    rules = {"citizenship_present": F.col("citizenship_code").isNull()} if with_codes else {}
    cells = profiled(individuals, reference, rules)
    if distinct is None:
        distinct = paired(None, individuals).select("distinct_after")
    population = margins.demography.agg(F.sum("n").alias("expected"))
    _identity(found, "pre_household_identity", cells, distinct, population)
    frames = profile_margins(cells, domestic)
    _equal(found, "pre_household_sex_age", margins.demography, frames["sex_age"],
           ["municipality", "sex", "age"])
    if with_codes:
        found.counted(cells, "citizenship_present")
        _equal(found, "pre_household_countries", margins.countries, frames["countries"],
               ["municipality", "sex", "code"])
        _equal(found, "pre_household_foreigners", margins.foreigners, frames["foreigners"],
               ["municipality", "sex", "age"])
    return found


def counted_families(homes: DataFrame, households: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(households that break a family rule, members without a household) from a profile's members.

    Both tables grow with the population, but their compressed files look small enough for a broadcast
    that the driver cannot hold; the hints keep it out.
    """
    place = [F.col(c).alias(f"_{c}") for c in PLACE]
    members = homes.filter(F.col("household_id").isNotNull()).select("household_id", *place, "n", "refs", "adults")
    own = households.select("household_id", "size", *PLACE)
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACE])
    per = own.join(members.hint("merge"), "household_id", "left").groupBy("household_id", "size", *PLACE).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "refs", "adults")],
        F.count_if(F.col("n").isNotNull() & ~same).alias("elsewhere"))
    broken = per.filter((F.col("n") != F.col("size")) | (F.col("refs") != 1) | (F.col("adults") < 1)
                        | (F.col("elsewhere") > 0) | F.col("size").isNull())
    return broken, gates.orphans(members, households.hint("merge"), {"household_id": "household_id"})


def record_gates(persons: DataFrame, households: DataFrame, margins: Margins, reference: str,
                 individuals: DataFrame | None = None, domestic: str = DOMESTIC,
                 profile: tuple[DataFrame, DataFrame] | None = None) -> gates.Gates:
    """All checks of a finished run. Pass the stored tables, read back, and `person_profile`, if it is there.

    Persons are read twice: once for their profile and once by id. Everything else is read from
    these stored aggregates, and from one pass over the households.
    """
    found = gates.Gates()
    with_codes = margins.countries is not None
    found.schema("persons_schema", persons,
                 schemas.PERSONS if with_codes else without_citizenship(schemas.PERSONS))
    found.schema("households_schema", households, schemas.HOUSEHOLDS)
    rules = person_rules(reference, with_codes)
    cells, homes = profile or person_profile(persons, margins, reference)
    pairs = paired(individuals, persons)
    bad_home = F.col("size").isNull() | ~F.col("size").between(1, 6) | ~F.col("data_kind").eqNullSafe("synthetic")
    sizes = materialize(households.groupBy(*PLACE, F.col("size").cast("int").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.min("household_id").alias("min_id"), F.max("household_id").alias("max_id"),
        F.count_if(F.coalesce(bad_home, F.lit(True))).alias("household_domains")), "sizes")
    _identity(found, "person_identity", cells, pairs.select("distinct_after"),
              margins.demography.agg(F.sum("n").alias("expected")))
    _identity(found, "household_identity", sizes, households.agg(F.count_distinct("household_id")),
              margins.households.agg(F.sum("n").alias("expected")))
    found.counted(cells, *rules)
    found.counted(sizes, "household_domains")
    broken, orphans = counted_families(homes, households)
    found.empty("family_integrity", broken)
    found.sums("foreign_keys", orphans, "n")
    frames = profile_margins(cells, domestic)
    _equal(found, "sex_age_joint", margins.demography, frames["sex_age"], ["municipality", "sex", "age"])
    _equal(found, "household_sizes", margins.households, sizes.groupBy("municipality", "size").agg(
        F.sum("n").alias("n")), ["municipality", "size"])
    for name, df in (("persons", cells), ("households", sizes)):
        found.empty(f"{name}_geography", df.select(*PLACE).distinct().join(
            margins.locality.select(*PLACE), PLACE, "left_anti"))
    left_over = totals(margins).select(
        "municipality", (F.col("population") - F.col("capacity")).alias("n"))
    found.empty("residual_by_municipality", reconcile.compare_margins(
        left_over, cells.groupBy("municipality").agg(F.sum("unassigned").alias("n")),
        ["municipality"]).filter("expected <> actual"))
    if with_codes:
        _equal(found, "countries", margins.countries, frames["countries"], ["municipality", "sex", "code"])
        _equal(found, "foreigners", margins.foreigners, frames["foreigners"], ["municipality", "sex", "age"])
    if individuals is not None:
        individual_gates(individuals, margins, reference, found, domestic, pairs.select("distinct_before"))
        found.sums("stages_unchanged", pairs, "changed")
    return found


def stage_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Persons whose attributes a later stage changed; margins alone cannot show a swap."""
    attributes = [c for c in before.columns if c != "person_id"]
    return reconcile.row_diff(before, after, ["person_id"], attributes)


def enrichment_gates(base: DataFrame, enriched: DataFrame, margins: Margins, reference: str,
                     base_households: DataFrame | None = None,
                     households: DataFrame | None = None, domestic: str = DOMESTIC) -> gates.Gates:
    """Adding citizenship must not have touched anything else."""
    found = gates.Gates()
    code = T.StructField("citizenship_code", T.StringType())
    found.schema("enriched_schema", enriched, T.StructType([*base.schema.fields, code]))
    found.empty("base_unchanged", stage_changes(base, enriched))
    if base_households is not None and households is not None:
        found.empty("households_unchanged", reconcile.row_diff(
            base_households, households, ["household_id"],
            [c for c in base_households.columns if c != "household_id"]))
    found.aggregate("enriched_identity", identity_profile(enriched, "person_id"),
                    F.bool_and(F.col("records") == F.col("distinct_ids")))
    found.rows(enriched, citizenship_present=F.col("citizenship_code").isNull())
    frames = margin_frames(enriched, reference, domestic)
    _equal(found, "countries", margins.countries, frames["countries"],
           ["municipality", "sex", "code"])
    _equal(found, "foreigners", margins.foreigners, frames["foreigners"],
           ["municipality", "sex", "age"])
    return found


def country_totals(persons: DataFrame) -> DataFrame:
    return persons.groupBy(F.col("citizenship_code").alias("code")).agg(
        F.count(F.lit(1)).alias("persons"))


def citizenship_split(persons: DataFrame, domestic: str = DOMESTIC,
                      stateless: str = STATELESS) -> DataFrame:
    code = F.col("citizenship_code")
    return persons.agg(
        F.count_if(code == domestic).alias("domestic_persons"),
        F.count_if(code != domestic).alias("foreign_persons"),
        F.count_if(code == stateless).alias("stateless_persons"))


def summary(persons: DataFrame, households: DataFrame, margins: Margins, reference: str,
            rare_k: int = RARE_CELL, domestic: str = DOMESTIC) -> DataFrame:
    """One row of run totals; every part is a one-row aggregate."""
    identifiers = ["municipality", "sex", "birth_year", "birth_year_upper_bound"]
    frames = [
        persons.agg(F.count(F.lit(1)).alias("persons"),
                    F.count_if(F.col("household_id").isNull()).alias("unassigned_adults")),
        households.agg(F.count(F.lit(1)).alias("households")),
        margins.locality.agg(F.count_distinct("municipality").alias("municipalities"),
                             F.count_distinct("province").alias("provinces"),
                             F.count_distinct("region").alias("regions")),
        family_statistics(persons, reference),
    ]
    if "citizenship_code" in persons.columns:
        identifiers.append("citizenship_code")
        frames.append(citizenship_split(persons, domestic))
    frames.append(rare_cells(persons, identifiers, rare_k).withColumnsRenamed(
        {"rare_cells": "cells_below_k", "records": "persons_in_cells_below_k"}))
    return _side_by_side(frames)


def profile_summary(profile: tuple[DataFrame, DataFrame], households: DataFrame, margins: Margins, domestic: str = DOMESTIC,
                    rare_k: int = RARE_CELL) -> DataFrame:
    """`summary` of persons that passed the gates, read from their stored profile.

    Then a cell's age stands for its birth years, and no household has members in two places.
    """
    cells, homes = profile[0], profile[1].filter("household_id is not null")
    minors, seniors = F.col("youngest") < ADULT_AGE, F.col("oldest") >= SENIOR_AGE

    def total(n: Column, name: str) -> Column:
        return F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(name)

    code = F.col("citizenship_code") if "citizenship_code" in cells.columns else None
    n, rare = F.col("n"), F.when(F.col("n") < rare_k, F.col("n"))
    frames = [
        cells.agg(total(n, "persons"), total(F.col("unassigned"), "unassigned_adults")),
        households.agg(F.count(F.lit(1)).alias("households")),
        margins.locality.agg(F.count_distinct("municipality").alias("municipalities"),
                             F.count_distinct("province").alias("provinces"), F.count_distinct("region").alias("regions")),
        homes.agg(F.count_if(minors).alias("households_with_minors"),
                  F.count_if(F.col("youngest") >= SENIOR_AGE).alias("households_only_65_plus"),
                  F.count_if(minors & seniors).alias("households_minors_and_65_plus")),
    ]
    if code is not None:
        frames.append(cells.agg(*[total(F.when(those, n), name) for name, those in (
            ("domestic_persons", code == domestic), ("foreign_persons", code != domestic),
            ("stateless_persons", code == STATELESS))]))
    frames.append(cells.agg(F.count(rare).alias("cells_below_k"), total(rare, "persons_in_cells_below_k")))
    return _side_by_side(frames)


def _side_by_side(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = reconcile.attach_scalars(result, frame)
    return result
