"""Margins to microdata in four ordered stages: sex/age, geography, citizenship, households."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginloom.functions.demography import (
    ADULT_AGE,
    age_from_cohort,
    birth_year,
    birth_year_upper_bound,
    cohort_reference_year,
)
from marginloom.functions.hashing import hash_key
from marginloom.operators.expand import CHUNK_ROWS, expand_counts
from marginloom.operators.ranking import ROWS_PER_PIECE, match_by_rank, rank_within
from marginloom.plans.margins import DOMESTIC, Cells
from marginloom.session import materialize

DATA_KIND = "synthetic"
CITIZENSHIP_ATTRIBUTES = ("n", "person_offset", "foreign", "pool_id", "foreign_pool")


@dataclass(frozen=True)
class Sizing:
    """Upper bounds on what one task expands or ranks; they never change a result."""

    chunk_rows: int = CHUNK_ROWS
    rows_per_piece: int = ROWS_PER_PIECE


def people(cells: Cells, sizing: Sizing = Sizing()) -> DataFrame:
    """Stages 1 and 2: one row per person with a stable id, geography and cell attributes.

    Geography is joined to the cells before the expansion, so no person row is ever joined to it.
    Where every cell is one chunk, its persons stand together, as the draw of foreigners needs them.
    """
    largest = (cells.largest or {}).get("n")
    together = ["person_offset"] if largest is not None and largest <= sizing.chunk_rows else []
    rows = expand_counts(cells.persons, "n", "i", sizing.chunk_rows, together=together)
    return rows.withColumn("person_id", F.col("person_offset") + F.col("i") + 1)


def assign_citizenship(persons: DataFrame, cells: Cells, domestic: str = DOMESTIC,
                       sizing: Sizing = Sizing(), status: str | None = None) -> DataFrame:
    """Stage 3: add `citizenship_code` to persons that carry their cell attributes.

    Needs person_id, municipality, sex, n (size of the demographic cell), person_offset (identity of
    the cell), foreign (how many of the cell to draw), pool_id and foreign_pool (identity of the
    municipality and sex, and how many are drawn in it). Exactly the published
    number of foreigners is drawn per cell, and the published citizenships are shuffled over them.
    Persons that are not drawn keep the domestic code without being joined.

    Every person stays: drawn persons without a slot and persons without a cell have the domestic
    code as well. With `status`, a column of that name tells them apart: drawn, not_drawn, no_slot
    or no_cell.
    """
    columns = persons.columns
    largest = cells.largest or {}

    def draw(people_: DataFrame) -> DataFrame:
        keyed = people_.filter("foreign > 0").withColumn("_key", hash_key("nationality-draw", "municipality", "person_id"))
        return rank_within(keyed, ["person_offset"], "_key", ["person_id"], "n", "_draw",
                           sizing.rows_per_piece, largest=largest.get("n"))

    def keyed_winners(drawn_: DataFrame) -> DataFrame:
        return drawn_.filter("_draw <= foreign").withColumn(
            "_key", hash_key("nationality-turn", "person_id"))

    # Stored: the draw is sorted once, for the drawn, for the others and for the counts of large pools.
    drawn = materialize(draw(persons).select(*columns, "_draw"), "drawn")
    large = drawn.filter(F.col("foreign_pool") > sizing.rows_per_piece)
    chosen = rank_within(
        keyed_winners(drawn), ["pool_id"], "_key", ["person_id"], "foreign_pool", "_rank",
        sizing.rows_per_piece, keyed_winners(large), largest.get("foreign_pool"))
    kept = drawn.filter("_draw > foreign").select(*columns).unionByName(
        persons.filter("foreign IS NULL OR foreign <= 0").select(*columns))
    slots = citizenship_slots(cells, sizing).select(
        "municipality", "sex", F.col("rank").alias("_rank"), F.col("code").alias("_code"))
    def state(value: Column) -> list[Column]:
        return [] if status is None else [value.alias(status)]

    matched = match_by_rank(chosen, slots, ["municipality", "sex"], "_rank", "left").select(
        *columns, F.coalesce("_code", F.lit(domestic)).alias("citizenship_code"),
        *state(F.when(F.col("_code").isNull(), "no_slot").otherwise("drawn")))
    return matched.unionByName(kept.select(
        *columns, F.lit(domestic).alias("citizenship_code"),
        *state(F.when(F.col("foreign").isNull(), "no_cell").otherwise("not_drawn"))))


def citizenship_slots(cells: Cells, sizing: Sizing = Sizing()) -> DataFrame:
    """One slot per counted foreign citizenship, shuffled within (municipality, sex)."""
    slots = expand_counts(cells.countries, "n", "i", sizing.chunk_rows).withColumn(
        "_key", hash_key("nationality-passport", "municipality", "code", "i"))
    ranked = rank_within(slots, ["municipality", "sex"], "_key", ["code", "i"], "foreign_pool",
                         "rank", sizing.rows_per_piece,
                         largest=(cells.largest or {}).get("foreign_pool"))
    return ranked.select("municipality", "sex", "code", "rank")


def individuals(cells: Cells, reference: str, domestic: str = DOMESTIC,
                sizing: Sizing = Sizing()) -> DataFrame:
    """Stages 1 to 3: the table of persons before any household exists."""
    cohort = cohort_reference_year(reference)
    rows = people(cells, sizing)
    columns = ["person_id", "municipality", "province", "region", "sex", "age"]
    extra = []
    if cells.countries is not None:
        rows = assign_citizenship(rows.select(*columns, *CITIZENSHIP_ATTRIBUTES), cells, domestic,
                                  sizing)
        extra = ["citizenship_code"]
    return rows.select(
        "person_id", "municipality", "province", "region",
        birth_year(F.col("age"), cohort).alias("birth_year"),
        birth_year_upper_bound(F.col("age"), cohort).alias("birth_year_upper_bound"),
        "sex", F.lit(DATA_KIND).alias("data_kind"), *extra,
    )


def household_rows(cells: Cells, sizing: Sizing = Sizing()) -> DataFrame:
    """Expanded households with stable ids; also what the seats are made from."""
    rows = expand_counts(cells.households, "n", "i", sizing.chunk_rows)
    return rows.withColumn("household_id", F.col("household_offset") + F.col("i") + 1)


def households(cells: Cells, sizing: Sizing = Sizing()) -> DataFrame:
    return household_rows(cells, sizing).select(
        "household_id", "municipality", "province", "region",
        F.col("size").cast("short").alias("size"), F.lit(DATA_KIND).alias("data_kind"))


def seats(cells: Cells, sizing: Sizing = Sizing()) -> DataFrame:
    """(municipality, seat, household_id): shuffled reference seats 1..H, then the other members."""
    rows = household_rows(cells, sizing)
    largest = cells.largest or {}
    first = rank_within(
        rows.withColumn("_key", hash_key("fam/1", "municipality", "size", "i")),
        ["place_offset"], "_key", ["size", "i"], "household_total", "seat", sizing.rows_per_piece,
        largest=largest.get("household_total"))
    members = (
        rows.filter("size > 1")
        .withColumn("local_id", F.col("household_id") - F.col("place_offset"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("size") - 2)))
        .withColumn("_key", hash_key("slot/1", "municipality", "local_id", "j"))
    )
    others = rank_within(members, ["place_offset"], "_key", ["local_id", "j"], "slot_total",
                         "_rank", sizing.rows_per_piece, largest=largest.get("slot_total"))
    others = others.withColumn("seat", F.col("household_total") + F.col("_rank"))
    return first.select("municipality", "seat", "household_id").unionByName(
        others.select("municipality", "seat", "household_id"))


def with_cells(persons: DataFrame, cells: Cells, reference: str, *attributes: str) -> DataFrame:
    """Persons with their age and attributes of their demographic cell, NULL if they have none."""
    cohort = cohort_reference_year(reference)
    age = age_from_cohort(F.col("birth_year"), F.col("birth_year_upper_bound"), cohort)
    keys = ["municipality", "sex", "age"]
    return persons.withColumn("age", age).join(
        cells.persons.select(*keys, *attributes), keys, "left")


def allocation_ranks(persons: DataFrame, cells: Cells, reference: str,
                     sizing: Sizing = Sizing()) -> DataFrame:
    """Shuffled rank of each person among the adults, or the minors, of a municipality.

    The ordinal inside the demographic cell is arithmetic on the stable id, and the rank depends on
    demography only: citizenship never influences households. Large groups are counted from the
    cells, not from the stored persons. Persons without a cell have no rank.
    """
    key = hash_key("alloc/1", "municipality", "sex", "age", "i")
    rows = (
        with_cells(persons, cells, reference, "person_offset", "stage_id", "minor_total",
                   "stage_size", "household_total")
        .withColumn("i", F.col("person_id") - F.col("person_offset") - 1)
        .withColumn("_key", key)
        # A group of their own for persons without a cell, so that they do not pile up in one task.
        .withColumn("stage_id", F.coalesce("stage_id", _nowhere()))
    )
    large = cells.persons.filter(F.col("stage_size") > sizing.rows_per_piece)
    counted = expand_counts(large, "n", "i", sizing.chunk_rows).withColumn("_key", key)
    ranked = rank_within(rows, ["stage_id"], "_key", ["sex", "age", "i"],
                         "stage_size", "allocation_rank", sizing.rows_per_piece,
                         counted, (cells.largest or {}).get("stage_size")).drop("_key")
    return ranked.withColumn("allocation_rank", F.when(
        F.col("stage_size").isNotNull(), F.col("allocation_rank")))


def _nowhere() -> Column:
    """A negative number, so no group and no seat, that spreads persons without a cell."""
    return -1 - F.pmod(F.xxhash64("person_id"), F.lit(1 << 40))


def assign_households(persons: DataFrame, cells: Cells, reference: str,
                      sizing: Sizing = Sizing()) -> DataFrame:
    """Stage 4: adults 1..H become reference adults, minors and then adults fill other seats.

    One seat number per person replaces two joins with conditional keys: no key is NULL, so nobody
    piles up in one partition, and the join on (municipality, seat) is spread evenly. Persons without a
    seat or a cell stay, with no household.
    """
    ranked = allocation_ranks(persons, cells, reference, sizing)
    rank = F.col("allocation_rank")
    reference_adult = F.coalesce(
        (F.col("age") >= ADULT_AGE) & (rank <= F.col("household_total")), F.lit(False))
    seat = (
        F.when(rank.isNull(), _nowhere())
        .when(F.col("age") < ADULT_AGE, F.col("household_total") + rank)
        .when(reference_adult, rank)
        .otherwise(F.col("minor_total") + rank)
    )
    rows = ranked.withColumn("seat", seat).withColumn("reference_adult", reference_adult)
    extra = [c for c in ("citizenship_code",) if c in persons.columns]
    return match_by_rank(rows, seats(cells, sizing), ["municipality"], "seat", "left").select(
        "person_id", "household_id", "municipality", "province", "region", "birth_year",
        "birth_year_upper_bound", "sex", "reference_adult", "data_kind", *extra)


def enrich(persons: DataFrame, cells: Cells, reference: str, domestic: str = DOMESTIC,
           sizing: Sizing = Sizing(), status: str | None = None) -> DataFrame:
    """Add citizenship to an existing persons table; every row and every other column is left alone.

    `status` names a further column, see `assign_citizenship`.
    """
    if cells.countries is None:
        raise ValueError("Citizenship margins are required")
    aged = with_cells(persons, cells, reference, *CITIZENSHIP_ATTRIBUTES)
    done = assign_citizenship(aged, cells, domestic, sizing, status)
    return done.select(*persons.columns, "citizenship_code", *([] if status is None else [status]))
