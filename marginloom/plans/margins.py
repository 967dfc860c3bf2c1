"""The admitted margins of a population, in long form, and their feasibility rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginloom.functions.demography import ADULT_AGE
from marginloom.operators import expand, gates, reconcile
from marginloom.session import materialize_all

DOMESTIC = "100"
STATELESS = "999"


@dataclass(frozen=True)
class Margins:
    """locality(municipality, province, region), demography(municipality, sex, age, n),
    households(municipality, size, n) and, for the citizenship stage,
    foreigners(municipality, sex, age, n), countries(municipality, sex, code, n) where countries
    includes the domestic code.
    """

    locality: DataFrame
    demography: DataFrame
    households: DataFrame
    foreigners: DataFrame | None = None
    countries: DataFrame | None = None

    @classmethod
    def from_documents(cls, national: DataFrame, citizenship: DataFrame | None = None) -> Margins:
        """From one row per municipality with count arrays (and a map of country counts)."""
        base = national.withColumnRenamed("code", "municipality")
        sizes = base.select("municipality", F.posexplode("households").alias("_p", "n")).select(
            "municipality", (F.col("_p") + 1).alias("size"), "n")
        foreigners = countries = None
        if citizenship is not None:
            extra = citizenship.withColumnRenamed("code", "municipality")
            foreigners = expand.array_margins(
                extra, ["municipality"], {"foreign_male": "M", "foreign_female": "F"},
                "age", "sex", keep_zeros=True)
            countries = expand.map_margins(
                extra, ["municipality"], "countries", ["M", "F"], "code", "sex", keep_zeros=True)
        return cls(
            locality=base.select("municipality", "province", "region"),
            demography=expand.array_margins(
                base, ["municipality"], {"male": "M", "female": "F"}, "age", "sex",
                keep_zeros=True),
            households=sizes,
            foreigners=foreigners,
            countries=countries,
        )


def totals(margins: Margins) -> DataFrame:
    """Per municipality: population, minors, households, capacity."""
    people = margins.demography.groupBy("municipality").agg(
        F.sum("n").cast("long").alias("population"),
        F.sum(F.when(F.col("age") < ADULT_AGE, F.col("n")).otherwise(0)).cast("long")
        .alias("minors"))
    homes = margins.households.groupBy("municipality").agg(
        F.sum("n").cast("long").alias("households"),
        F.sum(F.col("n") * F.col("size")).cast("long").alias("capacity"))
    return people.join(homes, "municipality", "left").select(
        "municipality", "population", "minors",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("households", "capacity")])


def feasibility(margins: Margins) -> DataFrame:
    """Totals with the three rules that make a household assignment possible."""
    population, minors, homes, capacity = (
        F.col(c) for c in ("population", "minors", "households", "capacity"))
    return totals(margins).select(
        "municipality", population, minors, homes, capacity,
        (capacity <= population).alias("capacity_fits"),
        (population - minors >= homes).alias("adults_suffice"),
        (minors <= capacity - homes).alias("slots_suffice"),
    )


@dataclass(frozen=True)
class Cells:
    """The three small tables that the generation stages expand.

    persons: one row per (municipality, sex, age) with geography, id offset, foreign quota and the
    sizes of every group a later stage ranks in. households: one row per (municipality, size).
    countries: one row per foreign (municipality, sex, code), or None without citizenship.
    Everything a stage needs to know about a group is a column here, so it rides along with the
    expansion and no stage joins or counts the people again to learn it.
    """

    persons: DataFrame
    households: DataFrame
    countries: DataFrame | None
    largest: dict[str, int] | None = None

    @classmethod
    def build(cls, margins: Margins, domestic: str = DOMESTIC) -> Cells:
        """Write the cells to the shared folder: later plans start from scans of known size
        instead of repeating the derivation, and the size of every group is known up front."""
        frames = {"persons": _person_cells(margins), "households": _household_cells(margins)}
        if margins.foreigners is not None and margins.countries is not None:
            frames["countries"] = _country_cells(margins, domestic)
        stored = materialize_all(**frames)
        return cls(stored["persons"], stored["households"], stored.get("countries"),
                   _largest_groups(stored["persons"], stored["households"]))


# Column that holds the size of the groups a stage ranks in.
_GROUP_SIZES = {"persons": ("n", "stage_size", "foreign_pool"),
                "households": ("household_total", "slot_total")}


def _largest_groups(persons: DataFrame, households: DataFrame) -> dict[str, int]:
    """Largest group per size column: one small row per table."""
    found: dict[str, int] = {}
    for df, columns in ((persons, _GROUP_SIZES["persons"]),
                        (households, _GROUP_SIZES["households"])):
        present = [c for c in columns if c in df.columns]
        row = df.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in present]).first()
        found.update(row.asDict())
    return found


def _person_cells(margins: Margins) -> DataFrame:
    # A municipality has at most 202 cells. Partitioned by it once, every window below is local.
    cells = margins.demography.filter("n > 0").join(
        margins.locality, "municipality").repartition("municipality")
    cells = expand.prefix_offsets(
        cells, [["province"], ["municipality"], ["sex", "age"]], offset="person_offset")
    minor = F.col("age") < ADULT_AGE
    by_place = Window.partitionBy("municipality")
    homes = margins.households.groupBy("municipality").agg(
        F.sum("n").cast("long").alias("household_total"))
    cells = (
        cells.withColumn("is_minor", minor)
        .withColumn("minor_total", F.sum(F.when(minor, F.col("n")).otherwise(0)).over(by_place)
                    .cast("long"))
        .withColumn("_all", F.sum("n").over(by_place).cast("long"))
        .withColumn("stage_size", F.when(minor, F.col("minor_total")).otherwise(
            F.col("_all") - F.col("minor_total")))
        .drop("_all")
        # One long per ranking group: cheaper to shuffle and sort by than the labels it stands for.
        .withColumn("stage_id", F.min("person_offset").over(
            Window.partitionBy("municipality", "is_minor")))
        .withColumn("pool_id", F.min("person_offset").over(
            Window.partitionBy("municipality", "sex")))
        .join(homes, "municipality", "left")
        .fillna(0, ["household_total"])
    )
    if margins.foreigners is None:
        return cells
    by_side = Window.partitionBy("municipality", "sex")
    quota = margins.foreigners.select(
        "municipality", "sex", "age", F.col("n").cast("long").alias("foreign"))
    return (
        cells.join(quota, ["municipality", "sex", "age"], "left")
        .fillna(0, ["foreign"])
        .withColumn("foreign_pool", F.sum("foreign").over(by_side).cast("long"))
    )


def _household_cells(margins: Margins) -> DataFrame:
    cells = margins.households.filter("n > 0").join(margins.locality, "municipality")
    cells = expand.prefix_offsets(
        cells, [["province"], ["municipality"], ["size"]], offset="household_offset")
    by_place = Window.partitionBy("municipality")
    return (
        cells.withColumn("household_total", F.sum("n").over(by_place).cast("long"))
        .withColumn("slot_total",
                    F.sum(F.col("n") * (F.col("size") - 1)).over(by_place).cast("long"))
        .withColumn("place_offset", F.min("household_offset").over(by_place))
    )


def _country_cells(margins: Margins, domestic: str) -> DataFrame:
    by_side = Window.partitionBy("municipality", "sex")
    foreign = margins.countries.filter((F.col("code") != domestic) & (F.col("n") > 0))
    return foreign.withColumn("foreign_pool", F.sum("n").over(by_side).cast("long"))


def expected_margins(margins: Margins) -> DataFrame:
    """(municipality, kind, sex, category, n) for every kind of margin, zeros kept."""
    columns = ("municipality", "kind", "sex", "category", "n")

    def kind(df: DataFrame, name: str, category: str, sex: str | None = "sex") -> DataFrame:
        side = F.col(sex) if sex else F.lit("*")
        return df.select("municipality", F.lit(name).alias("kind"), side.alias("sex"),
                         F.col(category).cast("int").alias("category"), F.col("n").cast("long")
                         ).select(*columns)

    result = kind(margins.demography, "sex_age", "age").unionByName(
        kind(margins.households, "household_size", "size", sex=None))
    if margins.foreigners is not None and margins.countries is not None:
        result = result.unionByName(kind(margins.foreigners, "foreign_age", "age")).unionByName(
            kind(margins.countries, "citizenship", "code"))
    return result


def coherence_gates(margins: Margins, fixture: bool | None = None,
                    max_population: int | None = None,
                    domestic: str = DOMESTIC) -> gates.Gates:
    """Everything that must hold between margins before a person is generated.

    `fixture` states whether the codes must lie in the namespace of invented data (True), outside
    of it (False) or are not checked (None). `max_population` is a reviewed ceiling, if there is one.
    """
    place = margins.locality
    found = gates.Gates()
    found.unique("unique_municipalities", place, ["municipality"])
    found.empty("one_region_per_province", place.groupBy("province").agg(
        F.countDistinct("region").alias("regions")).filter("regions <> 1"))
    invented = ((F.col("region").cast("int") >= 90) & (F.col("province").cast("int") >= 900))
    if fixture is not None:
        found.rows(place, namespace=invented != F.lit(fixture))
    if fixture is False:
        found.rows(place, official_region=~F.col("region").cast("int").between(1, 20))
    ceiling = F.lit(True) if max_population is None else F.sum("n") <= max_population
    found.aggregate("population_total", margins.demography, (F.sum("n") > 0) & ceiling)
    found.rows(feasibility(margins), household_capacity=~F.col("capacity_fits"),
               adults_for_references=~F.col("adults_suffice"),
               slots_for_minors=~F.col("slots_suffice"))
    for name, df in (("demography", margins.demography), ("households", margins.households)):
        found.rows(df, **{f"{name}_counts": F.col("n") < 0})
        found.empty(f"{name}_places", gates.set_difference(df, place, ["municipality"]))
    found.unique("unique_demography", margins.demography, ["municipality", "sex", "age"])
    found.unique("unique_household_sizes", margins.households, ["municipality", "size"])
    if margins.foreigners is None or margins.countries is None:
        return found
    foreign_by_age = _by_sex(margins.foreigners)
    foreign_by_code = _by_sex(margins.countries.filter(F.col("code") != domestic))
    cells = reconcile.compare_margins(
        margins.foreigners, margins.demography, ["municipality", "sex", "age"])
    found.unique("unique_foreigners", margins.foreigners, ["municipality", "sex", "age"])
    found.unique("unique_countries", margins.countries, ["municipality", "sex", "code"])
    found.empty("citizenship_coverage",
                gates.set_difference(margins.countries, place, ["municipality"]))
    found.rows(cells, foreign_within_base=F.col("expected") > F.col("actual"))
    found.rows(reconcile.compare_margins(foreign_by_age, foreign_by_code, ["municipality", "sex"]),
               foreign_totals=F.col("expected") != F.col("actual"))
    found.rows(reconcile.compare_margins(_by_sex(margins.countries), _by_sex(margins.demography),
                                         ["municipality", "sex"]),
               sex_totals=F.col("expected") != F.col("actual"))
    return found


def _by_sex(df: DataFrame) -> DataFrame:
    return df.groupBy("municipality", "sex").agg(F.sum("n").cast("long").alias("n"))


def dictionary_gates(countries: DataFrame, labels: DataFrame,
                     reserved: dict[str, str] | None = None) -> gates.Gates:
    """Country codes are known, three digits, labelled; reserved codes keep their meaning."""
    found = gates.Gates()
    found.rows(labels, country_code=~F.col("code").rlike(r"\A[0-9]{3}\z"),
               country_label=F.trim("label") == "")
    found.unique("unique_country_codes", labels, ["code"])
    for code, label in (reserved or {}).items():
        found.rows(labels.filter(F.col("code") == code),
                   **{f"reserved_{code}": F.col("label") != label})
    if reserved and DOMESTIC in reserved:
        found.aggregate("domestic_code_present", labels,
                        F.count_if(F.col("code") == DOMESTIC) == 1)
    found.empty("known_countries", gates.orphans(countries, labels, {"code": "code"}))
    return found


def reference_dates_valid(population: str, households: str, geography: str) -> bool:
    """January 1 after 1900; households the day before; geography of the same day."""
    from datetime import date, timedelta

    day = date.fromisoformat(population)
    return (
        (day.month, day.day) == (1, 1) and day.year >= 1901
        and date.fromisoformat(households) == day - timedelta(days=1)
        and geography == population
    )
