from __future__ import annotations

import pytest
from fixtures import AGES, COUNTRIES, REFERENCE, documents, margins, rows
from pyspark.sql import functions as F

from marginloom import schemas
from marginloom.functions.hashing import hash_key, hash_piece, territorial_seed
from marginloom.operators import expand, gates, ranking
from marginloom.plans import audit, synthesize
from marginloom.plans.margins import (
    Cells,
    Margins,
    coherence_gates,
    dictionary_gates,
    reference_dates_valid,
)
from marginloom.plans.synthesize import Sizing
from marginloom.session import materialize

TINY = Sizing(chunk_rows=2, rows_per_piece=2)


def generate(m: Margins, sizing: Sizing = Sizing()):
    cells = Cells.build(m)
    people = materialize(synthesize.individuals(cells, REFERENCE, sizing=sizing), "i")
    persons = materialize(synthesize.assign_households(people, cells, REFERENCE, sizing), "p")
    return people, persons, materialize(synthesize.households(cells, sizing), "h")


@pytest.fixture(scope="module")
def run(spark):
    m = margins(spark)
    return (m, *generate(m))


def test_every_audit_gate_passes(run):
    m, people, persons, homes = run
    checks = audit.record_gates(persons, homes, m, REFERENCE, people).require()
    assert len(checks) > 20


def test_split_groups_and_chunks_change_nothing(spark, run):
    _, people, persons, homes = run
    small = generate(margins(spark), TINY)
    assert rows(people) == rows(small[0])
    assert rows(persons) == rows(small[1])
    assert rows(homes) == rows(small[2])


@pytest.mark.parametrize("partitions", [1, 17])
def test_partitioning_changes_nothing(spark, run, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        again = generate(margins(spark))
        assert rows(again[1]) == rows(run[2])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_input_order_changes_nothing(spark, run):
    national, extra = documents(spark)
    shuffled = Margins.from_documents(national.orderBy(F.desc("code")),
                                      extra.orderBy(F.desc("code")))
    assert rows(generate(shuffled)[1]) == rows(run[2])


def test_households_do_not_depend_on_citizenship(spark, run):
    plain = generate(margins(spark, citizenship=False))[1]
    assert rows(plain) == rows(run[2].drop("citizenship_code"))


def test_enrichment_equals_the_ordered_pipeline(spark, run):
    m, _, persons, homes = run
    base = materialize(persons.drop("citizenship_code"), "base")
    enriched = synthesize.enrich(base, Cells.build(m), REFERENCE)
    assert rows(enriched) == rows(persons)
    audit.enrichment_gates(base, materialize(enriched, "e"), m, REFERENCE, homes, homes).require()


EDGES = {
    "all_domestic": dict(ages={k: (*v[:2], 0, 0) for k, v in AGES.items()},
                         countries={"100": [10, 10]}),
    "all_foreign": dict(ages={k: (*v[:2], *v[:2]) for k, v in AGES.items()},
                        countries={"201": [4, 10], "202": [6, 0]}),
    "one_sex": dict(ages={30: (4, 0, 2, 0)}, sizes=[2, 1, 0, 0, 0, 0],
                    countries={"100": [2, 0], "300": [2, 0]}),
    "no_households": dict(ages={30: (4, 3, 1, 0)}, sizes=[0] * 6,
                          countries={"100": [3, 3], "300": [1, 0]}),
}


@pytest.mark.parametrize("name", EDGES)
def test_edge_margins(spark, name):
    m = margins(spark, **EDGES[name])
    coherence_gates(m, fixture=True).require()
    people, persons, homes = generate(m)
    audit.record_gates(persons, homes, m, REFERENCE, people).require()


def damage(df, column, value, where):
    kind = df.schema[column].dataType
    return df.withColumn(column, F.when(F.expr(where), F.lit(value)).otherwise(F.col(column)).cast(kind))


FIRST = "person_id = 1"
PERSON_DAMAGE = [
    ("person_id", 1000, FIRST, "person_identity"),
    ("municipality", "970045", FIRST, "sex_age_joint"),
    ("birth_year", 1800, FIRST, "birth_domains"),
    ("sex", "X", FIRST, "person_domains"),
    ("household_id", None, "birth_year = 2021", "person_domains"),
    ("data_kind", "real", FIRST, "person_domains"),
    ("province", "980", FIRST, "persons_geography"),
    ("household_id", 99, FIRST, "foreign_keys"),
    ("reference_adult", True, "true", "family_integrity"),
    ("citizenship_code", None, FIRST, "citizenship_domain"),
    ("citizenship_code", "436", "citizenship_code = '100'", "countries"),
    ("household_id", None, "true", "residual_by_municipality"),
]


@pytest.mark.parametrize("column,value,where,gate", PERSON_DAMAGE,
                         ids=[f"{d[0]}-{d[3]}" for d in PERSON_DAMAGE])
def test_damaged_persons_trip_their_gate(run, failed, column, value, where, gate):
    m, people, persons, homes = run
    broken = damage(persons, column, value, where)
    assert gate in failed(audit.record_gates(broken, homes, m, REFERENCE, people))


@pytest.mark.parametrize("column,value,gate", [
    ("size", 7, "household_domains"), ("size", 5, "household_sizes"),
    ("household_id", 500, "household_identity"), ("region", "98", "households_geography")])
def test_damaged_households_trip_their_gate(run, failed, column, value, gate):
    m, _, persons, homes = run
    broken = damage(homes, column, value, "household_id = 1")
    assert gate in failed(audit.record_gates(persons, broken, m, REFERENCE))


def test_a_swap_that_keeps_all_margins_is_found(run, failed):
    m, people, persons, homes = run
    side = persons.filter("municipality = '970012' and sex = 'M' and birth_year = 1972")
    codes = {r.citizenship_code: r.person_id for r in side.collect()}
    one, two = list(codes.items())[:2]
    swapped = persons.withColumn("citizenship_code", F.when(
        F.col("person_id") == one[1], two[0]).when(
        F.col("person_id") == two[1], one[0]).otherwise(F.col("citizenship_code")))
    found = failed(audit.record_gates(swapped, homes, m, REFERENCE, people))
    assert found == {"stages_unchanged"}


def test_totals_cannot_hide_wrong_ages(run, failed):
    m, people, _, _ = run
    moved = people.withColumn("citizenship_code", F.when(
        F.col("birth_year") == 1972, F.when(F.col("citizenship_code") == "100", "436").otherwise(
            "100")).otherwise(F.col("citizenship_code")))
    assert "pre_household_foreigners" in failed(audit.individual_gates(moved, m, REFERENCE))


MARGIN_DAMAGE = {
    "household_capacity": dict(sizes=[0, 0, 0, 0, 0, 4]),
    "adults_for_references": dict(sizes=[15, 0, 0, 0, 0, 0]),
    "slots_for_minors": dict(sizes=[5, 1, 0, 0, 0, 0]),
    "foreign_totals": dict(countries={**COUNTRIES, "436": [2, 1], "100": [6, 8]}),
    "sex_totals": dict(countries={**COUNTRIES, "100": [8, 8]}),
    "foreign_within_base": dict(ages={**AGES, 100: (1, 1, 1, 2)},
                                countries={**COUNTRIES, "436": [1, 2], "100": [7, 7]}),
    "one_region_per_province": dict(places=[("970012", "970", "97"), ("970045", "970", "98")]),
    "unique_municipalities": dict(places=[("970012", "970", "97"), ("970012", "970", "97")]),
    "namespace": dict(places=[("000001", "001", "01")]),
}


@pytest.mark.parametrize("gate", MARGIN_DAMAGE)
def test_incoherent_margins_are_refused(spark, failed, gate):
    m = margins(spark, **MARGIN_DAMAGE[gate])
    assert gate in failed(coherence_gates(m, fixture=True))


def test_population_ceiling_and_namespace(spark, failed):
    m = margins(spark)
    assert failed(coherence_gates(m, fixture=True)) == set()
    assert "population_total" in failed(coherence_gates(m, fixture=True, max_population=10))
    assert {"namespace", "official_region"} <= failed(coherence_gates(m, fixture=False))


def test_dictionary_gates(spark, failed):
    m = margins(spark)
    labels = [("100", "Italia"), ("436", "Atlantis"), ("999", "Apolide")]
    fixed = {"100": "Italia", "999": "Apolide"}

    def check(rows_):
        return failed(dictionary_gates(
            m.countries, spark.createDataFrame(rows_, "code string, label string"), fixed))

    assert check(labels) == set()
    assert check(labels[:2]) == {"known_countries"}
    assert check([("100", "X"), *labels[1:]]) == {"reserved_100"}
    assert check([*labels, ("20", "Y")]) == {"country_code"}
    assert check([*labels, ("202", " ")]) == {"country_label"}
    assert check([*labels, labels[1]]) == {"unique_country_codes"}
    assert check(labels[1:]) >= {"domestic_code_present", "known_countries"}


@pytest.mark.parametrize("dates,valid", [
    (("2025-01-01", "2024-12-31", "2025-01-01"), True),
    (("2025-01-02", "2025-01-01", "2025-01-02"), False),
    (("2025-01-01", "2024-12-30", "2025-01-01"), False),
    (("2025-01-01", "2024-12-31", "2024-01-01"), False),
    (("1900-01-01", "1899-12-31", "1900-01-01"), False)])
def test_reference_dates(dates, valid):
    assert reference_dates_valid(*dates) is valid


def test_long_margins_keep_or_drop_zeros(spark):
    m = margins(spark)
    assert m.demography.count() == 3 * 202
    assert m.demography.filter("n > 0").count() == 3 * 8
    assert m.countries.count() == 3 * 3 * 2
    national, _ = documents(spark)
    dropped = expand.array_margins(national, ["code"], {"male": "M"}, "age", "sex")
    assert dropped.count() == 3 * 4


def test_prefix_offsets_equal_a_running_sum(spark):
    cells = spark.createDataFrame(
        [("a", 1, 3), ("a", 2, 0), ("a", 3, 4), ("b", 1, 5), ("c", 9, 1)], "g string, k int, n long")
    found = expand.prefix_offsets(cells, [["g"], ["k"]]).orderBy("g", "k").collect()
    assert [r.offset for r in found] == [0, 3, 3, 7, 12]


def test_expansion_of_a_cell_larger_than_a_chunk(spark):
    cells = spark.createDataFrame([("x", 10), ("y", 0), ("z", 1)], "k string, n long")
    found = rows(expand.expand_counts(cells, chunk_rows=3).select("k", "i"))
    assert found == sorted([("x", i) for i in range(10)] + [("z", 0)], key=repr)


def test_cut_ranks_equal_whole_ranks(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), "id").withColumn(
        "key", hash_key("t", "id"))
    sized = ranking.with_group_size(df, ["g"])
    cut = ranking.rank_within(sized, ["g"], "key", ["id"], rows_per_piece=50)
    whole = ranking.rank_within(sized, ["g"], "key", ["id"])
    assert rows(cut.select("id", "rank")) == rows(whole.select("id", "rank"))
    pieces = sized.select(hash_piece(F.col("key"), F.lit(13)).alias("p"), "key")
    assert pieces.agg(F.min("p"), F.max("p")).first() == (0, 12)
    ordered = [r.p for r in pieces.orderBy("key").collect()]
    assert ordered == sorted(ordered)


def test_rows_without_a_group_are_ranked_too(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id long").withColumn(
        "key", hash_key("t", "id"))
    ranked = ranking.rank_within(ranking.with_group_size(df, ["g"]), ["g"], "key", ["id"],
                                 rows_per_piece=1)
    assert rows(ranked.select("g", "rank")) == [("a", 1), (None, 1), (None, 2)]


def test_territorial_seed_is_the_first_64_bits_of_sha256(spark):
    import hashlib

    expected = int.from_bytes(hashlib.sha256(b"space:1701:970012").digest()[:8], "big")
    found = spark.range(1).select(territorial_seed(F.lit("970012"), "space")).first()[0]
    assert int(found) == expected


def test_rare_cells_and_package(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2 + [("c",)] * 1, "k string")
    assert tuple(audit.rare_cells(df, ["k"]).first()) == (2, 3)
    cells = spark.createDataFrame(
        [("01", "M", 5, 10), ("01", "M", 9, 1), ("01", "F", 95, 6), ("01", "F", 100, 4)],
        "region string, sex string, age int, n long")
    assert rows(audit.release_package(cells)) == [("01", "F", 90, 10), ("01", "M", 0, 11)]
    assert audit.release_package(cells, minimum=11).count() == 0
    assert audit.release_package(cells, official=False).count() == 0


def test_schema_gate_wants_names_types_and_order(run):
    persons = run[2]
    assert gates.schema_matches(persons, schemas.PERSONS)
    assert not gates.schema_matches(persons.select(*reversed(persons.columns)), schemas.PERSONS)
    wide = persons.withColumn("birth_year", F.col("birth_year").cast("int"))
    assert not gates.schema_matches(wide, schemas.PERSONS)
