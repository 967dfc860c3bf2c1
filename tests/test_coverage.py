"""Bundle rules: a valid bundle passes, and each damage trips the gate that is meant for it."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from fixtures import rows
from pyspark.sql import functions as F

from marginloom import schemas
from marginloom.operators.gates import QualityError, schema_matches
from marginloom.plans import coverage as C
from marginloom.plans import releases as R
from marginloom.session import materialize

DAYS = (date(2020, 1, 1), date(2021, 1, 1))
SHARES = {"total": 100, "male": 45, "female": 55, "young": 20, "older": 80}
SERIES = [("total", "TOTAL", "TOTAL"), ("male", "M", "TOTAL"), ("female", "F", "TOTAL"),
          ("young", "TOTAL", "0:25"), ("older", "TOTAL", "25:1000")]
# A and B merge into C, D splits into E and F.
TREE = {
    DAYS[0]: [("IT", "country", None, 300), ("R1", "region", "IT", 180), ("R2", "region", "IT", 120),
              ("A", "municipality", "R1", 140), ("B", "municipality", "R1", 40),
              ("D", "municipality", "R2", 120)],
    DAYS[1]: [("IT", "country", None, 280), ("R1", "region", "IT", 160), ("R2", "region", "IT", 120),
              ("C", "municipality", "R1", 160), ("E", "municipality", "R2", 80),
              ("F", "municipality", "R2", 40)],
}


def key(day, code):
    return f"{day}:{code}"


class Bundle:
    def __init__(self, spark):
        self.spark = spark
        self.territories = [
            (key(d, c), f"S:{d}", c, f"name {c}", level, d, date(d.year, 1, 2), d,
             p and key(d, p)) for d, tree in TREE.items() for c, level, p, _ in tree]
        self.series = [(c, c, "persons", {"measure": "m", "sex": s, "age": a})
                       for c, s, a in SERIES]
        self.observations = [
            (key(d, c), s, d, Decimal(n * share) / 100, "demo", "", "", "", "")
            for d, tree in TREE.items() for c, _, _, n in tree for s, share in SHARES.items()]
        self.changes = [
            ("e1", "merger", DAYS[1], "urn:x", "a" * 64, "merge", [key(DAYS[0], "A"),
             key(DAYS[0], "B")], [key(DAYS[1], "C")], "exact"),
            ("e2", "split", DAYS[1], "urn:x", "a" * 64, "split", [key(DAYS[0], "D")],
             [key(DAYS[1], "E"), key(DAYS[1], "F")], "structural")]
        self.evidence = [("e", "p", "a" * 64, "urn:x", "2021-01-01T00:00:00+00:00")]

    def frame(self, name):
        schema = {"territories": schemas.TERRITORIES, "series": schemas.SERIES,
                  "observations": schemas.OBSERVATIONS, "changes": schemas.CHANGES,
                  "evidence": schemas.EVIDENCE}[name]
        return self.spark.createDataFrame(getattr(self, name), schema)

    def edit(self, table_name, index, **values):
        table = getattr(self, table_name)
        names = {"territories": schemas.TERRITORIES, "series": schemas.SERIES,
                 "observations": schemas.OBSERVATIONS, "changes": schemas.CHANGES}[table_name].names
        row = dict(zip(names, table[index]), **values)
        table[index] = tuple(row[n] for n in names)
        return self

    def equations(self):
        t, s, o = (self.frame(n) for n in ("territories", "series", "observations"))
        geo, dim = C.territory_equations(o, t), C.dimension_equations(o, t, s)
        return geo[0].unionByName(dim[0]), geo[1].unionByName(dim[1])


@pytest.fixture
def bundle(spark):
    return Bundle(spark)


def test_valid_bundle(bundle):
    t, s, o = (bundle.frame(n) for n in ("territories", "series", "observations"))
    equations, parts = bundle.equations()
    assert equations.groupBy("dimension").count().orderBy("dimension").collect() == [
        ("age", 12), ("sex", 12), ("territory", 5 * 2 + 5 * 2)]
    members = C.coverage_members(o, t)
    checks = C.bundle_gates(t, s, o, members, equations, parts, bundle.frame("changes"),
                            bundle.frame("evidence"), True, ("total", "2021-01-01")).require()
    assert len(checks) > 40


TERRITORY_DAMAGE = [
    ({"name": "  "}, 1, "territorial_validity"),
    ({"valid_to": date(2020, 1, 1)}, 1, "territorial_validity"),
    ({"parent_key": None}, 1, "territorial_root"),
    ({"parent_key": "nowhere"}, 1, "hierarchy"),
    ({"level": "country"}, 3, "hierarchy"),
    ({"scheme": "other"}, 3, "hierarchy"),
    ({"key": "2020-01-01:R1"}, 2, "unique_territories"),
    ({"code": "R1", "valid_to": date(2020, 6, 1)}, 2, "territorial_overlap"),
]


@pytest.mark.parametrize("change,index,gate", TERRITORY_DAMAGE,
                         ids=[f"{i}-{d[2]}" for i, d in enumerate(TERRITORY_DAMAGE)])
def test_damaged_territories(bundle, failed, change, index, gate):
    bundle.edit("territories", index, **change)
    assert gate in failed(C.territory_gates(bundle.frame("territories")))


OBSERVATION_DAMAGE = [
    ({"value": None}, "null_status"), ({"status": "missing"}, "null_status"),
    ({"value": Decimal(-1)}, "numeric_range"), ({"value": Decimal("1.5")}, "numeric_range"),
    ({"status": "estimated"}, "source_status"),
    ({"territory_key": "nowhere"}, "observation_context"),
    ({"series_code": "other"}, "observation_context"),
    ({"period": date(2020, 1, 2)}, "observation_context"),
    ({"series_code": "male"}, "unique_observations"),
]


@pytest.mark.parametrize("change,gate", OBSERVATION_DAMAGE,
                         ids=[f"{i}-{d[1]}" for i, d in enumerate(OBSERVATION_DAMAGE)])
def test_damaged_observations(bundle, failed, change, gate):
    bundle.edit("observations", 0, **change)
    assert gate in failed(C.observation_gates(*[bundle.frame(n) for n in (
        "observations", "territories", "series")], True))


def test_coverage_must_equal_the_observations(bundle, failed):
    t, o = bundle.frame("territories"), bundle.frame("observations")
    members = C.coverage_members(o, t)
    assert failed(C.coverage_gates(members, o, t, ("total", "2020-01-01"))) == set()
    assert failed(C.coverage_gates(members.filter("territory_key <> '2020-01-01:A'"), o, t)) == {
        "coverage_exact"}
    assert failed(C.coverage_gates(members.unionByName(members.limit(1)), o, t)) == {
        "coverage_unique"}
    other = members.withColumn("scheme", F.when(
        F.col("territory_key") == "2020-01-01:A", "X").otherwise(F.col("scheme")))
    assert failed(C.coverage_gates(other, o, t)) == {"coverage_single_vintage", "coverage_vintage"}
    assert failed(C.coverage_gates(members, o, t, ("none", "2020-01-01"))) == {"default_selection"}
    nested = members.groupBy("series_code", "period", "scheme", "snapshot").agg(
        F.collect_list("territory_key").alias("territory_keys"))
    assert rows(C.explode_coverage(nested)) == rows(members.select(
        "series_code", "period", "scheme", "snapshot", "territory_key"))


def equation_failures(bundle, failed, equations=None, parts=None):
    t, s, o = (bundle.frame(n) for n in ("territories", "series", "observations"))
    if equations is None:
        equations, parts = Bundle(bundle.spark).equations()
    equations, parts = materialize(equations, "equations"), materialize(parts, "parts")
    terms = materialize(C.equation_terms(equations, parts, o, t, s), "terms")
    return failed(C.equation_gates(equations, parts, terms))


EQUATION_DAMAGE = [
    ("observations", 0, {"value": Decimal(99)}, "equation_reconciliation"),
    ("observations", 0, {"value": None, "status": "missing"}, "equation_cells"),
    ("series", 1, {"unit": "households"}, "comparable_units_periods"),
    ("series", 0, {"dimensions": {"measure": "m", "sex": "M", "age": "TOTAL"}}, "partition_total"),
    ("series", 1, {"dimensions": {"measure": "x", "sex": "M", "age": "TOTAL"}},
     "partition_dimensions"),
    ("series", 1, {"dimensions": {"measure": "m", "sex": "F", "age": "TOTAL"}}, "distinct_labels"),
    ("series", 1, {"dimensions": {"measure": "m", "sex": "Z", "age": "TOTAL"}},
     "partition_labels_sex"),
    ("series", 3, {"dimensions": {"measure": "m", "sex": "TOTAL", "age": "0:14"}},
     "partition_ranges"),
    ("series", 4, {"dimensions": {"measure": "m", "sex": "TOTAL", "age": "15:99"}},
     "partition_ranges"),
    ("series", 3, {"dimensions": {"measure": "m", "sex": "TOTAL", "age": "TOTAL"}},
     "partition_categories"),
    ("territories", 3, {"parent_key": "2020-01-01:R2"}, "disjoint_territories"),
]


@pytest.mark.parametrize("table,index,change,gate", EQUATION_DAMAGE,
                         ids=[f"{i}-{d[3]}" for i, d in enumerate(EQUATION_DAMAGE)])
def test_damaged_equations(bundle, failed, table, index, change, gate):
    bundle.edit(table, index, **change)
    assert gate in equation_failures(bundle, failed)


def test_equation_identity(bundle, failed):
    equations, parts = bundle.equations()
    single = parts.filter("name <> 'sex:2020-01-01:A:total' or series_code = 'male'")
    assert "equation_identity" in equation_failures(bundle, failed, equations, single)
    twice = parts.unionByName(parts.limit(1))
    assert "disjoint_keys" in equation_failures(bundle, failed, equations, twice)
    assert "equation_names" in equation_failures(
        bundle, failed, equations.unionByName(equations.limit(1)), parts)
    own = equations.select("name", *C.CELL)
    assert "total_not_a_part" in equation_failures(
        bundle, failed, equations, parts.unionByName(own))
    negative = equations.withColumn("tolerance", F.lit(-1).cast("decimal(20,6)"))
    assert "equation_tolerance" in equation_failures(bundle, failed, negative, parts)


def test_tolerance_allows_a_difference(bundle, failed):
    equations, parts = bundle.equations()
    bundle.edit("observations", 0, value=Decimal(299))
    wide = equations.withColumn("tolerance", F.lit(1).cast("decimal(20,6)"))
    assert equation_failures(bundle, failed, wide, parts) == set()


CHANGE_DAMAGE = [
    ({"event_id": "e2"}, "event_identity"), ({"evidence_sha256": "b" * 64}, "event_evidence"),
    ({"from_keys": []}, "event_members"),
    ({"from_keys": [key(DAYS[0], "A")] * 2}, "event_members"),
    ({"from_keys": [key(DAYS[0], "A"), "nowhere"]}, "event_known_members"),
    ({"effective_date": date(2019, 1, 1)}, "event_time"),
    ({"effective_date": date(2022, 1, 1)}, "event_time"),
    ({"from_keys": [key(DAYS[0], "A"), key(DAYS[0], "R1")]}, "event_level"),
    ({"kind": "recode"}, "event_cardinality"), ({"kind": "split"}, "no_invented_weights"),
]


@pytest.mark.parametrize("change,gate", CHANGE_DAMAGE,
                         ids=[f"{i}-{d[1]}" for i, d in enumerate(CHANGE_DAMAGE)])
def test_damaged_changes(bundle, failed, change, gate):
    bundle.edit("changes", 0, **change)
    assert gate in failed(C.change_gates(*[bundle.frame(n) for n in (
        "changes", "territories", "evidence")]))


def test_changes_must_explain_codes(bundle):
    t, changes = bundle.frame("territories"), bundle.frame("changes")
    assert C.unexplained_changes(t, changes).count() == 0
    left = rows(C.unexplained_changes(t, changes.filter("event_id = 'e1'")).select(
        "code", "change"))
    assert left == [("D", "removed"), ("E", "added"), ("F", "added")]


def test_exact_reaggregation_and_refusals(spark, bundle):
    values = spark.createDataFrame([(key(DAYS[0], "A"), Decimal(20)), (key(DAYS[0], "B"),
                                   Decimal(40))], "key string, value decimal(20,6)")
    exact = bundle.frame("changes").filter("event_id = 'e1'")
    assert rows(C.reaggregate_exact(values, exact)) == [(key(DAYS[1], "C"), Decimal(60))]
    more = values.unionByName(spark.createDataFrame(
        [(key(DAYS[0], "D"), Decimal(1))], values.schema))
    overlap = exact.unionByName(exact.withColumn("event_id", F.lit("e9")))
    for wrong in ((values.limit(1), exact), (more, exact), (values, overlap),
                  (more, bundle.frame("changes"))):
        with pytest.raises(QualityError):
            C.reaggregate_exact(*wrong)


def test_crosswalk_weights(bundle):
    found = C.crosswalk_pairs(bundle.frame("changes"), bundle.frame("territories"), first_id=7)
    listed = found.select("id", "from_code", "to_code", "allocation_weight").orderBy("id")
    assert [tuple(r) for r in listed.collect()] == [
        (7, "A", "C", Decimal(1)), (8, "B", "C", Decimal(1)), (9, "D", "E", None),
        (10, "D", "F", None)]


def test_load_and_verify_observations(bundle):
    t, s, o = (bundle.frame(n) for n in ("territories", "series", "observations"))
    nothing = t.limit(0).withColumn("territory_id", F.lit(0).cast("long"))
    first = R.assign_territory_ids(t.filter("snapshot = '2020-01-01'"), nothing)
    assert rows(first.select("territory_id")) == rows(bundle.spark.range(1, 7).toDF("x"))
    both = R.assign_territory_ids(t, first)
    assert both.agg(F.count_distinct("territory_id"), F.max("territory_id")).first() == (12, 12)
    assert both.join(first, ["key", "territory_id"], "left_semi").count() == 6
    loaded = R.load_observations(o, both, s, "r")
    assert schema_matches(loaded, schemas.PUBLIC["observations_v2"])
    assert R.load_mismatches(o, both, loaded, "r").count() == 0
    broken = loaded.withColumn("value", F.when(F.col("territory_id") == 1, None).otherwise(
        F.col("value")))
    assert R.load_mismatches(o, both, broken, "r").count() == 5
    rows_ = R.coverage_table(C.coverage_rows(C.coverage_members(o, t)), s, "r")
    assert schema_matches(rows_, schemas.PUBLIC["coverage_v2"]) and rows_.count() == 10


def test_cross_source_cells(spark):
    cells = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 3)], "k string, value int")
    assert [r.k for r in C.cross_source_conflicts(cells, ["k"]).collect()] == ["b"]
    kept, matched = C.merge_sources(cells.filter("k = 'a'"), ["k"])
    assert (kept.count(), matched.first().matched) == (1, 1)


def test_level_counts(bundle):
    expected = bundle.spark.createDataFrame(
        [("country", 2), ("region", 4), ("municipality", 5)], "level string, n long")
    bad = C.level_counts_violations(bundle.frame("territories"), expected)
    assert [r.level for r in bad.collect()] == ["municipality"]


def test_boundary_sources(spark, bundle, failed):
    evidence, t = bundle.frame("evidence"), bundle.frame("territories")
    source = "evidence_name string, snapshot date, format string"
    record = "passed boolean, method string, evidence array<string>"

    def check(sources, repairs=(), records=((True, "m", ["e"]),), demo=True):
        return failed(C.boundary_source_gates(
            spark.createDataFrame(sources, source), evidence, t,
            spark.createDataFrame(list(repairs), "key string"),
            spark.createDataFrame(list(records), record), demo))

    good = [("e", d, "geojson") for d in DAYS]
    assert check(good) == set()
    assert check(good, demo=False) == {"boundary_format"}
    assert check(good[:1]) == {"boundary_coverage"}
    assert check([("x", d, "geojson") for d in DAYS]) == {"boundary_evidence"}
    assert check([*good, good[0]]) == {"boundary_snapshots"}
    assert check(good, [("nowhere",)]) == {"repairs_known"}
    assert check(good, [(key(DAYS[0], "A"),)] * 2) == {"repairs_unique"}
    assert check(good, records=[(False, "m", ["e"])]) == {"reconciliations"}
    assert check(good, records=[]) == {"reconciliations_present"}
