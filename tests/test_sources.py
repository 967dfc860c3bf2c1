"""Readers, sinks, admission rules and boundaries."""

from __future__ import annotations

import json

import pytest
from fixtures import REFERENCE, margins, rows
from pyspark.sql import functions as F

from marginloom import schemas
from marginloom.functions import polygons as P
from marginloom.operators.gates import Gates, QualityError
from marginloom.plans import admission, boundaries, territorial
from marginloom.plans import run as runs
from marginloom.sources import delimited, documents, geography, inventory, sinks, structure

CONTRACT = delimited.Contract(
    header=["Codice", "Comune", "Età", "Maschi", "Femmine", "Totale"],
    names=["code", "name", "age", "male", "female", "total"], title="Titolo", rows=102)


def age_lines(**changes):
    lines = {a: f"000001;Uno;{a};1;2;3" for a in range(101)}
    lines[999] = "000001;Uno;999;101;202;303"
    lines.update(changes.pop("lines", {}))
    body = [line for line in lines.values() if line is not None]
    return [changes.get("title", "\ufeffTitolo"), changes.get("header", ";".join(CONTRACT.header)),
            *body, *changes.get("extra", [])]


AGE_DAMAGE = [
    ({"title": "Altro"}, "title"), ({"header": "a;b"}, "header"),
    ({"lines": {5: None}}, "ages_complete"), ({"extra": ["000001;Uno;5;1;2;3"]}, "ages_complete"),
    ({"lines": {5: "000001;Uno;5;1;2;4"}}, "sex_sum"),
    ({"lines": {999: "000001;Uno;999;101;203;304"}}, "ages_complete"),
    ({"lines": {5: "000001;Uno;5;..;2;3"}}, "observed_counts"),
    ({"lines": {5: "000001;Uno;5;1;2"}}, "row_shape"),
    ({"lines": {5: "000001;Uno;5;1;2;3;9"}}, "row_shape"),
    ({"lines": {5: "000001;Uno;105;1;2;3"}}, "age_domain"),
    ({"lines": {5: None}}, "row_count"),
]


def age_failures(spark, failed, changes):
    lines = spark.createDataFrame([(line,) for line in age_lines(**changes)], "value string")
    found = delimited.shape_gates(lines, CONTRACT)
    return failed(admission.age_table_gates(delimited.parse(lines, CONTRACT), found=found))


def test_age_table(spark, failed):
    assert age_failures(spark, failed, {}) == set()
    lines = spark.createDataFrame([(line,) for line in age_lines()], "value string")
    cells = admission.age_cells(delimited.parse(lines, CONTRACT))
    assert rows(cells.groupBy("sex").agg(F.sum("n"))) == [("F", 202), ("M", 101)]


@pytest.mark.parametrize("changes,gate", AGE_DAMAGE,
                         ids=[f"{i}-{d[1]}" for i, d in enumerate(AGE_DAMAGE)])
def test_damaged_age_table(spark, failed, changes, gate):
    assert gate in age_failures(spark, failed, changes)


def test_households_need_a_total_before_a_zero(spark, failed):
    schema = "ref_area string, num_memb string, obs_value string"
    good = spark.createDataFrame([("1", "N1", "2"), ("1", "N2", "3"), ("1", "TOT", "5")], schema)
    assert failed(admission.household_gates(good)) == set()
    assert rows(admission.household_cells(good).select("size", "n")) == [
        (1, 2), (2, 3), (3, 0), (4, 0), (5, 0), (6, 0)]
    assert admission.household_table(good).first().derived_zeros == 4
    wrong = good.replace("5", "6", subset=["obs_value"])
    assert failed(admission.household_gates(wrong)) == {"household_totals"}
    assert failed(admission.household_gates(good.filter("num_memb <> 'TOT'"))) == {
        "household_totals"}
    assert "household_unique" in failed(admission.household_gates(good.union(good.limit(1))))
    other = good.replace("N1", "N9", subset=["num_memb"])
    assert "household_category" in failed(admission.household_gates(other))


CITIZEN = dict(year="2024", code="000001", country_code="201", country_label="Albania", male="3",
               female="4", total="7")


@pytest.mark.parametrize("change,gate", [
    ({}, None), ({"year": "2023"}, "reference_year"), ({"country_label": "X"}, "country_label"),
    ({"country_code": "202"}, "country_label"), ({"code": "12345678"}, "area_code"),
    ({"male": "-1"}, "citizenship_counts"), ({"total": "8"}, "citizenship_sex_sum"),
    ({"male": "70000001", "total": "70000005"}, "citizenship_counts")])
def test_citizenship_rows(spark, failed, change, gate):
    row = {**CITIZEN, **change}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    labels = spark.createDataFrame([("201", "Albania")], "code string, label string")
    found = failed(admission.citizenship_gates(df, labels, "2024", limit=70_000_000))
    if change == {"male": "70000001", "total": "70000005"}:
        assert failed(admission.citizenship_gates(df, labels, "2024")) == set()
    assert found == set() if gate is None else gate in found


def test_citizenship_hierarchy(spark):
    place = spark.createDataFrame([("000001", "001", "01"), ("000002", "001", "01")],
                                  "municipality string, province string, region string")
    macro = place.withColumn("macro", admission.macro_region(F.col("region"), {"1": ["01"]}))
    membership = admission.hierarchy_membership(
        macro, {"province": "province", "region": "region", "macro": "macro"}, "IT")
    cells = spark.createDataFrame(
        [("000001", "M", "201", 2), ("000002", "M", "201", 1), ("000002", "F", "100", 5)],
        "municipality string, sex string, code string, n long")
    parents = spark.createDataFrame(
        [(p, s, c, n) for p in ("001", "01", "1", "IT")
         for s, c, n in (("M", "201", 3), ("F", "100", 5))],
        "parent string, sex string, code string, n long")
    keys = ["sex", "code"]
    assert admission.parent_mismatches(cells, membership, parents, keys).count() == 0
    wrong = parents.replace(5, 6, subset=["n"])
    assert admission.parent_mismatches(cells, membership, wrong, keys).count() == 4


def test_joint_totals(spark):
    data = [("IT", s, a, n) for s, f in (("1", 1), ("2", 2), ("9", 3))
            for a, n in (("Y0", f), ("Y1", 2 * f), ("TOTAL", 3 * f))]
    df = spark.createDataFrame(data, "area string, sex string, age string, n long")
    assert admission.joint_total_violations(df).count() == 0
    areas = df.select("area").distinct()
    ages = ["Y0", "Y1", "TOTAL"]
    assert admission.joint_completeness(df, areas, ["1", "2", "9"], ages).count() == 0
    assert admission.joint_completeness(df.filter("age <> 'Y1'"), areas, ["1"], ages).count() == 5
    wrong = df.withColumn("n", F.when(F.col("age") == "Y0", 9).otherwise(F.col("n")))
    assert admission.joint_total_violations(wrong).count() > 0


DEMO = ("DEMO001", "Uno", "2025-01-01", "1200")


@pytest.mark.parametrize("row,gate", [
    (DEMO, None), (("DEMO01", *DEMO[1:]), "valid_values"), (("DEMO001\n", *DEMO[1:]), "valid_values"),
    (("DEMO001", " ", *DEMO[2:]), "valid_values"), ((*DEMO[:2], "2025-02-30", "1"), "valid_values"),
    ((*DEMO[:2], "2024-01-01", "1"), "valid_values"), ((*DEMO[:3], "-1"), "valid_values"),
    ((*DEMO[:3], "1.5"), "valid_values"), ((*DEMO[:3], "NaN"), "valid_values"),
    ((*DEMO[:3], "9" * 30), "valid_values"), ((*DEMO[:3], None), "valid_values")])
def test_demo_rows(spark, failed, row, gate):
    schema = "territory_code string, territory_name string, period string, population string"
    found = failed(admission.demo_gates(spark.createDataFrame([row], schema)))
    assert found == (set() if gate is None else {gate})


def test_demo_keys_and_periods(spark, failed):
    schema = "territory_code string, territory_name string, period string, population string"
    twice = spark.createDataFrame([DEMO, DEMO], schema)
    mixed = spark.createDataFrame([DEMO, ("DEMO002", "Due", "2025-01-02", "1")], schema)
    assert failed(admission.demo_gates(twice)) == {"unique_key"}
    assert failed(admission.demo_gates(mixed)) == {"single_period"}
    assert failed(admission.demo_gates(twice.limit(0))) >= {"nonempty"}


REGIONS = [f"R{i:02d}" for i in range(20)]


@pytest.mark.parametrize("index,change,gate", [
    (0, {}, None), (0, {"OBS_VALUE": "999"}, "national_reconciliation"),
    (1, {"OBS_VALUE": "-1"}, "nonnegative_int64"), (1, {"OBS_VALUE": "9" * 19}, "nonnegative_int64"),
    (1, {"SEX": "1"}, "selected_slice"), (1, {"REF_AREA": "R01"}, "unique_key"),
    (1, {"REF_AREA": "XX"}, "territorial_coverage"), (1, {"OBS_STATUS": "z"}, "reviewed_flags"),
    (1, {"UNIT_MEAS": "kg"}, "reviewed_units"), (1, {"NOTE_SEX": "n"}, "blank_notes"),
    (1, {"NOTE_REF_AREA": "n"}, "reviewed_notes"), (1, {"UNIT_MULT": "7"}, "attribute_domains")])
def test_regional_slice(spark, failed, index, change, gate):
    base = dict(REF_AREA="IT", SEX="9", OBS_VALUE="200", OBS_STATUS="", NOTE_REF_AREA="",
                NOTE_SEX="", UNIT_MEAS="p", UNIT_MULT="0")
    data = [base] + [{**base, "REF_AREA": r, "OBS_VALUE": "10"} for r in REGIONS]
    data[index] = {**data[index], **change}
    df = spark.createDataFrame([tuple(d.values()) for d in data],
                               ", ".join(f"{k} string" for k in base))
    places = spark.createDataFrame([(c, None) for c in ["IT", *REGIONS]],
                                   "code string, note string")
    codes = spark.createDataFrame([("CL_U", "p"), ("CL_M", "0")], "codelist string, code string")
    found = failed(admission.sample_gates(
        df, {"SEX": "9"}, places, {"UNIT_MEAS": ["p"]}, ["", "e"], codes,
        {"UNIT_MEAS": "CL_U", "UNIT_MULT": "CL_M", "NOTE_SEX": "CL_N"}, REGIONS, "IT", 21))
    assert found == set() if gate is None else gate in found


def test_slice_reader_and_series(spark, tmp_path):
    path = tmp_path / "slice.csv"
    path.write_text("\ufeffREF_AREA,SEX,AGE,OBS_VALUE,NOTE_AGE,OBS_STATUS\n"
                    "01,1,Y17,5,,\n01,9,Y_GE100,2,open,e\n01,2,TOTAL,7,,\n", encoding="utf-8")
    columns = ["REF_AREA", "SEX", "AGE", "OBS_VALUE", "NOTE_AGE", "OBS_STATUS"]
    df = delimited.read_text_table(spark, str(path), columns)
    delimited.profile_gates(df, {"SEX": ["1", "2", "9"]}, expected_rows=3).require()
    named = territorial.population_series(df)
    found = {r.series_code: (r.title, r.dimensions) for r in named.collect()}
    assert found["population_jan1_m_y17"][1] == {
        "measure": "population_jan1", "sex": "M", "age": "17:18"}
    assert found["population_jan1_total_y_ge100"][1]["age"] == "100:1000"
    assert found["population_jan1_f_total"][0] == (
        "Popolazione al 1° gennaio — femmine, tutte le età")
    seen = territorial.as_observations(named, "2024-01-01", F.col("REF_AREA"))
    notes = {r.series_code: r.upstream_note for r in seen.collect()}
    assert notes["population_jan1_total_y_ge100"] == '{"NOTE_AGE":"open"}'
    assert notes["population_jan1_m_y17"] == "{}"


def test_household_and_dwelling_series(spark):
    homes = territorial.household_series(spark.createDataFrame([("TOT",), ("N3",), ("N6_GE",)],
                                                               "NUM_MEMB string"))
    assert {r.series_code: r.dimensions["household_size"] for r in homes.collect()} == {
        "census_households_total": "TOTAL", "census_households_n3": "3:4",
        "census_households_n6_ge": "6:1000"}
    flats = territorial.dwelling_series(spark.createDataFrame([("NUM_OCC_DW_AV",)],
                                                              "INDICATOR string"))
    assert flats.first().series_code == "census_dwellings_occupied"


STRUCTURE = """<m:Structure xmlns:m="urn:m" xmlns:s="urn:s" xmlns:c="urn:c">
<s:Codelists><s:Codelist id="CL_A" agencyID="X" version="1.0">
<s:Code id="P"><c:Name xml:lang="it">Padre</c:Name></s:Code>
<s:Code id="C"><c:Name xml:lang="en">Child</c:Name><c:Name xml:lang="it">Figlio</c:Name>
<s:Parent><Ref id="P"/></s:Parent></s:Code></s:Codelist></s:Codelists>
<s:DataStructure id="D" agencyID="X" version="2.0"><s:DataStructureComponents>
<s:DimensionList><s:Dimension id="AREA" position="1"><s:LocalRepresentation><s:Enumeration>
<Ref id="CL_A" agencyID="X" version="1.0"/></s:Enumeration></s:LocalRepresentation></s:Dimension>
<s:TimeDimension id="TIME" position="2"/></s:DimensionList>
<s:AttributeList><s:Attribute id="NOTE"/></s:AttributeList>
<s:MeasureList><s:PrimaryMeasure id="OBS"/></s:MeasureList>
</s:DataStructureComponents></s:DataStructure>
<s:Dataflow id="F" agencyID="X" version="1.0"><c:Annotations>
<c:Annotation id="LAST_UPDATE"><c:AnnotationTitle>2024-05-01</c:AnnotationTitle></c:Annotation>
</c:Annotations><s:Structure><Ref id="D" agencyID="X" version="2.0"/></s:Structure></s:Dataflow>
</m:Structure>"""


def test_structure_metadata(spark, tmp_path, failed):
    path = tmp_path / "structure.xml"
    path.write_text(STRUCTURE, encoding="utf-8")
    codes = structure.read_codes(spark, str(path))
    assert rows(codes.select("code", "label", "parent")) == [
        ("C", "Figlio", "P"), ("P", "Padre", None)]
    assert rows(structure.code_parents(codes, "CL_A")) == [("C", "P")]
    parts = structure.read_components(spark, str(path))
    assert rows(parts.select("kind", "id", "position", "codelist")) == [
        ("attribute", "NOTE", None, None), ("dimension", "AREA", "1", "CL_A"),
        ("measure", "OBS", None, None), ("time", "TIME", "2", None)]
    flows = structure.read_dataflows(spark, str(path))
    assert flows.first().last_update == "2024-05-01"
    identity = {"dataflow": "F", "agency": "X", "version": "1.0"}
    reviewed = spark.createDataFrame([("CL_A", "C", "Figlio")],
                                     "codelist string, code string, label string")

    def check(flow=identity, components=parts, meanings=reviewed):
        return failed(structure.structure_gates(flows, parts, codes, flow, components, meanings))

    assert check() == set()
    assert check({**identity, "version": "9"}) == {"dataflow_identity"}
    assert check(components=parts.replace("1", "3", subset=["position"])) == {"components"}
    assert check(meanings=reviewed.replace("Figlio", "Altro")) == {"reviewed_code_meanings"}


def test_geography_layers(spark, failed):
    regions = spark.createDataFrame([(1, "Uno")], "code int, name string")
    provinces = spark.createDataFrame([(7, 1, "Sette")], "code int, region int, name string")
    towns = spark.createDataFrame([("001001", 1001, 7, "Paese", 10, 4)],
                                  "code string, number int, province int, name string, p int, h int")
    found = geography.territories(regions, provinces, towns, "2024-01-01", "S")
    assert found.schema.names == schemas.TERRITORIES.names
    assert rows(found.select("key", "parent_key")) == [
        ("2024-01-01:001001", "2024-01-01:007"), ("2024-01-01:007", "2024-01-01:01"),
        ("2024-01-01:01", "2024-01-01:IT"), ("2024-01-01:IT", None)]
    assert failed(geography.layer_gates(towns)) == set()
    assert failed(geography.layer_gates(towns.withColumn("number", F.lit(5)))) == {
        "municipality_code"}
    counts = geography.census_counts(towns, "2024-01-01", "p", "h")
    assert rows(counts.select("measure", "value")) == [("households", 4), ("population", 10)]
    assert failed(geography.census_gates(towns.withColumn("p", F.lit(-1)), ["p", "h"])) == {
        "census_p"}


def test_documents_features_and_boundaries(spark, tmp_path):
    def polygon(x, y, w=1):
        return [[[x, y], [x + w, y], [x + w, y + 1], [x, y + 1], [x, y]]]

    features = [{"properties": {"code": c}, "geometry": {"type": "Polygon", "coordinates": g}}
                for c, g in (("A", polygon(0, 0)), ("B", polygon(1, 0)))]
    path = tmp_path / "features.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    shapes = documents.read_features(spark, str(path), "2024-01-01")
    assert rows(shapes.select("key", P.area(F.col("geometry")))) == [
        ("2024-01-01:A", 1.0), ("2024-01-01:B", 1.0)]
    outline = boundaries.outline_edges(shapes.withColumn("parent", F.lit("R")), "parent")
    measured = boundaries.outline_measures(outline, "parent").first()
    assert (measured.edges, measured.length, measured.area, measured.xmax) == (6, 6.0, 2.0, 2.0)
    broken = shapes.withColumn("geometry", F.transform("geometry", lambda p: F.transform(
        p, lambda r: F.slice(r, 1, 4))))
    assert not any(r.well_formed for r in boundaries.measures(broken, "key").collect())
    inside = P.within_box(F.col("geometry"), 0, 0, 1.5, 1)
    assert [r[0] for r in shapes.orderBy("key").select(inside).collect()] == [True, False]
    places = spark.createDataFrame(
        [("r", 1, None), ("r", 2, None)], "release_id string, territory_id int, x string")
    flagged = boundaries.flag_boundaries(places, places.limit(1))
    assert flagged.filter("has_boundary").count() == 1


def test_reprojection_against_known_points(spark):
    # Points on and off the central meridian, by the public projection formulas.
    df = spark.createDataFrame([(500000.0, 4649776.22482), (500000.0, 0.0)], "e double, n double")
    found = boundaries.reproject(df, "e", "n").orderBy("n").collect()
    assert (round(found[0].longitude, 9), round(found[0].latitude, 9)) == (9.0, 0.0)
    assert (round(found[1].longitude, 9), round(found[1].latitude, 6)) == (9.0, 42.0)


def test_files_and_sinks(spark, tmp_path, failed):
    table = spark.createDataFrame([("s", "n", "h", "l", True)], schemas.PUBLIC["sources"])
    path = str(tmp_path / "sources")
    sinks.append_checked(table, path, schemas.PUBLIC["sources"], ["id"])
    again = sinks.append_checked(table, path, schemas.PUBLIC["sources"], ["id"])
    assert again.count() == 1
    assert documents.read_table(spark, path, schemas.PUBLIC["sources"]).count() == 1
    with pytest.raises(QualityError):
        sinks.append_checked(table.drop("name"), path, schemas.PUBLIC["sources"])
    with pytest.raises(QualityError):
        documents.read_table(spark, path, schemas.PUBLIC["quality"])
    (tmp_path / "f.txt").write_text("abc")
    files = inventory.file_inventory(spark, str(tmp_path / "f.txt")).withColumn(
        "name", F.lit("f"))
    contract = files.select("name", "sha256", "bytes")
    assert failed(inventory.inventory_gates(files, contract)) == set()
    assert failed(inventory.inventory_gates(files, contract.withColumn("bytes", F.lit(9)))) == {
        "size"}
    bad = Gates().rows(table, broken=F.lit(True))
    with pytest.raises(QualityError):
        sinks.guarded(bad, str(tmp_path / "quarantine"), spark)
    kept = spark.read.json(str(tmp_path / "quarantine"))
    assert rows(kept.select("check_name", "passed")) == [("broken", False)]


def test_run_resumes_and_verifies(spark, tmp_path):
    m = margins(spark)
    whole = runs.run(spark, m, REFERENCE, str(tmp_path / "a"), fixture=True)
    runs.run(spark, m, REFERENCE, str(tmp_path / "b"), provinces=["980"], fixture=True)
    with pytest.raises(QualityError):
        runs.verify(spark, whole.path.replace("/a/", "/b/"), m, REFERENCE)
    resumed = runs.run(spark, m, REFERENCE, str(tmp_path / "b"), fixture=True)
    assert resumed.run_id == whole.run_id
    assert rows(resumed.persons) == rows(whole.persons)
    assert all(c.passed for c in runs.verify(spark, resumed.path, m, REFERENCE))
    other = runs.run_identity(m, {"reference": "2024-01-01", "domestic": "100"})
    assert other != whole.run_id
    resumed.households.limit(1).write.mode("append").partitionBy("province").parquet(
        f"{resumed.path}/households")
    with pytest.raises(QualityError):
        runs.verify(spark, resumed.path, m, REFERENCE)
