"""Readers and admission rules over text, CSV and XML that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.operators import paging
from marginloom.plans import admission, star, territorial
from marginloom.registry import query
from marginloom.registry.sql import MARGINS
from marginloom.session import work_folder
from marginloom.sources import delimited, structure

AGE_TABLE = delimited.Contract(
    header=["Codice", "Comune", "Età", "Maschi", "Femmine", "Totale"],
    names=["code", "name", "age", "male", "female", "total"], title="Popolazione al 1 gennaio")


def age_lines(spark: SparkSession, folder: str, complete: bool = True) -> DataFrame:
    """The demography as published text: title, header, one line per age, one total line."""
    m = star.margins(spark, folder, False)
    counts = m.demography.groupBy("municipality", "age").agg(
        *[F.sum(F.when(F.col("sex") == s, F.col("n")).otherwise(0)).alias(s) for s in "MF"])
    rows = counts
    if complete:
        ages = m.locality.select("municipality", F.explode(F.sequence(
            F.lit(0), F.lit(100))).alias("age"))
        rows = ages.join(counts, ["municipality", "age"], "left").fillna(0, ["M", "F"])
    totals = counts.groupBy("municipality").agg(
        F.lit(999).alias("age"), F.sum("M").alias("M"), F.sum("F").alias("F"))
    data = rows.select("municipality", "age", "M", "F").unionByName(totals)
    text = F.concat_ws(";", "municipality", F.concat(F.lit("N "), "municipality"),
                       F.col("age").cast("string"), F.col("M").cast("string"),
                       F.col("F").cast("string"), (F.col("M") + F.col("F")).cast("string"))
    preamble = spark.range(1).select(F.explode(F.array(
        F.lit(AGE_TABLE.title), F.lit(";".join(AGE_TABLE.header)))).alias("value"))
    return preamble.unionByName(data.select(text.alias("value")))


AGE_ROWS = MARGINS + """, counts AS (
  SELECT municipality, age, CAST(coalesce(sum(n) FILTER (sex = 'M'), 0) AS BIGINT) AS m,
         CAST(coalesce(sum(n) FILTER (sex = 'F'), 0) AS BIGINT) AS f FROM demography GROUP BY ALL),
ages AS (SELECT municipality, CAST(unnest(range(101)) AS INTEGER) AS age FROM locality),
rows AS (
  SELECT municipality, age, coalesce(m, 0) AS m, coalesce(f, 0) AS f
  FROM ages LEFT JOIN counts USING (municipality, age)
  UNION ALL SELECT municipality, 999, CAST(sum(m) AS BIGINT), CAST(sum(f) AS BIGINT)
  FROM counts GROUP BY ALL)"""


@query(AGE_ROWS + """ SELECT municipality AS code, concat('N ', municipality) AS name,
  CAST(age AS VARCHAR) AS age, CAST(m AS VARCHAR) AS male, CAST(f AS VARCHAR) AS female,
  CAST(m + f AS VARCHAR) AS total FROM rows""")
def delimited_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "age-table")
    age_lines(spark, folder).write.text(path)
    return delimited.parse(delimited.read_lines(spark, path), AGE_TABLE).drop(delimited.MALFORMED)


DAMAGED_AGES = AGE_ROWS + """, marked AS (SELECT *, municipality = '000009' AND age = 50 AS short FROM rows
    WHERE NOT (municipality = '000005' AND age = 20)),
  found AS (SELECT municipality, short, CASE WHEN NOT short THEN CASE WHEN municipality = '000007' AND age = 40
      THEN 150 ELSE age END END AS age,
    CASE WHEN NOT (short OR (municipality = '000003' AND age = 17)) THEN m END AS m, CASE WHEN NOT short THEN f END AS f,
    CASE WHEN NOT short THEN m + f + CASE WHEN municipality = '000006' AND age = 30 THEN 1 ELSE 0 END END AS t
  FROM marked)"""
AGE_REPORT = {
    "title": "(SELECT 1 WHERE FALSE)", "header": "(SELECT 1 WHERE FALSE)", "row_shape": "found WHERE short",
    "observed_counts": "found WHERE age IS NULL OR m IS NULL OR f IS NULL OR t IS NULL",
    "age_domain": "found WHERE NOT coalesce(age BETWEEN 0 AND 100 OR age = 999, false)",
    "sex_sum": "found WHERE NOT coalesce(m + f = t, false)",
    "ages_complete": """(SELECT municipality FROM found GROUP BY municipality HAVING count(*) <> 102
      OR count(DISTINCT age) <> 102 OR count(*) FILTER (age = 999) <> 1
      OR sum(CASE WHEN age <> 999 THEN m ELSE -m END) IS DISTINCT FROM 0
      OR sum(CASE WHEN age <> 999 THEN f ELSE -f END) IS DISTINCT FROM 0)""",
}


def report_sql(rows: dict[str, str]) -> str:
    return " SELECT check_name, n = 0 AS passed, n AS violations FROM (" + " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, count(*) AS n FROM {found}" for name, found in rows.items()) + ")"


@query(DAMAGED_AGES + report_sql(AGE_REPORT))
def age_table_gates(spark: SparkSession, folder: str) -> DataFrame:
    """The report on a published text whose lines are damaged by a rule on code and age."""
    part = F.split("value", ";")
    code, age = F.get(part, F.lit(0)), F.get(part, F.lit(2))

    def at(place: str, old: str):
        return (code == place) & (age == old)

    def with_field(k: int, new: F.Column) -> F.Column:
        return F.array_join(F.transform(part, lambda x, i: F.when(i == k, new).otherwise(x)), ";")

    total = (F.get(part, F.lit(5)).cast("long") + 1).cast("string")
    line = F.when(at("000003", "17"), with_field(3, F.lit("x"))).when(at("000006", "30"), with_field(5, total)).when(
        at("000007", "40"), with_field(2, F.lit("150"))).when(at("000009", "50"), "000009;short").otherwise(
        F.col("value"))
    lines = age_lines(spark, folder).filter(~F.coalesce(at("000005", "20"), F.lit(False))).select(line.alias("value"))
    path = work_folder(spark, "damaged-ages")
    lines.write.text(path)
    stored = delimited.read_lines(spark, path)
    found = delimited.shape_gates(stored, AGE_TABLE)
    return admission.age_table_gates(delimited.parse(stored, AGE_TABLE), found=found).frame()


@query(AGE_ROWS + """ SELECT municipality, sex, age, n FROM (
  SELECT municipality, 'M' AS sex, age, m AS n FROM rows
  UNION ALL SELECT municipality, 'F', age, f FROM rows) WHERE age <> 999""")
def admitted_ages(spark: SparkSession, folder: str) -> DataFrame:
    lines = age_lines(spark, folder)
    return admission.age_cells(delimited.parse(lines, AGE_TABLE))


@query(MARGINS + """ SELECT municipality AS code, count(DISTINCT age) + 1 AS ages FROM demography
  GROUP BY ALL HAVING count(DISTINCT age) <> 101""")
def incomplete_ages(spark: SparkSession, folder: str) -> DataFrame:
    """Published without the empty ages, every area is refused."""
    rows = delimited.parse(age_lines(spark, folder, complete=False), AGE_TABLE)
    numbers = admission.typed(rows, ["age", "male", "female", "total"])
    return admission.age_violations(numbers).select("code", "ages")


@query(MARGINS + """ SELECT municipality AS ref_area,
    CAST(coalesce(sum(n) FILTER (size = 1), 0) AS BIGINT) AS "N1",
    CAST(coalesce(sum(n) FILTER (size = 2), 0) AS BIGINT) AS "N2",
    CAST(coalesce(sum(n) FILTER (size = 3), 0) AS BIGINT) AS "N3",
    CAST(coalesce(sum(n) FILTER (size = 4), 0) AS BIGINT) AS "N4",
    CAST(coalesce(sum(n) FILTER (size = 5), 0) AS BIGINT) AS "N5",
    CAST(coalesce(sum(n) FILTER (size = 6), 0) AS BIGINT) AS "N6_GE",
    CAST(sum(n) AS BIGINT) AS published, CAST(sum(n) AS BIGINT) AS parts,
    CAST(6 - count(DISTINCT size) AS INTEGER) AS derived_zeros
  FROM sizes GROUP BY ALL""")
def household_table(spark: SparkSession, folder: str) -> DataFrame:
    sizes = star.margins(spark, folder, False).households
    code = F.when(F.col("size") == 6, "N6_GE").otherwise(
        F.concat(F.lit("N"), F.col("size").cast("string")))
    rows = sizes.select(F.col("municipality").alias("ref_area"), code.alias("num_memb"),
                        F.col("n").cast("string").alias("obs_value"))
    totals = sizes.groupBy(F.col("municipality").alias("ref_area")).agg(
        F.lit("TOT").alias("num_memb"), F.sum("n").cast("string").alias("obs_value"))
    return admission.household_table(rows.unionByName(totals))


SLICE = ["REF_AREA", "SEX", "AGE", "OBS_VALUE", "NOTE_AGE", "UNIT_MEAS"]


def slice_csv(spark: SparkSession, folder: str) -> str:
    """Regional counts by sex and age as a statistical CSV file."""
    m = star.margins(spark, folder, False)
    cells = m.demography.join(m.locality, "municipality").groupBy("region", "sex", "age").agg(
        F.sum("n").alias("n"))
    age = F.when(F.col("age") == 100, "Y_GE100").otherwise(
        F.concat(F.lit("Y"), F.col("age").cast("string")))
    path = work_folder(spark, "slice")
    cells.select(
        F.col("region").alias("REF_AREA"),
        F.when(F.col("sex") == "M", "1").otherwise("2").alias("SEX"), age.alias("AGE"),
        F.col("n").cast("string").alias("OBS_VALUE"),
        F.when(F.col("age") == 100, "open").otherwise("").alias("NOTE_AGE"),
        F.lit("9").alias("UNIT_MEAS")).write.csv(path, header=True)
    return path


@query(MARGINS + """, cells AS (SELECT region, sex, age, sum(n) AS n FROM demography
    JOIN locality USING (municipality) GROUP BY ALL)
  SELECT concat('2024-01-01:', region) AS territory_key,
    concat('population_jan1_', lower(sex), '_', CASE WHEN age = 100 THEN 'y_ge100'
      ELSE concat('y', age) END) AS series_code, DATE '2024-01-01' AS period,
    CAST(n AS DECIMAL(20, 6)) AS value, 'unflagged_upstream' AS status, '' AS upstream_status,
    CASE WHEN age = 100 THEN '{"NOTE_AGE":"open"}' ELSE '{}' END AS upstream_note,
    '9' AS upstream_unit, '' AS upstream_unit_multiplier FROM cells""")
def slice_observations(spark: SparkSession, folder: str) -> DataFrame:
    rows = delimited.read_text_table(spark, slice_csv(spark, folder), SLICE)
    key = F.concat_ws(":", F.lit("2024-01-01"), "REF_AREA")
    return territorial.as_observations(territorial.population_series(rows), "2024-01-01", key)


@query(MARGINS + """, kinds AS (SELECT DISTINCT sex, age FROM demography)
  SELECT concat('population_jan1_', lower(sex), '_', CASE WHEN age = 100 THEN 'y_ge100'
      ELSE concat('y', age) END) AS code, concat('Popolazione al 1° gennaio — ',
      CASE sex WHEN 'M' THEN 'maschi' ELSE 'femmine' END, ', ', CASE WHEN age = 100 THEN
      '100 anni e più' ELSE concat(age, ' anni') END) AS title, 'persons' AS unit,
    CASE WHEN age = 100 THEN '100:1000' ELSE concat(age, ':', age + 1) END AS age_range
  FROM kinds""")
def slice_series(spark: SparkSession, folder: str) -> DataFrame:
    rows = delimited.read_text_table(spark, slice_csv(spark, folder), SLICE)
    series = territorial.series_registry(territorial.population_series(rows))
    return series.select("code", "title", "unit",
                         F.element_at("dimensions", "age").alias("age_range"))


@query(MARGINS + """, cells AS (SELECT region, sex, age FROM demography JOIN locality USING (municipality) GROUP BY ALL)
  """ + report_sql({
    "counts": "cells WHERE age IN (20, 30)", "row_shape": "(SELECT 1 WHERE FALSE)", "domain_SEX": "cells WHERE age = 10",
    "domain_NOTE_AGE": "cells WHERE region = '02'", "domain_UNIT_MEAS": "cells WHERE age = 40"}))
def slice_gates(spark: SparkSession, folder: str) -> DataFrame:
    """The report on a slice whose codes and values are damaged by a rule on age and region."""
    rows = delimited.read_text_table(spark, slice_csv(spark, folder), SLICE)
    age = F.col("AGE")
    rows = rows.withColumns({
        "SEX": F.when(age == "Y10", "3").otherwise(F.col("SEX")),
        "OBS_VALUE": F.when(age == "Y20", "-1").when(age == "Y30", "n/a").otherwise(F.col("OBS_VALUE")),
        "NOTE_AGE": F.when(F.col("REF_AREA") == "02", "x").otherwise(F.col("NOTE_AGE")),
        "UNIT_MEAS": F.when(age != "Y40", F.col("UNIT_MEAS"))})
    return delimited.profile_gates(
        rows, {"SEX": ["1", "2"], "NOTE_AGE": ["", "open"], "UNIT_MEAS": ["9"]}).frame()


@query(MARGINS + """, children AS (SELECT municipality, sex, age, n FROM demography),
  levels AS (SELECT municipality, unnest([province, 'ALL']) AS parent FROM locality),
  summed AS (SELECT parent, sex, age, CAST(sum(n) AS BIGINT) AS n FROM children
    JOIN levels USING (municipality) GROUP BY ALL),
  kept AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS municipality,
      CASE WHEN l_linestatus = 'O' THEN 'M' ELSE 'F' END AS sex,
      least(CAST(l_quantity AS INTEGER) * 2, 100) AS age
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE l_tax > 0),
  published AS (SELECT parent, sex, age, count(*) AS n FROM kept JOIN levels USING (municipality)
    GROUP BY ALL)
  SELECT parent, sex, age, coalesce(s.n, 0) AS expected, coalesce(p.n, 0) AS actual
  FROM summed s FULL JOIN published p USING (parent, sex, age)
  WHERE coalesce(s.n, 0) <> coalesce(p.n, 0)""")
def hierarchy_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of municipalities against parents that were counted without the untaxed lines."""
    m = star.margins(spark, folder, False)
    membership = admission.hierarchy_membership(m.locality, {"province": "province"}, "ALL")
    item = star.table(spark, folder, "lineitem").filter("l_tax > 0").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("l_linestatus") == "O", "M").otherwise("F").alias("sex"),
        F.least(F.col("l_quantity").cast("int") * 2, F.lit(100)).alias("age"))
    orders = star.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = star.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), star.place("c_nationkey").alias("municipality"))
    counted = item.join(orders, "o_orderkey").join(customer, "o_custkey").groupBy(
        "municipality", "sex", "age").agg(F.count(F.lit(1)).alias("n"))
    parents = counted.join(membership, "municipality").groupBy("parent", "sex", "age").agg(
        F.sum("n").alias("n"))
    return admission.parent_mismatches(m.demography, membership, parents, ["sex", "age"])


@query("""WITH g AS (SELECT c_nationkey AS "group", count(DISTINCT c_mktsegment) AS parents,
    min(c_mktsegment) AS parent, count(*) FILTER (c_mktsegment IS NULL) AS unmatched
    FROM customer GROUP BY ALL), s AS (SELECT parent, count(*) AS groups FROM g GROUP BY ALL)
  SELECT parent, "group", parents, unmatched, groups FROM g LEFT JOIN s USING (parent)
  WHERE parents <> 1 OR unmatched > 0 OR coalesce(groups, 0) <> 1""")
def membership_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = star.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("child"), F.col("c_nationkey").alias("group"),
        F.col("c_mktsegment").alias("parent"))
    return admission.membership_violations(rows)


@query(MARGINS + """, found AS (SELECT DISTINCT municipality AS area, sex, CAST(age AS VARCHAR) AS age
    FROM demography),
  places AS (SELECT municipality AS area, s.sex, CAST(a.i AS VARCHAR) AS age
    FROM locality, (SELECT unnest(['M', 'F']) AS sex) s, (SELECT unnest(range(101)) AS i) a)
  SELECT area, sex, age, 'left' AS side FROM places ANTI JOIN found USING (area, sex, age)""")
def joint_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the municipality x sex x age joint that nobody falls into."""
    m = star.margins(spark, folder, False)
    cells = m.demography.select(F.col("municipality").alias("area"), "sex",
                                F.col("age").cast("string").alias("age"))
    areas = m.locality.select(F.col("municipality").alias("area"))
    return admission.joint_completeness(cells, areas, ["M", "F"], [str(i) for i in range(101)])


NAMESPACES = 'xmlns:m="urn:m" xmlns:s="urn:s" xmlns:c="urn:c"'


@query("""SELECT 'CL_PLACE' AS codelist, 'X' AS agency, '1.0' AS version, code, label, parent FROM (
  SELECT concat('R', r_regionkey) AS code, r_name AS label, NULL AS parent FROM region
  UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, concat('R', n_regionkey) FROM nation)""")
def codelist_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Regions and nations as one hierarchical codelist, written and read as XML."""
    region = star.table(spark, folder, "region").select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code"),
        F.col("r_name").alias("label"), F.lit(None).cast("string").alias("parent"))
    nation = star.table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"))
    parent = F.when(F.col("parent").isNotNull(), F.concat(
        F.lit('<s:Parent><Ref id="'), "parent", F.lit('"/></s:Parent>'))).otherwise("")
    code = F.concat(
        F.lit('<s:Code id="'), "code", F.lit('"><c:Name xml:lang="en">'), F.lower("label"),
        F.lit('</c:Name><c:Name xml:lang="it">'), "label", F.lit("</c:Name>"), parent,
        F.lit("</s:Code>"))
    # One codelist is one document: a row with as many codes as there are nations and regions.
    text = F.concat(
        F.lit(f'<m:Structure {NAMESPACES}><s:Codelist id="CL_PLACE" agencyID="X" version="1.0">'),
        F.array_join(F.array_sort(F.collect_list("code_xml")), ""),
        F.lit("</s:Codelist></m:Structure>"))
    path = work_folder(spark, "codelist")
    region.unionByName(nation).select(code.alias("code_xml")).agg(
        text.alias("value")).write.text(path)
    return structure.read_codes(spark, path)


@query("""SELECT doc_id, lang, n_chars FROM documents
  WHERE strpos(lower(text), lower('LE un')) > 0 ORDER BY doc_id LIMIT 100""")
def search_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Literal search in whole texts; the limit is the page."""
    rows = star.table(spark, folder, "documents")
    found = rows.filter(paging.matches("LE un", ["text"]))
    return paging.id_page(found, "doc_id", -1, 100).select("doc_id", "lang", "n_chars")


CODES = """WITH codes AS (SELECT l_orderkey, l_linenumber, CASE
    WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN 'TOTAL'
    WHEN l_orderkey % 23 = 0 THEN 'Y_GE100' WHEN l_orderkey % 7 = 0 THEN concat('Q', CAST(l_quantity AS INTEGER))
    WHEN l_orderkey % 11 = 0 THEN concat('Y123456789', 100000 + l_orderkey % 900000)
    WHEN l_orderkey % 13 = 0 THEN concat('Y', repeat('9', 12 + CAST(l_linenumber AS INTEGER)), 'x')
    WHEN l_orderkey % 29 = 0 THEN concat('Y1', repeat('0', 18)) WHEN l_orderkey % 31 = 0 THEN 'Y'
    WHEN l_orderkey % 37 = 0 THEN concat('Y', CAST(l_quantity AS INTEGER), chr(10))
    ELSE concat('Y', lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 3, '0')) END AS code FROM lineitem)"""


def _codes(spark: SparkSession, folder: str) -> DataFrame:
    """Class codes of the line items, some of them damaged by a rule on the key."""
    key, number = F.col("l_orderkey"), F.col("l_quantity").cast("int").cast("string")
    damage = [(17, F.lit(None)), (19, F.lit("TOTAL")), (23, F.lit("Y_GE100")), (7, F.concat(F.lit("Q"), number)),
              (11, F.concat(F.lit("Y123456789"), (100000 + key % 900000).cast("string"))),
              (13, F.concat(F.lit("Y"), F.repeat(F.lit("9"), 12 + F.col("l_linenumber")), F.lit("x"))),
              (29, F.lit("Y1" + "0" * 18)), (31, F.lit("Y")), (37, F.concat(F.lit("Y"), number, F.lit("\n")))]
    code = F.lit(None).cast("string")
    for k, (divisor, value) in enumerate(damage):
        code = F.when(key % divisor == 0, value) if not k else code.when(key % divisor == 0, value)
    code = code.otherwise(F.concat(F.lit("Y"), F.lpad(number, 3, "0")))
    return star.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", code.alias("AGE"))


@query(CODES + """ SELECT code AS "AGE", CASE WHEN code = 'TOTAL' THEN 'TOTAL' WHEN code = 'Y_GE100' THEN '100:1000'
    WHEN regexp_full_match(code, 'Y0*[0-9]{1,18}') THEN concat(CAST(substr(code, 2) AS BIGINT), ':',
      CAST(substr(code, 2) AS BIGINT) + 1) END AS range, count(*) AS n
  FROM codes GROUP BY ALL""")
def code_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Every class code with its range; codes that are not read have none."""
    return _codes(spark, folder).groupBy("AGE").agg(F.count(F.lit(1)).alias("n")).select(
        "AGE", territorial.age_range(F.col("AGE")).alias("range"), "n")


@query(CODES + """ SELECT l_orderkey, l_linenumber, 'AGE' AS "column", code, CASE WHEN code IS NULL THEN 'missing'
    WHEN regexp_full_match(code, 'Y[0-9]+') THEN 'too_large' ELSE 'unknown' END AS reason
  FROM codes WHERE code IS NULL OR (code NOT IN ('TOTAL', 'Y_GE100')
    AND NOT regexp_full_match(code, 'Y0*[0-9]{1,18}'))""")
def unread_codes(spark: SparkSession, folder: str) -> DataFrame:
    """One row for every line whose code is not read, with the reason."""
    return territorial.code_violations(_codes(spark, folder), ["l_orderkey", "l_linenumber"],
                                       {"AGE": territorial.age_class(F.col("AGE"))})


@query("""WITH counts AS (SELECT l_suppkey, CASE WHEN l_orderkey % 11 = 0 THEN NULL
    WHEN l_orderkey % 13 = 0 THEN concat('-', CAST(l_quantity AS INTEGER)) WHEN l_orderkey % 17 = 0 THEN '1.5'
    WHEN l_orderkey % 19 = 0 THEN repeat('7', 19) WHEN l_orderkey % 23 = 0 THEN ' 4'
    ELSE concat('00', CAST(l_quantity AS INTEGER)) END AS text FROM lineitem),
  read AS (SELECT l_suppkey, CASE WHEN regexp_full_match(text, '0*[0-9]{1,18}') THEN CAST(text AS BIGINT) END AS v,
    text FROM counts)
  SELECT l_suppkey, coalesce(CASE WHEN text IS NULL THEN 'missing' WHEN NOT regexp_full_match(text, '[0-9]+')
      THEN 'not_a_count' WHEN v IS NULL THEN 'too_large' WHEN v > 40 THEN 'above_limit' END, 'count') AS reason,
    count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM read GROUP BY ALL""")
def bounded_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that should be counts of at most forty, by supplier and by what is wrong with them."""
    key, number = F.col("l_orderkey"), F.col("l_quantity").cast("int").cast("string")
    text = F.when(key % 11 == 0, None).when(key % 13 == 0, F.concat(F.lit("-"), number)).when(
        key % 17 == 0, "1.5").when(key % 19 == 0, "7" * 19).when(key % 23 == 0, " 4").otherwise(
        F.concat(F.lit("00"), number))
    rows = star.table(spark, folder, "lineitem").select("l_suppkey", text.cast("string").alias("text"))
    reason = F.coalesce(admission.count_reason("text", 40), F.lit("count"))
    return rows.groupBy("l_suppkey", reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(admission.count_of("text")).alias("total"))
