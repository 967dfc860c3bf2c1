"""Margins, expansion, ranks and the generation stages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.functions.hashing import hash_key
from marginloom.operators import expand, ranking
from marginloom.plans import margins as M
from marginloom.plans import star, synthesize
from marginloom.registry import query
from marginloom.registry.sql import FAMILIES, INDIVIDUALS, MARGINS, PEOPLE, PERSONS
from marginloom.session import materialize, work_folder
from marginloom.sources import documents


def cells_of(spark: SparkSession, folder: str, citizenship: bool = True) -> M.Cells:
    return M.Cells.build(star.margins(spark, folder, citizenship))


def population(spark: SparkSession, folder: str) -> tuple[M.Cells, DataFrame, DataFrame]:
    """Cells, persons and households. Nothing compares the stages here, so individuals are not stored."""
    cells = cells_of(spark, folder)
    people = synthesize.individuals(cells, star.REFERENCE)
    persons = synthesize.assign_households(people, cells, star.REFERENCE)
    return cells, persons, synthesize.households(cells)


def margin_documents(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Write the margins as newline JSON input documents and return the two paths."""
    m = star.margins(spark, folder)

    def ages(df: DataFrame, label: str, name: str) -> DataFrame:
        # At most 101 entries per municipality and sex.
        counts = F.map_from_entries(F.collect_list(F.struct("age", "n")))
        filled = F.transform(F.sequence(F.lit(0), F.lit(100)),
                             lambda a: F.coalesce(F.try_element_at("_m", a), F.lit(0)))
        return df.filter(F.col("sex") == label).groupBy("municipality").agg(
            counts.alias("_m")).select("municipality", filled.alias(name))

    sizes = m.households.groupBy("municipality").agg(F.map_from_entries(
        F.collect_list(F.struct("size", "n"))).alias("_m")).select(
        "municipality", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda s: F.coalesce(
            F.try_element_at("_m", s), F.lit(0))).alias("households"))
    base = m.locality.join(ages(m.demography, "M", "male"), "municipality").join(
        ages(m.demography, "F", "female"), "municipality").join(sizes, "municipality")
    pairs = m.countries.groupBy("municipality", "code").agg(
        *[F.sum(F.when(F.col("sex") == s, F.col("n")).otherwise(0)).alias(s) for s in "MF"])
    codes = pairs.groupBy("municipality").agg(F.map_from_entries(F.collect_list(F.struct(
        "code", F.array("M", "F")))).alias("countries"))
    extra = ages(m.foreigners, "M", "foreign_male").join(
        ages(m.foreigners, "F", "foreign_female"), "municipality").join(codes, "municipality")
    paths = []
    for name, df in (("national", base), ("citizenship", extra)):
        paths.append(work_folder(spark, name))
        df.withColumnRenamed("municipality", "code").write.json(paths[-1])
    return paths[0], paths[1]


@query(MARGINS + " SELECT municipality, sex, age, n FROM demography")
def margins_long(spark: SparkSession, folder: str) -> DataFrame:
    path, _ = margin_documents(spark, folder)
    long = M.Margins.from_documents(documents.read_national(spark, path)).demography
    return long.filter("n > 0")


@query(MARGINS + """ SELECT municipality, sex, code, n FROM countries WHERE code <> '100'""")
def country_margins_long(spark: SparkSession, folder: str) -> DataFrame:
    _, path = margin_documents(spark, folder)
    docs = documents.read_citizenship(spark, path).withColumnRenamed("code", "municipality")
    return expand.map_margins(docs, ["municipality"], "countries", ["M", "F"], "code", "sex",
                              exclude=["100"])


@query(MARGINS + """ SELECT municipality, sex, age, i FROM demography,
  LATERAL (SELECT unnest(range(n)) AS i)""")
def expand_counts(spark: SparkSession, folder: str) -> DataFrame:
    return expand.expand_counts(star.margins(spark, folder, False).demography).drop("n")


@query(PEOPLE + " SELECT person_id, municipality, sex, age, i FROM people")
def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    m = star.margins(spark, folder, False)
    cells = m.demography.join(m.locality, "municipality")
    return expand.stable_ids(
        cells, [["province"], ["municipality"], ["sex", "age"]], identity="person_id",
    ).select("person_id", "municipality", "sex", "age", "i")


RANKED = """WITH ranked AS (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, row_number() OVER (
    PARTITION BY l_suppkey ORDER BY substr(md5(concat_ws('|', 'demo/1', CAST(l_orderkey AS VARCHAR),
      CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), 1, 15),
      l_orderkey, l_partkey, l_linenumber, l_quantity, l_shipdate) AS rank FROM lineitem)"""


def _keyed_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = star.table(spark, folder, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    lines = ranking.with_group_size(lines, ["l_suppkey"])
    return lines.withColumn("key", hash_key("demo/1", "l_orderkey", "l_partkey", "l_linenumber"))


TIES = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate"]


@query(RANKED + " SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, rank FROM ranked")
def rank_within_group(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ranking.rank_within(_keyed_lines(spark, folder), ["l_suppkey"], "key", TIES)
    return ranked.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "rank")


@query(RANKED + """ SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber
  FROM ranked JOIN supplier ON l_suppkey = s_suppkey WHERE rank <= s_nationkey""")
def select_n_per_cell(spark: SparkSession, folder: str) -> DataFrame:
    quota = star.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("quota"))
    lines = _keyed_lines(spark, folder).join(quota, "l_suppkey")
    return ranking.select_n_per_cell(
        lines, ["l_suppkey"], "key", "quota", TIES, size="group_size"
    ).select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber")


@query("""WITH units AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (
    PARTITION BY c_nationkey ORDER BY substr(md5(concat_ws('|', 'units/1', CAST(c_custkey AS VARCHAR))), 1, 15),
    c_custkey) AS rank FROM customer),
  slots AS (SELECT s_nationkey AS nation, s_suppkey, row_number() OVER (
    PARTITION BY s_nationkey ORDER BY substr(md5(concat_ws('|', 'slots/1', CAST(s_suppkey AS VARCHAR))), 1, 15),
    s_suppkey) AS rank FROM supplier)
  SELECT nation, rank, c_custkey, s_suppkey FROM units JOIN slots USING (nation, rank)""")
def match_by_rank(spark: SparkSession, folder: str) -> DataFrame:
    units = star.table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nation"), "c_custkey")
    slots = star.table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("nation"), "s_suppkey")

    def ranked(df: DataFrame, label: str, key: str) -> DataFrame:
        df = ranking.with_group_size(df, ["nation"]).withColumn("key", hash_key(label, key))
        return ranking.rank_within(df, ["nation"], "key", [key]).select("nation", key, "rank")

    return ranking.match_by_rank(ranked(units, "units/1", "c_custkey"),
                                 ranked(slots, "slots/1", "s_suppkey"), ["nation"])


@query(INDIVIDUALS + " SELECT * FROM individuals")
def synth_individuals(spark: SparkSession, folder: str) -> DataFrame:
    return synthesize.individuals(cells_of(spark, folder), star.REFERENCE)


@query(INDIVIDUALS + """ SELECT municipality, sex, citizenship_code, count(*) AS persons
  FROM individuals GROUP BY ALL""")
def synth_citizenship(spark: SparkSession, folder: str) -> DataFrame:
    people = synthesize.individuals(cells_of(spark, folder), star.REFERENCE)
    return people.groupBy("municipality", "sex", "citizenship_code").agg(
        F.count(F.lit(1)).alias("persons"))


@query(PERSONS + " SELECT * EXCLUDE (age) FROM persons")
def synth_persons(spark: SparkSession, folder: str) -> DataFrame:
    return population(spark, folder)[1]


@query(PERSONS + """ SELECT household_id, municipality, province, region,
  CAST(size AS SMALLINT) AS size, 'synthetic' AS data_kind FROM dwellings""")
def synth_households(spark: SparkSession, folder: str) -> DataFrame:
    return synthesize.households(cells_of(spark, folder))


@query(PERSONS + " SELECT * EXCLUDE (age, citizenship_code) FROM persons")
def synth_three_stages(spark: SparkSession, folder: str) -> DataFrame:
    """Without citizenship the households come out the same."""
    cells = cells_of(spark, folder, citizenship=False)
    people = synthesize.individuals(cells, star.REFERENCE)
    return synthesize.assign_households(people, cells, star.REFERENCE)


@query(PERSONS + " SELECT * EXCLUDE (age) FROM persons")
def enrich_citizenship(spark: SparkSession, folder: str) -> DataFrame:
    """Adds citizenship to finished persons; equals the ordered pipeline."""
    cells = cells_of(spark, folder)
    base = replace(cells, countries=None)
    people = synthesize.individuals(base, star.REFERENCE)
    persons = materialize(synthesize.assign_households(people, base, star.REFERENCE), "base")
    return synthesize.enrich(persons, cells, star.REFERENCE)


@query(PEOPLE + FAMILIES + """ SELECT municipality, population, minors, households, capacity,
  capacity <= population AS capacity_fits, population - minors >= households AS adults_suffice,
  minors <= capacity - households AS slots_suffice FROM totals""")
def feasibility(spark: SparkSession, folder: str) -> DataFrame:
    return M.feasibility(star.margins(spark, folder, False))


def _different(left: str, right: str) -> str:
    """Municipalities of one side only."""
    one, other = (f"SELECT municipality FROM {t}" for t in (left, right))
    return f"(({one} EXCEPT {other}) UNION ALL ({other} EXCEPT {one}))"


def _compared(left: str, right: str, keys: str, bad: str) -> str:
    return f"""(SELECT {keys}, coalesce(e, 0) AS expected, coalesce(a, 0) AS actual FROM (
      SELECT {keys}, sum(n) AS e FROM {left} GROUP BY ALL) FULL JOIN (
      SELECT {keys}, sum(n) AS a FROM {right} GROUP BY ALL) USING ({keys})) WHERE expected {bad} actual"""


COHERENCE = MARGINS + """,
place AS (SELECT municipality, province, CASE WHEN municipality = '000006' THEN '99' ELSE region END AS region
  FROM locality, (SELECT unnest([1, 2]) AS copy)
  WHERE municipality <> '000024' AND (copy = 1 OR municipality = '000008')),
dem AS (SELECT municipality, sex, age, CASE WHEN municipality = '000001' AND age = 50 THEN -n ELSE n END AS n
  FROM demography),
homes AS (SELECT municipality, CASE WHEN municipality = '000004' THEN 6 ELSE size END AS size,
    CASE WHEN municipality = '000009' THEN 20 * n ELSE n END AS n FROM sizes WHERE municipality <> '000010'),
fore AS (SELECT municipality, sex, age, CASE WHEN municipality = '000005' THEN n + 1000 ELSE n END AS n FROM foreigners),
coun AS (SELECT municipality, sex, code, n FROM countries WHERE NOT (municipality = '000007' AND code = '100')),
sums AS (SELECT *, coalesce(homes_n, 0) AS h, coalesce(room, 0) AS c FROM (
    SELECT municipality, sum(n) AS p, coalesce(sum(n) FILTER (age < 18), 0) AS m FROM dem GROUP BY ALL)
  LEFT JOIN (SELECT municipality, sum(n) AS homes_n, sum(n * size) AS room FROM homes GROUP BY ALL)
    USING (municipality))"""
COHERENCE_REPORT = {
    "unique_municipalities": "(SELECT municipality FROM place GROUP BY ALL HAVING count(*) > 1)",
    "one_region_per_province": "(SELECT province FROM place GROUP BY ALL HAVING count(DISTINCT region) <> 1)",
    "population_total": "(SELECT sum(n) AS n FROM dem) WHERE n <= 0",
    "household_capacity": "sums WHERE c > p", "adults_for_references": "sums WHERE p - m < h",
    "slots_for_minors": "sums WHERE m > c - h",
    "demography_counts": "dem WHERE n < 0", "households_counts": "homes WHERE n < 0",
    "demography_places": _different("dem", "place"), "households_places": _different("homes", "place"),
    "unique_demography": "(SELECT 1 FROM dem GROUP BY municipality, sex, age HAVING count(*) > 1)",
    "unique_household_sizes": "(SELECT 1 FROM homes GROUP BY municipality, size HAVING count(*) > 1)",
    "unique_foreigners": "(SELECT 1 FROM fore GROUP BY municipality, sex, age HAVING count(*) > 1)",
    "unique_countries": "(SELECT 1 FROM coun GROUP BY municipality, sex, code HAVING count(*) > 1)",
    "citizenship_coverage": _different("coun", "place"),
    "foreign_within_base": _compared("fore", "dem", "municipality, sex, age", ">"),
    "foreign_totals": _compared("fore", "(SELECT * FROM coun WHERE code <> '100')", "municipality, sex", "<>"),
    "sex_totals": _compared("coun", "dem", "municipality, sex", "<>"),
}


@query(COHERENCE + " SELECT check_name, n = 0 AS passed, n AS violations FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, count(*) AS n FROM {rows}" for name, rows in COHERENCE_REPORT.items()) + ")")
def coherence_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule between the margins, over margins with damage by a rule on the keys."""
    m, code, n = star.margins(spark, folder), F.col("municipality"), F.col("n")

    def changed(condition, value, column="n"):
        return F.when(condition, value).otherwise(F.col(column)).alias(column)

    place = m.locality.filter(code != "000024").withColumn("_copy", F.explode(F.array_repeat(
        F.lit(1), F.when(code == "000008", 2).otherwise(1)))).select(
        "municipality", "province", changed(code == "000006", F.lit("99"), "region"))
    damaged = replace(
        m, locality=place,
        demography=m.demography.select("municipality", "sex", "age", changed(
            (code == "000001") & (F.col("age") == 50), -n)),
        households=m.households.filter(code != "000010").select(
            "municipality", changed(code == "000004", F.lit(6), "size"), changed(code == "000009", 20 * n)),
        foreigners=m.foreigners.select("municipality", "sex", "age", changed(code == "000005", n + 1000)),
        countries=m.countries.filter(~((code == "000007") & (F.col("code") == "100"))))
    return M.coherence_gates(damaged).frame()
