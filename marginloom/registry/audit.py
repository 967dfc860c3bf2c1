"""Independent audit of records, margins and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.operators import gates, reconcile
from marginloom.plans import audit, publish, star
from marginloom.plans import synthesize
from marginloom.registry import query
from marginloom.registry.sql import INDIVIDUALS, LINES, MARGINS, PERSONS, PUBLISHED
from marginloom.registry.synthesis import cells_of, population
from marginloom.session import materialize, materialize_all


def stored_population(spark: SparkSession, folder: str) -> tuple:
    """Margins and the stored persons and households, read back for the audit."""
    m = star.margins(spark, folder)
    cells = synthesize.Cells.build(m)
    first = materialize_all(individuals=synthesize.individuals(cells, star.REFERENCE),
                            households=synthesize.households(cells))
    persons = materialize(
        synthesize.assign_households(first["individuals"], cells, star.REFERENCE), "persons")
    return m, first["individuals"], persons, first["households"]


@query(PERSONS + """ SELECT municipality, CAST(count(*) FILTER (reference_adult) AS BIGINT) AS refs,
  min(household_id) FILTER (reference_adult) AS first_household FROM persons GROUP BY ALL""")
def reference_adults(spark: SparkSession, folder: str) -> DataFrame:
    _, persons, _ = population(spark, folder)
    return persons.groupBy("municipality").agg(
        F.count_if("reference_adult").alias("refs"),
        F.min(F.when(F.col("reference_adult"), F.col("household_id"))).alias("first_household"))


@query(PERSONS + """ SELECT municipality, count(*) AS persons,
  count(*) FILTER (household_id IS NULL) AS unassigned FROM persons GROUP BY ALL""")
def unassigned_adults(spark: SparkSession, folder: str) -> DataFrame:
    return audit.residuals(population(spark, folder)[1])


@query(PERSONS + """ SELECT count(*) FILTER (youngest < 18) AS households_with_minors,
  count(*) FILTER (youngest >= 65) AS households_only_65_plus,
  count(*) FILTER (youngest < 18 AND oldest >= 65) AS households_minors_and_65_plus
  FROM (SELECT household_id, min(age) AS youngest, max(age) AS oldest FROM persons
        WHERE household_id IS NOT NULL GROUP BY household_id)""")
def family_stats(spark: SparkSession, folder: str) -> DataFrame:
    return audit.family_statistics(population(spark, folder)[1], star.REFERENCE)


# Orders seen as households of at most six declared members, line items as their members: orders
# with more lines, with no first line or with nobody of adult age violate the family rules.
ORDER_FAMILIES = """, items AS (
    SELECT l_orderkey AS household_id, l_linenumber = 1 AS reference_adult,
           least(CAST(l_quantity AS INTEGER) * 2, 100) AS age,
           lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS municipality
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
  homes AS (
    SELECT o_orderkey AS household_id, lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS municipality,
           CAST(least(coalesce(n, 0), 6) AS SMALLINT) AS size
    FROM orders JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)
      ON l_orderkey = o_orderkey)"""


def _order_families(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    customer = star.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), star.place("c_nationkey").alias("municipality"))
    orders = star.table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(
        customer, "o_custkey").join(star.locality(spark, folder), "municipality")
    items = star.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber",
        F.least(F.col("l_quantity").cast("int") * 2, F.lit(100)).alias("_age"))
    age = F.col("_age")
    persons = items.join(orders, "o_orderkey").select(
        F.col("o_orderkey").alias("household_id"), "municipality", "province", "region",
        (F.col("l_linenumber") == 1).alias("reference_adult"),
        F.when(age < 100, 2023 - age).cast("short").alias("birth_year"),
        F.when(age == 100, 1923).cast("short").alias("birth_year_upper_bound"))
    sizes = items.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    households = orders.join(sizes, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("household_id"), "municipality", "province", "region",
        F.least(F.coalesce("n", F.lit(0)), F.lit(6)).cast("short").alias("size"))
    return persons, households


@query("WITH " + LINES.strip() + ORDER_FAMILIES + """
  SELECT h.household_id, any_value(h.municipality) AS municipality, any_value(size) AS size,
         CASE WHEN count(p.household_id) > 0 THEN count(p.household_id) END AS members,
         CASE WHEN count(p.household_id) > 0 THEN count(*) FILTER (reference_adult) END AS refs,
         CASE WHEN count(p.household_id) > 0 THEN count(*) FILTER (age >= 18) END AS adults
  FROM homes h LEFT JOIN items p ON p.household_id = h.household_id GROUP BY h.household_id
  HAVING count(p.household_id) <> any_value(size) OR count(*) FILTER (reference_adult) <> 1
      OR count(*) FILTER (age >= 18) < 1
      OR count(*) FILTER (p.municipality IS DISTINCT FROM h.municipality) > 0""")
def family_integrity_violations(spark: SparkSession, folder: str) -> DataFrame:
    persons, households = _order_families(spark, folder)
    return audit.family_violations(persons, households, star.REFERENCE)


@query(PUBLISHED + " SELECT * FROM population_validation")
def margin_validation(spark: SparkSession, folder: str) -> DataFrame:
    return _validation(spark, folder)


def _validation(spark: SparkSession, folder: str) -> DataFrame:
    m, _, persons, households = stored_population(spark, folder)
    places = publish.municipalities(m, 1)
    cells = publish.population_cells(publish.published_persons(persons, 1, star.REFERENCE), places)
    return publish.population_validation(m, cells, publish.published_households(households, 1), 1)


@query(PUBLISHED + """ SELECT kind, count(*) AS cells, CAST(sum(expected) AS BIGINT) AS expected,
  CAST(sum(actual) AS BIGINT) AS actual,
  count(*) FILTER (expected <> actual) AS mismatched_cells,
  max(abs(expected - actual)) AS max_absolute_error
  FROM population_validation GROUP BY kind""")
def margin_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.margin_summary(_validation(spark, folder), ["kind"])


SPEND = """WITH yearly AS (
  SELECT o_custkey, year(o_orderdate) AS y, count(*) AS orders, max(o_orderpriority) AS priority
  FROM orders GROUP BY ALL)"""


@query(SPEND + """ SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey,
    CAST(coalesce(b.y, a.y - 1) AS INTEGER) AS y,
    b.o_custkey IS NULL AS added, a.o_custkey IS NULL AS removed
  FROM (SELECT * FROM yearly WHERE y < (SELECT max(y) FROM yearly)) b
  FULL JOIN (SELECT * FROM yearly WHERE y > (SELECT min(y) FROM yearly)) a
    ON a.o_custkey = b.o_custkey AND a.y = b.y + 1
  WHERE b.o_custkey IS NULL OR a.o_custkey IS NULL OR a.orders <> b.orders
     OR a.priority IS DISTINCT FROM b.priority""")
def row_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Every year against the next one."""
    yearly = star.table(spark, folder, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_orderpriority").alias("priority"))
    before, after = star.consecutive(yearly, "y")
    found = reconcile.row_diff(before, after, ["o_custkey", "y"], ["orders", "priority"])
    return found.select("o_custkey", "y", F.col("before").isNull().alias("added"),
                        F.col("after").isNull().alias("removed"))


@query(PERSONS + """ SELECT count(*) AS changed FROM persons p FULL JOIN individuals i
  USING (person_id) WHERE p.person_id IS NULL OR i.person_id IS NULL
  OR p.citizenship_code IS DISTINCT FROM i.citizenship_code OR p.sex IS DISTINCT FROM i.sex
  OR p.birth_year IS DISTINCT FROM i.birth_year""")
def stage_changes(spark: SparkSession, folder: str) -> DataFrame:
    cells = cells_of(spark, folder)
    individuals = materialize(synthesize.individuals(cells, star.REFERENCE), "individuals")
    persons = synthesize.assign_households(individuals, cells, star.REFERENCE)
    return audit.stage_changes(individuals, persons).agg(F.count(F.lit(1)).alias("changed"))


@query("""SELECT c_custkey, c_nationkey FROM customer
  WHERE NOT EXISTS (SELECT 1 FROM orders
    WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def orphan_keys(spark: SparkSession, folder: str) -> DataFrame:
    customer = star.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    orders = star.table(spark, folder, "orders").filter(
        F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    return gates.orphans(customer, orders, {"c_custkey": "o_custkey"})


IDENTITY = """SELECT '{t}' AS source, count(*) AS records, count(DISTINCT {k}) AS distinct_ids,
  min({k}) AS min_id, max({k}) AS max_id,
  count(*) = count(DISTINCT {k}) AND max({k}) - min({k}) + 1 = count(*) AS dense FROM {t}"""
IDENTITIES = {"orders": "o_orderkey", "lineitem": "l_orderkey", "part": "p_partkey",
              "events": "event_id", "documents": "doc_id", "pages": "page_id"}


@query(" UNION ALL ".join(IDENTITY.format(t=t, k=k) for t, k in IDENTITIES.items()))
def identity_profile(spark: SparkSession, folder: str) -> DataFrame:
    frames = [
        audit.identity_profile(star.table(spark, folder, name), key).withColumn(
            "source", F.lit(name)) for name, key in IDENTITIES.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


@query(MARGINS + """ SELECT CAST(CASE WHEN grouping(municipality) = 0 THEN 0
      WHEN grouping(province) = 0 THEN 1 ELSE 2 END AS INTEGER) AS level,
    municipality, province, sex, age, CAST(sum(n) AS BIGINT) AS n
  FROM demography JOIN locality USING (municipality)
  GROUP BY GROUPING SETS ((municipality, sex, age), (province, sex, age), (sex, age))""")
def hierarchy_margins(spark: SparkSession, folder: str) -> DataFrame:
    m = star.margins(spark, folder, False)
    cells = m.demography.join(m.locality, "municipality")
    return reconcile.hierarchy_margins(
        cells, [["municipality"], ["province"], []], ["sex", "age"]
    ).select("level", "municipality", "province", "sex", "age", "n")


@query("""SELECT region, sex, CAST(age_lower AS INTEGER) AS age_lower, persons FROM (
    SELECT region, sex, least(age // 10 * 10, 90) AS age_lower, count(*) AS persons,
           min(count(*)) OVER () AS smallest
    FROM persons GROUP BY ALL) WHERE smallest >= 10""".join([PERSONS + " ", ""]))
def suppressed_package(spark: SparkSession, folder: str) -> DataFrame:
    _, persons, _ = population(spark, folder)
    # The package reads its cells twice: for the smallest one and for the table.
    return audit.release_package(materialize(audit.region_cells(persons, star.REFERENCE), "region_cells"))


RARE = "SELECT count(*) AS rare_cells, CAST(coalesce(sum(n), 0) AS BIGINT) AS records FROM "


@query(RARE + """(SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey
  GROUP BY c_nationkey, c_mktsegment, o_orderpriority HAVING count(*) < 5)""")
def rare_cells(spark: SparkSession, folder: str) -> DataFrame:
    customer = star.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    orders = star.table(spark, folder, "orders").select("o_custkey", "o_orderpriority")
    return audit.rare_cells(orders.join(customer, "o_custkey"),
                            ["c_nationkey", "c_mktsegment", "o_orderpriority"])


@query(INDIVIDUALS + " " + RARE + """(SELECT count(*) AS n FROM individuals
  GROUP BY municipality, sex, birth_year, birth_year_upper_bound, citizenship_code
  HAVING count(*) < 5)""")
def rare_citizenship_cells(spark: SparkSession, folder: str) -> DataFrame:
    people = synthesize.individuals(cells_of(spark, folder), star.REFERENCE)
    return audit.rare_cells(people, ["municipality", "sex", "birth_year",
                                     "birth_year_upper_bound", "citizenship_code"])


@query(PERSONS + """ SELECT (SELECT count(*) FROM persons) AS persons,
  (SELECT count(*) FROM persons WHERE household_id IS NULL) AS unassigned_adults,
  (SELECT count(*) FROM dwellings) AS households,
  count(DISTINCT municipality) AS municipalities, count(DISTINCT province) AS provinces,
  count(DISTINCT region) AS regions,
  (SELECT count(*) FROM persons WHERE citizenship_code = '100') AS domestic_persons,
  (SELECT count(*) FROM persons WHERE citizenship_code <> '100') AS foreign_persons,
  (SELECT count(*) FROM persons WHERE citizenship_code = '999') AS stateless_persons
  FROM locality""")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    m = star.margins(spark, folder)
    cells = synthesize.Cells.build(m)
    persons = synthesize.assign_households(synthesize.individuals(cells, star.REFERENCE), cells, star.REFERENCE)
    households = synthesize.households(cells)
    # Persons are read for several totals; nothing here compares them with the individuals.
    stored = materialize_all(persons=persons, households=households)
    return audit.summary(stored["persons"], stored["households"], m, star.REFERENCE).select(
        "persons", "unassigned_adults", "households", "municipalities", "provinces", "regions",
        "domestic_persons", "foreign_persons", "stateless_persons")


# Damage by a rule on the keys: every check of the audit has something to find.
DAMAGED = PERSONS + """,
found_persons AS (
  SELECT person_id, CASE WHEN person_id % 503 = 0 THEN household_id + 10000000 ELSE household_id END AS household_id,
    CASE WHEN person_id % 997 = 3 THEN '999999' ELSE municipality END AS municipality, province, region,
    CASE WHEN person_id % 811 = 4 THEN birth_year - 200 ELSE birth_year END AS birth_year, birth_year_upper_bound,
    CASE WHEN person_id % 1001 = 7 THEN CASE sex WHEN 'M' THEN 'F' ELSE 'M' END ELSE sex END AS sex,
    reference_adult, CASE WHEN person_id % 907 = 2 THEN 'real' ELSE data_kind END AS data_kind,
    CASE WHEN person_id % 613 = 5 THEN NULL ELSE citizenship_code END AS citizenship_code
  FROM persons WHERE person_id % 701 <> 1),
aged AS (SELECT *, 2023 - coalesce(birth_year, birth_year_upper_bound) AS age FROM found_persons),
found_homes AS (
  SELECT household_id, municipality, province, region,
    CASE WHEN household_id % 301 = 0 THEN 7 ELSE size END AS size FROM dwellings WHERE household_id % 499 <> 2),
members AS (
  SELECT household_id, municipality, province, region, count(*) AS n, count(*) FILTER (reference_adult) AS refs,
    count(*) FILTER (age >= 18) AS adults FROM aged WHERE household_id IS NOT NULL GROUP BY ALL),
family AS (
  SELECT h.household_id, any_value(h.size) AS size, coalesce(sum(m.n), 0) AS n, coalesce(sum(m.refs), 0) AS refs,
    coalesce(sum(m.adults), 0) AS adults, count(*) FILTER (m.n IS NOT NULL AND (m.municipality, m.province, m.region)
      IS DISTINCT FROM (h.municipality, h.province, h.region)) AS elsewhere
  FROM found_homes h LEFT JOIN members m ON m.household_id = h.household_id GROUP BY h.household_id),
people_ids AS (SELECT count(*) AS records, count(DISTINCT person_id) AS ids, min(person_id) AS low,
  max(person_id) AS high, (SELECT sum(n) FROM demography) AS expected FROM found_persons),
home_ids AS (SELECT count(*) AS records, count(DISTINCT household_id) AS ids, min(household_id) AS low,
  max(household_id) AS high, (SELECT sum(n) FROM sizes) AS expected FROM found_homes),
individual_ids AS (SELECT count(*) AS records, count(DISTINCT person_id) AS ids, min(person_id) AS low,
  max(person_id) AS high, (SELECT sum(n) FROM demography) AS expected FROM individuals),
individual_ages AS (SELECT *, 2023 - coalesce(birth_year, birth_year_upper_bound) AS age FROM individuals)"""


def _margin_sql(name: str, expected: str, actual: str, keys: str) -> str:
    return f"""SELECT '{name}' AS check_name, count(*) AS violations FROM (
      SELECT {keys}, n AS e FROM ({expected}) WHERE n > 0) FULL JOIN (
      SELECT {keys}, count(*) AS a FROM ({actual}) GROUP BY ALL) USING ({keys})
      WHERE coalesce(e, 0) <> coalesce(a, 0)"""


def _rows_sql(name: str, table: str, bad: str) -> str:
    return f"SELECT '{name}', count(*) FILTER ({bad}) FROM {table}"


def _identity_sql(name: str, table: str) -> str:
    return f"""SELECT '{name}', CASE WHEN records = ids AND records = expected AND low = 1 AND high = records
      THEN 0 ELSE 1 END FROM {table}"""


AUDIT_SQL = DAMAGED + " SELECT check_name, violations = 0 AS passed, CAST(violations AS BIGINT) AS violations FROM (" + (
    " UNION ALL ".join([
        _margin_sql("sex_age_joint", "SELECT * FROM demography", "SELECT municipality, sex, age FROM aged",
                    "municipality, sex, age"),
        *[f"SELECT '{name}', 0" for name in ("persons_schema", "households_schema", "pre_household_schema")],
        _identity_sql("person_identity", "people_ids"), _identity_sql("household_identity", "home_ids"),
        _identity_sql("pre_household_identity", "individual_ids"),
        _rows_sql("birth_domains", "found_persons", """NOT coalesce(
          (birth_year BETWEEN 1924 AND 2023 AND birth_year_upper_bound IS NULL)
          OR (birth_year IS NULL AND birth_year_upper_bound = 1923), false)"""),
        _rows_sql("person_domains", "aged", """sex IS NULL OR sex NOT IN ('M', 'F') OR reference_adult IS NULL
          OR data_kind IS DISTINCT FROM 'synthetic' OR (reference_adult AND (age < 18 OR household_id IS NULL))
          OR (age < 18 AND household_id IS NULL)"""),
        _rows_sql("citizenship_domain", "found_persons", "citizenship_code IS NULL"),
        _rows_sql("citizenship_present", "individuals", "citizenship_code IS NULL"),
        _rows_sql("household_domains", "found_homes", "size IS NULL OR size NOT BETWEEN 1 AND 6"),
        _rows_sql("family_integrity", "family", "n <> size OR refs <> 1 OR adults < 1 OR elsewhere > 0"),
        """SELECT 'foreign_keys', count(*) FROM found_persons p WHERE household_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM found_homes h WHERE h.household_id = p.household_id)""",
        _margin_sql("household_sizes", "SELECT * FROM sizes", "SELECT municipality, size FROM found_homes",
                    "municipality, size"),
        *[f"""SELECT '{name}_geography', count(*) FROM (SELECT DISTINCT municipality, province, region FROM {table}
          EXCEPT SELECT municipality, province, region FROM locality)"""
          for name, table in (("persons", "found_persons"), ("households", "found_homes"))],
        """SELECT 'residual_by_municipality', count(*) FROM (
          SELECT municipality, population - capacity AS e FROM totals) FULL JOIN (
          SELECT municipality, count(*) FILTER (household_id IS NULL) AS a FROM found_persons GROUP BY ALL)
          USING (municipality) WHERE coalesce(e, 0) <> coalesce(a, 0)""",
        *[_margin_sql(prefix + name, f"SELECT * FROM {name}", actual.format(table), keys)
          for prefix, table in (("", "aged"), ("pre_household_", "individual_ages")) for name, actual, keys in (
              ("countries", "SELECT municipality, sex, citizenship_code AS code FROM {}", "municipality, sex, code"),
              ("foreigners", "SELECT municipality, sex, age FROM {} WHERE citizenship_code <> '100'",
               "municipality, sex, age"))],
        _margin_sql("pre_household_sex_age", "SELECT * FROM demography",
                    "SELECT municipality, sex, age FROM individual_ages", "municipality, sex, age"),
        """SELECT 'stages_unchanged', count(*) FROM individuals b FULL JOIN found_persons a
          ON a.person_id = b.person_id WHERE a.person_id IS NULL OR b.person_id IS NULL
          OR (a.municipality, a.province, a.region, a.birth_year, a.birth_year_upper_bound, a.sex, a.data_kind,
              a.citizenship_code) IS DISTINCT FROM (b.municipality, b.province, b.region, b.birth_year,
              b.birth_year_upper_bound, b.sex, b.data_kind, b.citizenship_code)""",
    ])) + ")"


def damaged(persons: DataFrame, households: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables with every kind of damage that the audit looks for."""
    def where(rest: int, divisor: int, value, column: str, key: str = "person_id"):
        changed = F.when(F.col(key) % divisor == rest, value).otherwise(F.col(column))
        return changed.cast(dict(persons.dtypes + households.dtypes)[column])

    other = F.when(F.col("sex") == "M", "F").otherwise("M")
    people = persons.filter("person_id % 701 <> 1").withColumns({
        "household_id": where(0, 503, F.col("household_id") + 10_000_000, "household_id"),
        "municipality": where(3, 997, F.lit("999999"), "municipality"),
        "birth_year": where(4, 811, F.col("birth_year") - 200, "birth_year"),
        "sex": where(7, 1001, other, "sex"),
        "data_kind": where(2, 907, F.lit("real"), "data_kind"),
        "citizenship_code": where(5, 613, F.lit(None), "citizenship_code")})
    homes = households.filter("household_id % 499 <> 2").withColumn(
        "size", where(0, 301, F.lit(7), "size", "household_id"))
    return people, homes


@query(AUDIT_SQL)
def record_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Every gate of the audit over damaged records, with the number of violations it finds."""
    m, individuals, persons, households = stored_population(spark, folder)
    people, homes = damaged(persons, households)
    return audit.record_gates(people, homes, m, star.REFERENCE, individuals).frame()


PUBLISHED_DAMAGE = PUBLISHED + """,
pp AS (
  SELECT CASE WHEN person_id % 977 = 4 THEN person_id + 1 ELSE person_id END AS person_id,
    CASE WHEN person_id % 401 = 7 THEN NULL ELSE household_id END AS household_id,
    CASE WHEN person_id % 883 = 2 THEN 77 ELSE municipality_code END AS municipality_code,
    CASE WHEN person_id % 211 = 3 THEN 'X' ELSE sex END AS sex, birth_year, birth_year_upper_bound,
    CASE WHEN person_id % 601 = 11 THEN 0 ELSE citizenship_code END AS citizenship_code, reference_adult,
    CASE WHEN person_id % 701 = 5 THEN DATE '2020-01-01' ELSE reference_date END AS reference_date,
    CASE WHEN person_id % 307 = 5 THEN age + 1 ELSE age END AS age, age_is_lower_bound, data_kind
  FROM population_persons WHERE person_id % 503 <> 9),
hh AS (SELECT household_id, municipality_code, CASE WHEN household_id % 251 = 1 THEN 5 ELSE size END AS size,
    CASE WHEN household_id % 457 = 1 THEN 'real' ELSE data_kind END AS data_kind FROM population_households),
inside AS (SELECT household_id AS id, count(*) AS n, min(municipality_code) AS lo, max(municipality_code) AS hi,
    count(*) FILTER (reference_adult) AS refs, count(*) FILTER (reference_adult AND age < 18) AS minors
  FROM pp WHERE household_id IS NOT NULL GROUP BY ALL)"""
PUBLISHED_REPORT = {
    "person_identity": "(SELECT person_id FROM pp GROUP BY ALL HAVING count(*) <> 1 OR person_id IS NULL OR person_id < 1)",
    "household_identity": """(SELECT household_id FROM hh GROUP BY ALL
      HAVING count(*) <> 1 OR household_id IS NULL OR household_id < 1)""",
    "persons_valid": """pp WHERE municipality_code NOT IN (SELECT code FROM places) OR sex IS NULL OR sex NOT IN ('M', 'F')
      OR age IS NULL OR age NOT BETWEEN 0 AND 100 OR citizenship_code IS NULL OR citizenship_code NOT BETWEEN 1 AND 999
      OR reference_adult IS NULL OR reference_date IS DISTINCT FROM DATE '2024-01-01'
      OR data_kind IS DISTINCT FROM 'synthetic' OR age_is_lower_bound IS DISTINCT FROM (birth_year IS NULL)
      OR (birth_year IS NULL) = (birth_year_upper_bound IS NULL)
      OR (birth_year_upper_bound IS NOT NULL AND (age <> 100 OR birth_year_upper_bound <> 1923))
      OR (birth_year IS NOT NULL AND (age <> 2023 - birth_year OR age >= 100))
      OR (household_id IS NULL AND (age < 18 OR reference_adult))""",
    "household_relationships": """hh FULL JOIN inside ON id = household_id WHERE household_id IS NULL OR n IS NULL
      OR size <> n OR municipality_code <> lo OR data_kind <> 'synthetic' OR lo <> hi OR refs <> 1 OR minors <> 0""",
    "zero_error": "population_validation WHERE expected <> actual",
    "person_total": "(SELECT 1 WHERE (SELECT count(*) FROM pp) <> (SELECT sum(n) FROM demography))",
    "household_total": "(SELECT 1 WHERE (SELECT count(*) FROM hh) <> (SELECT sum(n) FROM sizes))",
}


@query(PUBLISHED_DAMAGE + " SELECT check_name, n = 0 AS passed, n AS violations FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, count(*) AS n FROM {rows}" for name, rows in PUBLISHED_REPORT.items()) + ")")
def publication_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule of a publication, over published tables with damage by a rule on the keys."""
    m, _, persons, households = stored_population(spark, folder)
    people = publish.published_persons(persons, 1, star.REFERENCE)
    homes = publish.published_households(households, 1)
    places = publish.municipalities(m, 1)
    validation = publish.population_validation(
        m, publish.population_cells(people, places), homes, 1)

    def where(df: DataFrame, key: str, divisor: int, rest: int, column: str, value) -> DataFrame:
        changed = F.when(F.col(key) % divisor == rest, value).otherwise(F.col(column))
        return df.withColumn(column, changed.cast(df.schema[column].dataType))

    people = people.filter("person_id % 503 <> 9")
    for divisor, rest, column, value in (
            (401, 7, "household_id", F.lit(None)), (883, 2, "municipality_code", F.lit(77)), (211, 3, "sex", F.lit("X")),
            (601, 11, "citizenship_code", F.lit(0)), (701, 5, "reference_date", F.lit("2020-01-01").cast("date")),
            (307, 5, "age", F.col("age") + 1), (977, 4, "person_id", F.col("person_id") + 1)):  # the key itself last
        people = where(people, "person_id", divisor, rest, column, value)
    homes = where(where(homes, "household_id", 251, 1, "size", F.lit(5)), "household_id", 457, 1, "data_kind", F.lit("real"))
    # Row by row from tables that are stored already, so nothing is written again.
    return publish.publication_gates(people, homes, places, validation, m, star.REFERENCE).frame()
