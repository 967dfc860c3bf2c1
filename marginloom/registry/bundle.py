"""A territorial bundle counted from the star schema: yearly line counts by place, sex and age."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginloom.plans import coverage, releases, star
from marginloom.registry import query
from marginloom.session import materialize

COUNTED = """counted AS (
  SELECT year(o_orderdate) AS y, lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS m,
         lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS r,
         CASE WHEN l_linestatus = 'O' THEN 'M' ELSE 'F' END AS sex,
         CAST(least(CAST(l_quantity AS INTEGER) * 2 // 10 * 10, 90) AS INTEGER) AS lo,
         count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"""
TERRITORIES = COUNTED + """,
territories AS (
  SELECT concat(y, '-01-01:', code) AS key, concat('STAR:', y, '-01-01') AS scheme, code, level,
         make_date(y, 1, 1) AS snapshot,
         CASE WHEN parent IS NOT NULL THEN concat(y, '-01-01:', parent) END AS parent_key
  FROM (SELECT DISTINCT y, m AS code, 'municipality' AS level, r AS parent FROM counted
        UNION SELECT DISTINCT y, r, 'region', 'ALL' FROM counted
        UNION SELECT DISTINCT y, 'ALL', 'country', NULL FROM counted))"""
BUNDLE = "WITH " + TERRITORIES + """,
spread AS (
  SELECT y, unnest([m, r, 'ALL']) AS code, sex, lo, n FROM counted),
sexes AS (SELECT y, code, unnest([sex, 'TOTAL']) AS sex, lo, n FROM spread),
ages AS (
  SELECT y, code, sex, unnest([CASE WHEN lo = 90 THEN '90:1000' ELSE concat(lo, ':', lo + 10) END,
                               'TOTAL']) AS age, n FROM sexes),
observations AS (
  SELECT concat(y, '-01-01:', code) AS territory_key,
         concat_ws('_', 'lines', lower(sex), replace(lower(age), ':', '_')) AS series_code,
         make_date(y, 1, 1) AS period, CAST(sum(n) AS DECIMAL(20, 6)) AS value, sex, age
  FROM ages GROUP BY ALL)"""


def bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Territories, series and observations, stored because every check reads them again."""
    item = star.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("l_linestatus") == "O", "M").otherwise("F").alias("sex"),
        F.least(F.floor(F.col("l_quantity").cast("int") * 2 / 10) * 10, F.lit(90)).cast("int")
        .alias("lo"))
    orders = star.table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    customer = star.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = star.table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), star.place("n_nationkey").alias("m"),
        F.lpad(F.col("n_regionkey").cast("string"), 2, "0").alias("r"))
    counted = materialize(
        item.join(orders, "o_orderkey").join(customer, "o_custkey").join(nation, "c_nationkey")
        .groupBy("y", "m", "r", "sex", "lo").agg(F.count(F.lit(1)).alias("n")), "counted")
    # Every cell belongs to three places, two sexes and two age classes.
    sides = counted.withColumn("code", F.explode(F.array("m", "r", F.lit("ALL"))))
    sides = sides.withColumn("sex", F.explode(F.array("sex", F.lit("TOTAL"))))
    label = F.when(F.col("lo") == 90, "90:1000").otherwise(
        F.concat_ws(":", F.col("lo").cast("string"), (F.col("lo") + 10).cast("string")))
    sides = sides.withColumn("age", F.explode(F.array(label, F.lit("TOTAL"))))
    day = F.make_date(F.col("y"), F.lit(1), F.lit(1))
    key = F.concat_ws(":", day.cast("string"), "code")
    series_code = F.concat_ws("_", F.lit("lines"), F.lower("sex"),
                              F.replace(F.lower("age"), F.lit(":"), F.lit("_")))
    cells = materialize(sides.groupBy("y", "code", "sex", "age").agg(F.sum("n").alias("n")).select(
        key.alias("territory_key"), series_code.alias("series_code"), day.alias("period"),
        F.col("n").cast("decimal(20,6)").alias("value"), F.lit("unflagged_upstream").alias("status"),
        *[F.lit("").alias(c) for c in ("upstream_status", "upstream_note", "upstream_unit",
                                       "upstream_unit_multiplier")], "sex", "age"), "observations")
    places = counted.select("y", F.explode(F.array(
        F.struct(F.col("m").alias("code"), F.lit("municipality").alias("level"),
                 F.col("r").alias("parent")),
        F.struct(F.col("r").alias("code"), F.lit("region").alias("level"),
                 F.lit("ALL").alias("parent")),
        F.struct(F.lit("ALL").alias("code"), F.lit("country").alias("level"),
                 F.lit(None).cast("string").alias("parent")))).alias("p")).select(
        "y", "p.*").distinct()
    parent = F.when(F.col("parent").isNotNull(), F.concat_ws(":", day.cast("string"), "parent"))
    territories = materialize(places.select(
        key.alias("key"), F.concat(F.lit("STAR:"), day.cast("string")).alias("scheme"), "code",
        F.col("code").alias("name"), "level", day.alias("valid_from"),
        F.date_add(day, 1).alias("valid_to"), day.alias("snapshot"), parent.alias("parent_key")),
        "territories")
    series = cells.select("series_code", "sex", "age").distinct().select(
        F.col("series_code").alias("code"), F.col("series_code").alias("title"),
        F.lit("persons").alias("unit"), F.create_map(
            F.lit("measure"), F.lit("lines"), F.lit("sex"), F.col("sex"), F.lit("age"),
            F.col("age")).alias("dimensions"))
    return territories, series, cells.drop("sex", "age")


@query(BUNDLE + """ SELECT territory_key, series_code, period, value FROM observations""")
def bundle_observations(spark: SparkSession, folder: str) -> DataFrame:
    return releases.observation_cells(bundle(spark, folder)[2])


GEO = """, geo AS (
  SELECT concat('geo:', c.series_code, ':', t.parent_key) AS name, 'territory' AS dimension,
         t.parent_key AS t_key, c.series_code AS t_series, c.period,
         c.territory_key AS p_key, c.series_code AS p_series, c.value AS p_value,
         p.value AS t_value
  FROM observations c JOIN territories t ON t.key = c.territory_key
  JOIN observations p ON p.territory_key = t.parent_key AND p.series_code = c.series_code
   AND p.period = c.period)"""
DIMS = GEO + """, dims AS (
  SELECT concat('sex:', t.territory_key, ':', t.series_code) AS name, 'sex' AS dimension,
         t.territory_key AS t_key, t.series_code AS t_series, t.period, p.territory_key AS p_key,
         p.series_code AS p_series, p.value AS p_value, t.value AS t_value
  FROM observations t JOIN observations p USING (territory_key, period)
  WHERE t.sex = 'TOTAL' AND p.sex <> 'TOTAL' AND p.age = t.age
  UNION ALL
  SELECT concat('age:', t.territory_key, ':', t.series_code), 'age', t.territory_key,
         t.series_code, t.period, p.territory_key, p.series_code, p.value, t.value
  FROM observations t JOIN observations p USING (territory_key, period)
  WHERE t.age = 'TOTAL' AND p.age <> 'TOTAL' AND p.sex = t.sex),
terms AS (SELECT * FROM geo UNION ALL SELECT * FROM dims)"""


@query(BUNDLE + GEO + """ SELECT name, t_key AS territory_key, t_series AS series_code, period,
  count(*) AS parts FROM geo GROUP BY ALL HAVING count(*) >= 2""")
def derived_equations(spark: SparkSession, folder: str) -> DataFrame:
    territories, _, observations = bundle(spark, folder)
    headers, parts = coverage.territory_equations(observations, territories)
    counts = parts.groupBy("name").agg(F.count(F.lit(1)).alias("parts"))
    return headers.join(counts, "name").select("name", *coverage.CELL, "parts")


@query(BUNDLE + DIMS + """ SELECT name, p_key AS territory_key, p_series AS series_code, period
  FROM dims WHERE name IN (SELECT name FROM dims GROUP BY name HAVING count(*) >= 2)""")
def dimension_equations(spark: SparkSession, folder: str) -> DataFrame:
    territories, series, observations = bundle(spark, folder)
    return coverage.dimension_equations(observations, territories, series)[1]


def _equations(territories: DataFrame, series: DataFrame,
               observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = coverage.territory_equations(observations, territories)
    second = coverage.dimension_equations(observations, territories, series)
    return (materialize(first[0].unionByName(second[0]), "equations"),
            materialize(first[1].unionByName(second[1]), "parts"))


@query(BUNDLE + DIMS + """ SELECT name, dimension, count(*) AS parts, any_value(t_value) AS total,
    CAST(sum(p_value) AS DECIMAL(26, 6)) AS parts_sum,
    CAST(sum(p_value) - any_value(t_value) AS DECIMAL(26, 6)) AS difference,
    abs(sum(p_value) - any_value(t_value)) <= 0 AS reconciled
  FROM terms GROUP BY name, dimension HAVING count(*) >= 2""")
def equation_check(spark: SparkSession, folder: str) -> DataFrame:
    territories, series, observations = bundle(spark, folder)
    equations, parts = _equations(territories, series, observations)
    terms = coverage.equation_terms(equations, parts, observations, territories, series)
    return coverage.equation_check(terms).drop("tolerance")


@query(BUNDLE + """ SELECT series_code, period, concat('STAR:', period) AS scheme,
  period AS snapshot, count(*) AS row_count FROM observations GROUP BY ALL""")
def coverage_rows(spark: SparkSession, folder: str) -> DataFrame:
    territories, _, observations = bundle(spark, folder)
    return coverage.coverage_rows(coverage.coverage_members(observations, territories))


@query("WITH " + TERRITORIES + """, known AS (SELECT * FROM territories WHERE year(snapshot) < 1998),
  ids AS (SELECT key, row_number() OVER (ORDER BY scheme, code) AS territory_id FROM known),
  fresh AS (SELECT key, (SELECT max(territory_id) FROM ids) + row_number() OVER (
      ORDER BY scheme, code) AS territory_id FROM territories WHERE year(snapshot) >= 1998)
  SELECT key, territory_id FROM ids UNION ALL SELECT key, territory_id FROM fresh""")
def territory_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Versions before 1998 are stored with ids; the later ones are numbered after them."""
    territories = bundle(spark, folder)[0]
    known = territories.filter(F.year("snapshot") < 1998)
    nothing = known.limit(0).withColumn("territory_id", F.lit(0).cast("long"))
    stored = releases.assign_territory_ids(known, nothing)
    return releases.assign_territory_ids(territories, stored).select("key", "territory_id")


@query(BUNDLE + """, ids AS (SELECT *, row_number() OVER (ORDER BY scheme, code) AS territory_id
    FROM territories)
  SELECT 'r1' AS release_id, o.series_code, 'persons' AS unit, t.territory_id,
    t.code AS territory_code, t.code AS territory_name, t.scheme, o.period, o.value,
    'unflagged_upstream' AS status, t.level, p.code AS parent_code, '' AS upstream_status,
    '' AS upstream_note, '' AS upstream_unit, '' AS upstream_unit_multiplier
  FROM observations o JOIN ids t ON t.key = o.territory_key
  LEFT JOIN ids p ON p.key = t.parent_key""")
def load_observations(spark: SparkSession, folder: str) -> DataFrame:
    territories, series, observations = bundle(spark, folder)
    nothing = territories.limit(0).withColumn("territory_id", F.lit(0).cast("long"))
    placed = releases.assign_territory_ids(territories, nothing)
    return releases.load_observations(observations, placed, series, "r1")


@query(BUNDLE + """ SELECT series_code, series_code AS title, 'persons' AS unit,
  concat('{"age":"', age, '","measure":"lines","sex":"', sex, '"}') AS dimensions, period,
  count(*) AS row_count FROM observations GROUP BY ALL""")
def coverage_table(spark: SparkSession, folder: str) -> DataFrame:
    territories, series, observations = bundle(spark, folder)
    rows = coverage.coverage_rows(coverage.coverage_members(observations, territories))
    return releases.coverage_table(rows, series, "r1").select(
        "series_code", "title", "unit", "dimensions", "period", "row_count")


@query(BUNDLE + """, cut AS (SELECT territory_key, sex, age, CAST(split_part(age, ':', 1) AS BIGINT)
      AS lo, CAST(split_part(age, ':', 2) AS BIGINT) AS hi FROM observations
    WHERE age <> 'TOTAL' AND value >= 15),
  n AS (SELECT *, lead(lo) OVER (PARTITION BY territory_key, sex ORDER BY lo, hi) AS nxt FROM cut)
  SELECT territory_key, sex, count(*) FILTER (NOT (lo < hi AND (nxt IS NULL OR nxt = hi)))
      AS breaks, min(lo) AS first, max(hi) AS last
  FROM n GROUP BY ALL HAVING count(*) FILTER (NOT (lo < hi AND (nxt IS NULL OR nxt = hi))) > 0
    OR min(lo) <> 0 OR max(hi) <> 1000""")
def range_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Places whose age classes with fifteen lines or more leave a gap."""
    _, series, observations = bundle(spark, folder)
    kinds = series.select(F.col("code").alias("series_code"),
                          F.element_at("dimensions", "sex").alias("sex"),
                          F.element_at("dimensions", "age").alias("age"))
    cut = observations.filter("value >= 15").join(kinds, "series_code").filter("age <> 'TOTAL'")
    return coverage.range_tiling(cut, ["territory_key", "sex"], "age", F.lit(0)).drop(
        "required_first")


# Events: at the end of every year the nations of each region merge into its first nation.
EVENTS = BUNDLE + """, olds AS (SELECT key, CAST(year(snapshot) AS INTEGER) AS y,
    split_part(parent_key, ':', 2) AS region FROM territories WHERE level = 'municipality'),
  news AS (SELECT region, y - 1 AS y, min(key) AS to_key FROM olds GROUP BY ALL),
  pairs AS (SELECT concat('merge-', region, '-', y) AS event_id, o.key AS from_key, n.to_key
    FROM olds o JOIN news n USING (region, y))"""


def events(territories: DataFrame) -> DataFrame:
    """One merger per region and year; an event document lists the codes of one region."""
    municipal = territories.filter("level = 'municipality'").select(
        "key", F.element_at(F.split("parent_key", ":"), 2).alias("region"),
        F.year("snapshot").alias("y"))
    old = municipal.groupBy("region", "y").agg(F.array_sort(F.collect_list("key")).alias("from_keys"))
    new = municipal.groupBy("region", (F.col("y") - 1).alias("y")).agg(
        F.array(F.min("key")).alias("to_keys"))
    return old.join(new, ["region", "y"]).select(
        F.concat_ws("-", F.lit("merge"), "region", "y").alias("event_id"),
        F.lit("merger").alias("kind"), F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)).alias("effective_date"),
        F.lit("urn:e").alias("source_url"), F.lit("0" * 64).alias("evidence_sha256"),
        F.col("region").alias("description"), "from_keys", "to_keys", F.lit("exact").alias("weight_basis"))


@query(EVENTS + """ SELECT row_number() OVER (ORDER BY event_id, from_key, to_key) AS id, event_id,
    f.code AS from_code, f.scheme AS from_scheme, t.code AS to_code, t.scheme AS to_scheme,
    CAST(1 AS DECIMAL(20, 12)) AS allocation_weight
  FROM pairs JOIN territories f ON f.key = from_key JOIN territories t ON t.key = to_key""")
def crosswalk_rows(spark: SparkSession, folder: str) -> DataFrame:
    territories = bundle(spark, folder)[0]
    rows = coverage.crosswalk_pairs(events(territories), territories)
    return rows.select("id", "event_id", "from_code", "from_scheme", "to_code", "to_scheme",
                       "allocation_weight")


@query(EVENTS + """ SELECT to_key AS key, series_code, CAST(sum(value) AS DECIMAL(20, 6)) AS value
  FROM pairs JOIN observations ON territory_key = from_key GROUP BY ALL""")
def reaggregate_exact(spark: SparkSession, folder: str) -> DataFrame:
    """All series of all years but the last, whose nations merge into nothing."""
    territories, _, observations = bundle(spark, folder)
    changes = materialize(events(territories), "events")
    merging = changes.select(F.explode("from_keys").alias("territory_key"))
    values = materialize(observations.join(merging, "territory_key").select(
        F.col("territory_key").alias("key"), "series_code", "value"), "values")
    return coverage.reaggregate_exact(values, changes, by=["series_code"])


CUSTOMER_CODES = """WITH codes AS (SELECT DISTINCT make_date(year(o_orderdate), 1, 1) AS snapshot,
    CAST(o_custkey AS VARCHAR) AS code, c_mktsegment AS segment
    FROM orders JOIN customer ON o_custkey = c_custkey),
  days AS (SELECT snapshot AS before, lead(snapshot) OVER (ORDER BY snapshot) AS after
    FROM (SELECT DISTINCT snapshot FROM codes)),
  old AS (SELECT before, after, code, segment FROM codes JOIN days ON snapshot = before
          WHERE after IS NOT NULL),
  new AS (SELECT before, after, code, segment FROM codes JOIN days ON snapshot = after),
  firsts AS (SELECT snapshot, min(code) AS first_code FROM codes GROUP BY ALL),
  changed AS (SELECT *, 'removed' AS change FROM old ANTI JOIN new USING (before, after, code)
    UNION ALL SELECT *, 'added' FROM new ANTI JOIN old USING (before, after, code))"""


@query(CUSTOMER_CODES + """ SELECT before, after, code, change FROM changed c
  WHERE NOT (change = 'removed' AND segment = 'BUILDING')
    AND NOT (change = 'added' AND code = (SELECT first_code FROM firsts f WHERE f.snapshot = c.after)
      AND EXISTS (SELECT 1 FROM changed b WHERE b.after = c.after AND b.change = 'removed'
                  AND b.segment = 'BUILDING'))""")
def unexplained_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Customers that start or stop ordering; events explain the ones of one segment only."""
    orders = star.table(spark, folder, "orders").select(
        "o_custkey", F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("snapshot"))
    customer = star.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    places = orders.distinct().join(customer, "o_custkey").select(
        F.concat_ws(":", F.col("snapshot").cast("string"), F.col("o_custkey").cast("string"))
        .alias("key"), "snapshot", F.col("o_custkey").cast("string").alias("code"), "segment",
        F.lit("municipality").alias("level"))
    places = materialize(places, "customers")
    firsts = places.groupBy("snapshot").agg(F.min("code").alias("first"))
    by_day = Window.partitionBy(F.lit(0)).orderBy("snapshot")
    following = firsts.select("snapshot", F.lead("snapshot").over(by_day).alias("after"))
    stopped = places.filter("segment = 'BUILDING'").join(following, "snapshot").join(
        places.select("code", F.col("snapshot").alias("after")), ["code", "after"], "left_anti")
    changes = stopped.join(firsts.withColumnRenamed("snapshot", "after"), "after").select(
        F.array("key").alias("from_keys"),
        F.array(F.concat_ws(":", F.col("after").cast("string"), "first")).alias("to_keys"))
    return coverage.unexplained_changes(places, changes)


# The same bundle with damage by a rule on the keys, and every check of its report.
DAMAGED = EVENTS + DIMS + """,
t AS (
  SELECT key, scheme, code, CASE WHEN code = '000005' THEN ' ' ELSE code END AS name, level, snapshot,
    snapshot AS valid_from, CAST(snapshot + 1 AS DATE) AS valid_to,
    CASE WHEN key = '1997-01-01:000003' THEN '1996-01-01:ALL'
         WHEN key = '1996-01-01:01' THEN NULL ELSE parent_key END AS parent_key
  FROM territories, (SELECT unnest([1, 2]) AS copy)
  WHERE key <> '1996-01-01:000007' AND (copy = 1 OR key = '1995-01-01:000002')),
o AS (
  SELECT territory_key, series_code, period, sex, age,
    CASE WHEN code = '000009' AND sex = 'M' THEN NULL WHEN code = '000010' AND sex = 'F' THEN -value
         WHEN code = '000004' AND sex = 'M' THEN value + 1 ELSE value END AS value,
    CASE WHEN code = '000012' THEN 'demo' ELSE 'unflagged_upstream' END AS status
  FROM (SELECT *, split_part(territory_key, ':', 2) AS code FROM observations)
  WHERE NOT (code = '000013' AND year(period) = 1997 AND sex = 'TOTAL')),
kinds AS (SELECT DISTINCT series_code, sex, age FROM observations),
heads AS (SELECT name, any_value(dimension) AS dimension, any_value(t_key) AS t_key, any_value(t_series) AS t_series,
    any_value(period) AS period, CASE WHEN any_value(dimension) = 'age' AND year(any_value(period)) = 1998
      THEN -1 ELSE 0 END AS tolerance FROM terms GROUP BY name HAVING count(*) >= 2),
kept AS (SELECT name, period, p_key, p_series FROM terms SEMI JOIN heads USING (name)
  WHERE NOT (dimension = 'sex' AND p_series = 'lines_m_total' AND year(period) = 1996)),
found AS (
  SELECT h.name, h.dimension, h.tolerance, h.t_key, h.t_series, tt.scheme AS t_scheme, tv.value AS t_value,
    p.p_key, p.p_series, pt.scheme AS p_scheme, pt.parent_key AS p_parent, pv.value AS p_value,
    CASE h.dimension WHEN 'sex' THEN k.sex ELSE k.age END AS label
  FROM heads h LEFT JOIN t tt ON tt.key = h.t_key
  LEFT JOIN o tv ON tv.territory_key = h.t_key AND tv.series_code = h.t_series AND tv.period = h.period
  LEFT JOIN (kept p LEFT JOIN t pt ON pt.key = p.p_key
    LEFT JOIN kinds k ON k.series_code = p.p_series
    LEFT JOIN o pv ON pv.territory_key = p.p_key AND pv.series_code = p.p_series AND pv.period = p.period)
    ON p.name = h.name),
labelled AS (SELECT *, try_cast(split_part(label, ':', 1) AS BIGINT) AS lo,
    try_cast(split_part(label, ':', 2) AS BIGINT) AS hi FROM found WHERE dimension <> 'territory'),
tiles AS (SELECT *, lead(lo) OVER (PARTITION BY name ORDER BY lo, hi) AS nxt FROM labelled WHERE dimension = 'age'),
ev AS (
  SELECT region, y, key, true AS is_from FROM olds SEMI JOIN news USING (region, y)
  UNION ALL SELECT region, y, to_key, false FROM news SEMI JOIN olds USING (region, y)),
placed AS (
  SELECT region, y, is_from, t.level, t.snapshot,
    make_date(y + CASE WHEN region = '03' THEN 3 ELSE 1 END, 1, 1) AS effective FROM ev LEFT JOIN t USING (key))"""
BUNDLE_REPORT = {
    "unique_territories": "(SELECT key FROM t GROUP BY key HAVING count(*) > 1)",
    "territorial_validity": "t WHERE NOT (valid_from <= snapshot AND snapshot < valid_to AND trim(name) <> '')",
    "territorial_root": "t WHERE parent_key IS NULL AND level <> 'country'",
    "hierarchy": """t c LEFT JOIN t p ON p.key = c.parent_key WHERE c.parent_key IS NOT NULL AND NOT coalesce(
      p.scheme = c.scheme AND p.snapshot = c.snapshot AND p.valid_from <= c.valid_from AND c.valid_to <= p.valid_to
      AND list_position(['country', 'region', 'municipality'], p.level)
        < list_position(['country', 'region', 'municipality'], c.level), false)""",
    "territorial_overlap": """(SELECT valid_to, lead(valid_from) OVER (PARTITION BY scheme, code
      ORDER BY valid_from, valid_to) AS nxt FROM t) WHERE nxt < valid_to""",
    "source_status": "o WHERE status = 'demo'",
    "null_status": "o WHERE (value IS NULL) <> (status IN ('missing', 'suppressed'))",
    "numeric_range": "o WHERE value IS NOT NULL AND (value < 0 OR value >= 1e14 OR value <> floor(value))",
    "observation_context": """o LEFT JOIN t ON key = territory_key
      WHERE NOT coalesce(valid_from <= period AND period < valid_to, false)""",
    "coverage_exact": """(SELECT territory_key, series_code, period FROM observations
      EXCEPT SELECT territory_key, series_code, period FROM o)""",
    "coverage_vintage": "observations ANTI JOIN t ON key = territory_key",
    "equation_identity": """heads LEFT JOIN (SELECT name, count(*) AS n FROM kept GROUP BY name) USING (name)
      WHERE coalesce(n, 0) < 2""",
    "equation_cells": "found WHERE t_value IS NULL OR p_value IS NULL",
    "comparable_units_periods": "found WHERE t_scheme IS DISTINCT FROM p_scheme",
    "disjoint_territories": """found WHERE dimension = 'territory' AND NOT (t_series IS NOT DISTINCT FROM p_series
      AND p_parent IS NOT DISTINCT FROM t_key)""",
    "equation_tolerance": "found WHERE tolerance < 0",
    "distinct_labels": "(SELECT name, label FROM labelled GROUP BY ALL HAVING count(*) > 1)",
    "partition_ranges": """(SELECT name FROM tiles GROUP BY name
      HAVING count(*) FILTER (NOT coalesce(lo < hi AND (nxt IS NULL OR nxt = hi), false)) > 0
        OR min(lo) IS DISTINCT FROM 0 OR max(hi) IS DISTINCT FROM 1000)""",
    "partition_labels_sex": """(SELECT name FROM labelled WHERE dimension = 'sex' GROUP BY name
      HAVING count(*) FILTER (label IS NULL OR label NOT IN ('F', 'M')) > 0 OR count(DISTINCT label) <> 2)""",
    "equation_reconciliation": """(SELECT name FROM found GROUP BY name
      HAVING NOT coalesce(abs(sum(p_value) - any_value(t_value)) <= any_value(tolerance), false))""",
    "event_evidence": "(SELECT DISTINCT region, y FROM ev) WHERE region = '02'",
    "event_cardinality": "(SELECT DISTINCT region, y FROM ev) WHERE region = '01'",
    "no_invented_weights": "(SELECT DISTINCT region, y FROM ev) WHERE region = '01'",
    "event_known_members": "placed WHERE level IS NULL",
    "event_time": """placed WHERE NOT coalesce(CASE WHEN is_from THEN snapshot < effective
      ELSE effective <= snapshot END, false)""",
}
BUNDLE_PASSED = [
    "bounded_observations", "bounded_territories", "bounded_coverage", "unique_series", "unique_observations",
    "coverage_unique", "coverage_single_vintage", "default_selection", "equation_names", "disjoint_keys",
    "total_not_a_part", "same_territory", "partition_total", "partition_dimensions", "partition_categories",
    "partition_labels_occupancy", "evidence_identity", "event_identity", "event_members", "event_level"]
BUNDLE_SQL = DAMAGED + " SELECT check_name, n = 0 AS passed, n AS violations FROM (" + " UNION ALL ".join(
    [f"SELECT '{name}' AS check_name, count(*) AS n FROM {rows}" for name, rows in BUNDLE_REPORT.items()]
    + [f"SELECT '{name}', 0" for name in BUNDLE_PASSED]) + ")"


@query(BUNDLE_SQL)
def bundle_gates(spark: SparkSession, folder: str) -> DataFrame:
    """All rules of a bundle over damaged tables, with the number of violations of each."""
    territories, series, observations = bundle(spark, folder)
    equations, parts = _equations(territories, series, observations)
    members = materialize(coverage.coverage_members(observations, territories), "members")
    evidence = territories.select(
        F.lit("e").alias("name"), F.lit("p").alias("path"), F.lit("0" * 64).alias("sha256"),
        F.lit("urn:e").alias("url"), F.lit("").alias("retrieved_at")).distinct()
    changes = materialize(events(territories), "events")
    key, code = F.col("key"), F.element_at(F.split("territory_key", ":"), 2)
    copies = F.when(key == "1995-01-01:000002", 2).otherwise(1)
    places = territories.filter(key != "1996-01-01:000007").withColumn(
        "_copy", F.explode(F.array_repeat(F.lit(1), copies))).drop("_copy").withColumns({
            "name": F.when(F.col("code") == "000005", " ").otherwise(F.col("name")),
            "parent_key": F.when(key == "1997-01-01:000003", "1996-01-01:ALL").when(
                key == "1996-01-01:01", None).otherwise(F.col("parent_key"))})
    sex, value = F.split("series_code", "_")[1], F.col("value")
    cells = observations.filter(~((code == "000013") & (F.year("period") == 1997) & (sex == "total"))).withColumns({
        "value": F.when((code == "000009") & (sex == "m"), None).when((code == "000010") & (sex == "f"), -value).when(
            (code == "000004") & (sex == "m"), value + 1).otherwise(value).cast("decimal(20,6)"),
        "status": F.when(code == "000012", "demo").otherwise(F.col("status"))})
    heads = equations.withColumn("tolerance", F.when(
        (F.col("dimension") == "age") & (F.year("period") == 1998), -1).otherwise(0).cast("decimal(20,6)"))
    left = parts.filter(~(F.col("name").startswith("sex:") & (F.col("series_code") == "lines_m_total")
                          & (F.year("period") == 1996)))
    region = F.col("description")
    changed = changes.withColumns({
        "kind": F.when(region == "01", "split").otherwise(F.col("kind")),
        "evidence_sha256": F.when(region == "02", "1" * 64).otherwise(F.col("evidence_sha256")),
        "effective_date": F.when(region == "03", F.add_months("effective_date", 24)).otherwise(
            F.col("effective_date"))})
    damaged = {name: materialize(df, name) for name, df in (
        ("territories", places), ("observations", cells), ("equations", heads), ("parts", left))}
    found = coverage.bundle_gates(
        damaged["territories"], series, damaged["observations"], members, damaged["equations"], damaged["parts"],
        changed, evidence, False, ("lines_total_total", "1998-01-01"))
    return found.frame()
