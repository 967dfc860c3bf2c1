"""Releases and revisions, derived from the orders: one release per nation, year and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginloom.functions.hashing import content_id
from marginloom.operators import gates
from marginloom.plans import coverage, releases, star
from marginloom.registry import query
from marginloom.sources.inventory import file_inventory

NATION_ORDERS = """nation_orders AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS dataset_id, make_date(year(o_orderdate), 1, 1)
           AS reference_period, CAST(month(o_orderdate) AS INTEGER) AS month, o_orderdate, o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
RELEASES = "WITH " + NATION_ORDERS + """, monthly AS (
  SELECT dataset_id, reference_period, month, max(o_orderdate) AS published_at,
         count(*) AS row_count,
         md5(concat_ws('|', dataset_id, CAST(reference_period AS VARCHAR),
                       CAST(month AS VARCHAR))) AS id
  FROM nation_orders GROUP BY ALL),
releases AS (SELECT *, lag(id) OVER w AS supersedes_release_id,
    CASE WHEN lag(id) OVER w IS NOT NULL THEN concat('month ', month) END AS revision_reason
  FROM monthly WINDOW w AS (PARTITION BY dataset_id, reference_period ORDER BY month))"""


def order_releases(spark: SparkSession, folder: str) -> DataFrame:
    orders = star.table(spark, folder, "orders").select("o_custkey", "o_orderdate")
    customer = star.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("dataset_id"))
    monthly = orders.join(customer, "o_custkey").groupBy(
        "dataset_id", F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("reference_period"),
        F.month("o_orderdate").alias("month")).agg(
        F.max("o_orderdate").alias("published_at"), F.count(F.lit(1)).alias("row_count"))
    identity = F.md5(F.concat_ws("|", "dataset_id", F.col("reference_period").cast("string"),
                                 F.col("month").cast("string")))
    monthly = monthly.withColumn("id", identity)
    before = F.lag("id").over(
        Window.partitionBy("dataset_id", "reference_period").orderBy("month"))
    return monthly.withColumn("supersedes_release_id", before).withColumn(
        "revision_reason", F.when(F.col("supersedes_release_id").isNotNull(), F.concat(
            F.lit("month "), F.col("month").cast("string"))))


@query(RELEASES + """ SELECT id, dataset_id, reference_period, month, published_at, row_count,
  supersedes_release_id, revision_reason FROM (SELECT *, row_number() OVER (
    PARTITION BY dataset_id, reference_period ORDER BY published_at DESC, id DESC) AS r
  FROM releases) WHERE r = 1""")
def latest_release(spark: SparkSession, folder: str) -> DataFrame:
    return releases.latest_releases(order_releases(spark, folder))


@query(RELEASES + """ SELECT r.id, r.dataset_id, r.reference_period, r.published_at,
  r.supersedes_release_id, s.id AS superseded_by, s.id IS NULL AS is_current
  FROM releases r LEFT JOIN releases s ON s.supersedes_release_id = r.id""")
def supersession_chain(spark: SparkSession, folder: str) -> DataFrame:
    return releases.supersession(order_releases(spark, folder))


@query(RELEASES + """, stored AS (SELECT * FROM releases WHERE month <= 6),
  latest AS (SELECT dataset_id, reference_period, arg_max(id, (published_at, id)) AS current_id
             FROM stored GROUP BY ALL)
  SELECT id, dataset_id, reference_period, month FROM releases
  LEFT JOIN latest USING (dataset_id, reference_period)
  WHERE month > 6 AND (supersedes_release_id IS DISTINCT FROM current_id
    OR (supersedes_release_id IS NOT NULL AND trim(coalesce(revision_reason, '')) = '')
    OR (supersedes_release_id IS NULL AND revision_reason IS NOT NULL))""")
def revision_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Releases after June checked against a catalog that ends in June."""
    every = order_releases(spark, folder)
    return releases.revision_conflicts(
        every.filter("month > 6"), every.filter("month <= 6")
    ).select("id", "dataset_id", "reference_period", "month")


@query(RELEASES + """ SELECT id, dataset_id, month FROM releases WHERE month > 6""")
def idempotent_publish(spark: SparkSession, folder: str) -> DataFrame:
    """The first half-year is stored already: publishing the whole year adds the second."""
    every = order_releases(spark, folder)
    stored = every.filter("month <= 6")
    return releases.unpublished(every, stored, ["id"]).select("id", "dataset_id", "month")


YEARLY = "WITH " + NATION_ORDERS + """, cells AS (
  SELECT dataset_id, month, year(reference_period) AS y, CAST(count(*) AS BIGINT) AS value
  FROM nation_orders GROUP BY ALL)"""


@query(YEARLY + """ SELECT coalesce(b.dataset_id, a.dataset_id) AS dataset_id,
    coalesce(b.month, a.month) AS month, CAST(coalesce(b.y, a.y - 1) AS INTEGER) AS y,
    b.value AS before, a.value AS after
  FROM (SELECT * FROM cells WHERE y < (SELECT max(y) FROM cells)) b
  FULL JOIN (SELECT * FROM cells WHERE y > (SELECT min(y) FROM cells)) a
    ON a.dataset_id = b.dataset_id AND a.month = b.month AND a.y = b.y + 1
  WHERE b.value IS DISTINCT FROM a.value""")
def release_diff(spark: SparkSession, folder: str) -> DataFrame:
    """The releases of every year against those of the next one."""
    cells = order_releases(spark, folder).select(
        "dataset_id", "month", F.year("reference_period").alias("y"), F.col("row_count").alias("value"))
    return releases.release_diff(*star.consecutive(cells, "y"), ["dataset_id", "month", "y"])


@query("""WITH d AS (SELECT p_name, p_brand, p_type FROM part WHERE p_size <= 25),
  e AS (SELECT DISTINCT p_name, p_brand, p_type FROM part WHERE p_size > 25)
  SELECT DISTINCT d.p_name, d.p_brand, d.p_type AS new_type FROM d
  JOIN e USING (p_name, p_brand) WHERE d.p_type IS DISTINCT FROM e.p_type""")
def definition_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Small and large parts of one name and brand whose type differs."""
    part = star.table(spark, folder, "part")
    found = releases.definition_changes(
        part.filter("p_size <= 25"), part.filter("p_size > 25"), ["p_name", "p_brand"], ["p_type"])
    return found.select("p_name", "p_brand", F.col("_new.p_type").alias("new_type")).distinct()


VERSIONS = """WITH v AS (SELECT c_mktsegment AS scheme, CAST(o_custkey AS VARCHAR) AS code,
    CAST(o_orderdate AS DATE) AS valid_from, CAST(o_orderdate AS DATE) + {days} AS valid_to,
    o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"""


def order_versions(spark: SparkSession, folder: str, days: int) -> DataFrame:
    """Each order as a version of its customer that is valid for some days."""
    orders = star.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    customer = star.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("scheme"))
    day = F.col("o_orderdate").cast("date")
    return orders.join(customer.hint("merge"), "o_custkey").select(
        "scheme", F.col("o_custkey").cast("string").alias("code"), day.alias("valid_from"),
        F.date_add(day, days).alias("valid_to"), "o_orderkey")


@query(VERSIONS.format(days=60) + """ SELECT scheme, code, valid_from, valid_to, next_start FROM (
  SELECT *, lead(valid_from) OVER (PARTITION BY scheme, code ORDER BY valid_from, valid_to)
    AS next_start FROM v) WHERE next_start < valid_to""")
def interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    found = coverage.overlapping_intervals(order_versions(spark, folder, 60), ["scheme", "code"])
    return found.drop("o_orderkey")


@query(VERSIONS.format(days=120) + """, e AS (SELECT DISTINCT scheme, code, valid_from, valid_to
    FROM v WHERE year(valid_from) <= 1996)
  SELECT v.code, v.o_orderkey, v.valid_from, e.valid_from AS old_from FROM v
  JOIN e ON v.scheme = e.scheme AND v.code = e.code AND v.valid_from <> e.valid_from
   AND v.valid_from < coalesce(e.valid_to, DATE '9999-12-31') AND e.valid_from < v.valid_to
  WHERE year(v.valid_from) > 1996""")
def version_overlap(spark: SparkSession, folder: str) -> DataFrame:
    versions = order_versions(spark, folder, 120)
    found = releases.overlapping_versions(versions.filter(F.year("valid_from") > 1996),
                                          versions.filter(F.year("valid_from") <= 1996))
    return found.select("code", "o_orderkey", "valid_from", "old_from")


@query("""SELECT check_name, violations = 0 AS passed, violations FROM (
  SELECT 'o_orderstatus' AS check_name,
         count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')) AS violations
  FROM orders UNION ALL
  SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority IS NULL OR o_orderpriority NOT IN
    ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) FROM orders)""")
def domain_gate(spark: SparkSession, folder: str) -> DataFrame:
    return gates.domain_report(star.table(spark, folder, "orders"), {
        "o_orderstatus": ["F", "O"],
        "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]})


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
  GROUP BY ALL HAVING count(*) > 1""")
def unique_gate(spark: SparkSession, folder: str) -> DataFrame:
    return gates.duplicates(star.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber, count(DISTINCT l_quantity) AS "values",
  count(*) AS sources FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_quantity) > 1""")
def cross_source_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    lines = star.table(spark, folder, "lineitem")
    return coverage.cross_source_conflicts(lines, ["l_orderkey", "l_linenumber"], "l_quantity")


@query("""SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END
    AS side
  FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a
  FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k
  WHERE a.k IS NULL OR b.k IS NULL""")
def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    orders = star.table(spark, folder, "orders")
    return gates.set_difference(orders.filter("o_orderstatus = 'F'"),
                                orders.filter("o_orderstatus = 'O'"), ["o_custkey"])


def _manifest_sql(name: str, row: str) -> str:
    return f"""SELECT '{name}' AS "table", count(*) AS rows, CAST(coalesce(sum(CAST(CAST(
      ('0x' || substr(sha256({row}), 1, 15)) AS BIGINT) AS HUGEINT)), 0) AS VARCHAR) AS content
      FROM {name}"""


@query(" UNION ALL ".join([
    _manifest_sql("labels", "concat('{\"doc_id\":', doc_id, ',\"quality\":', quality, "
                            "',\"toxic\":', toxic, '}')"),
    _manifest_sql("nation", "concat('{\"n_nationkey\":', n_nationkey, ',\"n_name\":\"', n_name, "
                            "'\",\"n_regionkey\":', n_regionkey, '}')"),
    _manifest_sql("region", "concat('{\"r_regionkey\":', r_regionkey, ',\"r_name\":\"', r_name, "
                            "'\"}')"),
]))
def table_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return releases.table_manifest(
        {n: star.table(spark, folder, n) for n in ("labels", "nation", "region")})


@query()
def text_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts are hashed; JSON escaping differs between engines, so there is no SQL."""
    return releases.table_manifest(
        {n: star.table(spark, folder, n) for n in ("documents", "pages", "conversations")})


@query()
def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    return file_inventory(spark, folder, "*.parquet").withColumn(
        "path", F.element_at(F.split("path", "/"), -1))


@query("""SELECT c_custkey, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4),
    substr(h, 17, 4), substr(h, 21, 12)) AS id
  FROM (SELECT c_custkey, sha256(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), c_name)) AS h
        FROM customer)""")
def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    return star.table(spark, folder, "customer").select(
        "c_custkey", content_id(F.col("c_custkey"), F.col("c_name")).alias("id"))
