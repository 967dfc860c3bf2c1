"""Boundaries and projections over shapes derived from the part and customer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.functions import polygons as P
from marginloom.plans import boundaries, star
from marginloom.registry import query


def square(x: Column, y: Column, side: Column) -> Column:
    """Closed counter-clockwise ring of a square."""
    def at(px: Column, py: Column) -> Column:
        return F.struct(px.cast("double").alias("x"), py.cast("double").alias("y"))

    return F.array(at(x, y), at(x + side, y), at(x + side, y + side), at(x, y + side), at(x, y))


def framed_parts(spark: SparkSession, folder: str) -> DataFrame:
    """A part as a square of its size with a square hole of half the side."""
    x, y, side = F.lit(0), F.lit(0), F.col("p_size")
    outer, hole = square(x, y, side), square(side / 4, side / 4, side / 2)
    return star.table(spark, folder, "part").select(
        F.col("p_partkey").alias("key"), F.array(F.array(outer, hole)).alias("geometry"))


@query("""SELECT p_partkey AS key, CAST(10 AS INTEGER) AS vertices, CAST(2 AS INTEGER) AS rings,
  CAST(p_size * p_size - (p_size / 2) * (p_size / 2) AS DOUBLE) AS area,
  CAST(0 AS DOUBLE) AS xmin, CAST(0 AS DOUBLE) AS ymin, CAST(p_size AS DOUBLE) AS xmax,
  CAST(p_size AS DOUBLE) AS ymax, true AS well_formed, true AS within_budget FROM part""")
def boundary_measures(spark: SparkSession, folder: str) -> DataFrame:
    return boundaries.measures(framed_parts(spark, folder), "key")


TILES = """WITH tiles AS (SELECT p_partkey // 1000 AS block, CAST(p_partkey % 100 AS DOUBLE) AS x,
    CAST(p_partkey // 100 AS DOUBLE) AS y FROM part),
  edges AS (
    SELECT block, x AS ax, y AS ay, x + 1 AS bx, y AS "by", 1 AS d FROM tiles UNION ALL
    SELECT block, x + 1, y, x + 1, y + 1, 1 FROM tiles UNION ALL
    SELECT block, x, y + 1, x + 1, y + 1, -1 FROM tiles UNION ALL
    SELECT block, x, y, x, y + 1, -1 FROM tiles),
  outline AS (SELECT block, ax, ay, bx, "by", CAST(sum(d) AS BIGINT) AS direction FROM edges
    GROUP BY ALL HAVING count(*) = 1)"""


def tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as unit squares on a grid of 100 columns; ten rows make a block."""
    key = F.col("p_partkey")
    ring = square(key % 100, F.floor(key / 100), F.lit(1))
    return star.table(spark, folder, "part").select(
        key.alias("key"), F.floor(key / 1000).alias("block"),
        F.array(F.array(ring)).alias("geometry"))


@query(TILES + " SELECT * FROM outline")
def boundary_dissolve_edges(spark: SparkSession, folder: str) -> DataFrame:
    return boundaries.outline_edges(tiles(spark, folder), "block")


@query(TILES + """ SELECT block, count(*) AS edges, CAST(count(*) AS DOUBLE) AS length, any_value(n)
    AS area, min(ax) AS xmin, min(ay) AS ymin, max(bx) AS xmax, max("by") AS ymax
  FROM outline JOIN (SELECT block, CAST(count(*) AS DOUBLE) AS n FROM tiles GROUP BY ALL)
  USING (block) GROUP BY ALL""")
def boundary_outlines(spark: SparkSession, folder: str) -> DataFrame:
    outline = boundaries.outline_edges(tiles(spark, folder), "block")
    return boundaries.outline_measures(outline, "block")


@query(TILES + """ SELECT block, CAST(1000 AS DOUBLE) AS parent_area,
    CAST(count(*) AS DOUBLE) AS children_area, round(abs(count(*) - 1000) / 1000, 9)
    AS relative_difference FROM tiles GROUP BY ALL""")
def boundary_area_difference(spark: SparkSession, folder: str) -> DataFrame:
    """A block is 100 x 10; the last one is not full unless the parts fill it."""
    children = tiles(spark, folder)
    def at(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    y0, y1 = F.col("block") * 10, F.col("block") * 10 + 10
    left, right = F.lit(0), F.lit(100)
    ring = F.array(at(left, y0), at(right, y0), at(right, y1), at(left, y1), at(left, y0))
    parents = children.select("block").distinct().select(
        F.col("block").alias("key"), F.array(F.array(ring)).alias("geometry"))
    found = boundaries.parent_area_difference(children, parents, "block")
    return found.withColumn("relative_difference", F.round("relative_difference", 9))


@query("""SELECT p_partkey AS key, concat('{"type":"MultiPolygon","coordinates":[[[',
    array_to_string(list_transform([[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]],
      lambda p: concat('[', CAST(round(p[1], 5) AS VARCHAR), ',', CAST(round(p[2], 5) AS VARCHAR), ']')),
      ','), ']]]}') AS geometry
  FROM (SELECT p_partkey, p_retailprice / 70 AS x, p_retailprice / 110 AS y,
               CAST(p_size AS DOUBLE) / 7 AS w FROM part)""")
def display_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("p_retailprice")
    ring = square(price / 70, price / 110, F.col("p_size") / 7)
    shapes = star.table(spark, folder, "part").select(
        F.col("p_partkey").alias("key"), F.array(F.array(ring)).alias("geometry"))
    return boundaries.display_boundaries(shapes)


@query("""SELECT p_partkey AS key, CAST(p_size * p_size - (p_size / 2) * (p_size / 2) AS DOUBLE)
  AS area FROM part""")
def geojson_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    shapes = framed_parts(spark, folder)
    back = P.from_geojson(P.to_geojson(F.col("geometry")))
    return shapes.select("key", P.area(back).alias("area"))


@query("""SELECT s_suppkey AS key, 'municipality' AS level FROM supplier WHERE s_acctbal < 1000""")
def boundary_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as territories; those with a low balance have no boundary."""
    supplier = star.table(spark, folder, "supplier")
    places = supplier.select(F.col("s_suppkey").alias("key"), F.lit("municipality").alias("level"))
    shapes = supplier.filter("s_acctbal >= 1000").select(F.col("s_suppkey").alias("key"))
    return boundaries.coverage_violations(places, shapes).drop("shapes")


def _inverse_sql() -> str:
    """The inverse projection written out for one row, from the same fixed values."""
    n = P.WGS84_F / (2 - P.WGS84_F)
    radius = P.WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
             7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
             56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    sinh, cosh = "(exp({0}) - exp(-({0}))) / 2", "(exp({0}) + exp(-({0}))) / 2"
    xi = "xi" + "".join(f" - ({b!r}::DOUBLE) * sin({2 * j} * xi) * {cosh.format(f'{2 * j} * eta')}"
                        for j, b in enumerate(beta, 1))
    eta = "eta" + "".join(f" - ({b!r}::DOUBLE) * cos({2 * j} * xi) * {sinh.format(f'{2 * j} * eta')}"
                          for j, b in enumerate(beta, 1))
    phi = "chi" + "".join(f" + ({d!r}::DOUBLE) * sin({2 * j} * chi)"
                          for j, d in enumerate(delta, 1))
    return f"""WITH v AS (SELECT c_custkey, 500000 + c_acctbal * 20 AS e,
      4000000 + c_custkey % 1000000 AS nn FROM customer),
    a AS (SELECT c_custkey, nn / ({P.UTM_SCALE * radius!r}::DOUBLE) AS xi,
      (e - 500000) / ({P.UTM_SCALE * radius!r}::DOUBLE) AS eta FROM v),
    b AS (SELECT c_custkey, {xi} AS xi1, {eta} AS eta1 FROM a),
    c AS (SELECT *, asin(sin(xi1) / ({cosh.format('eta1')})) AS chi FROM b)
    SELECT c_custkey, round(degrees(atan2({sinh.format('eta1')}, cos(xi1))) + 9, 6) AS longitude,
      round(degrees({phi}), 6) AS latitude FROM c"""


@query(_inverse_sql())
def reproject_vertices(spark: SparkSession, folder: str) -> DataFrame:
    vertices = star.table(spark, folder, "customer").select(
        "c_custkey", (F.lit(500000) + F.col("c_acctbal") * 20).alias("e"),
        (F.lit(4000000) + F.col("c_custkey") % 1000000).alias("n"))
    return boundaries.reproject(vertices, "e", "n").select(
        "c_custkey", F.round("longitude", 6).alias("longitude"),
        F.round("latitude", 6).alias("latitude"))


@query("""SELECT c_custkey, round(radians(c_acctbal / 100), 9) AS x,
  round(-ln(tan(pi() / 4 + radians(greatest(-85, least(85, c_acctbal / 50))) / 2)), 9) AS y,
  round(6 * sqrt(greatest(0, c_acctbal) / 100000) * least(1.6, sqrt(2)), 9) AS radius
  FROM customer""")
def map_points(spark: SparkSession, folder: str) -> DataFrame:
    balance = F.col("c_acctbal")
    point = P.mercator(balance / 100, balance / 50)
    return star.table(spark, folder, "customer").select(
        "c_custkey", F.round(point["x"], 9).alias("x"), F.round(point["y"], 9).alias("y"),
        F.round(P.population_radius(balance, 2.0), 9).alias("radius"))
