"""Territory boundaries: measures, coverage, parent outlines and map roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginloom.functions import polygons as P


def measures(boundaries: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    g = F.col(geometry)
    box = P.bounds(g)
    return boundaries.select(
        key, P.vertex_count(g).alias("vertices"), F.size(P.rings(g)).alias("rings"),
        P.area(g).alias("area"), box["xmin"].alias("xmin"), box["ymin"].alias("ymin"),
        box["xmax"].alias("xmax"), box["ymax"].alias("ymax"),
        P.well_formed(g).alias("well_formed"),
        (P.vertex_count(g) <= P.VERTEX_BUDGET).alias("within_budget"))


def coverage_violations(territories: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Every territory but the country has one boundary, and every boundary a territory."""
    places = territories.select("key", "level")
    shapes = boundaries.groupBy("key").agg(F.count(F.lit(1)).alias("shapes"))
    country = F.col("level") == "country"
    bad = (
        F.col("level").isNull() | (~country & F.coalesce(F.col("shapes") != 1, F.lit(True)))
        | (country & F.col("shapes").isNotNull()))
    return places.join(shapes, "key", "full").filter(bad)


def edges(boundaries: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """One row per boundary segment with a direction-free identity (ax, ay) <= (bx, by)."""
    rings = boundaries.select(*keys, F.explode(P.rings(F.col(geometry))).alias("_ring"))
    segments = rings.select(*keys, F.explode(P.segments(F.col("_ring"))).alias("_s"))
    low = F.least(F.col("_s.a"), F.col("_s.b"))
    high = F.greatest(F.col("_s.a"), F.col("_s.b"))
    forward = F.when(F.col("_s.a") == low, 1).otherwise(-1)
    return segments.select(*keys, low["x"].alias("ax"), low["y"].alias("ay"),
                           high["x"].alias("bx"), high["y"].alias("by"),
                           forward.alias("direction"))


def outline_edges(children: DataFrame, parent: str, geometry: str = "geometry") -> DataFrame:
    """Edges of a parent: those that belong to exactly one child.

    Valid for children that share vertices (a coverage). Grouping by the edge keeps the work
    spread however many children one parent has.
    """
    found = edges(children, [parent], geometry)
    return found.groupBy(parent, "ax", "ay", "bx", "by").agg(
        F.count(F.lit(1)).alias("uses"), F.sum("direction").alias("direction")
    ).filter("uses = 1").drop("uses")


def outline_measures(outline: DataFrame, parent: str) -> DataFrame:
    """Edge count, length, enclosed area and bounds of each parent outline."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    turn = F.col("direction") * (F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))
    return outline.groupBy(parent).agg(
        F.count(F.lit(1)).alias("edges"), F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"),
        (F.abs(F.sum(turn)) / 2).alias("area"),
        F.least(F.min("ax"), F.min("bx")).alias("xmin"),
        F.least(F.min("ay"), F.min("by")).alias("ymin"),
        F.greatest(F.max("ax"), F.max("bx")).alias("xmax"),
        F.greatest(F.max("ay"), F.max("by")).alias("ymax"))


def parent_area_difference(children: DataFrame, parents: DataFrame, parent: str,
                           geometry: str = "geometry") -> DataFrame:
    """Relative difference between a parent's area and the sum of its children."""
    summed = children.groupBy(parent).agg(F.sum(P.area(F.col(geometry))).alias("children_area"))
    own = parents.select(F.col("key").alias(parent), P.area(F.col(geometry)).alias("parent_area"))
    return own.join(summed, parent).withColumn("relative_difference", P.relative_difference(
        F.col("children_area"), F.col("parent_area")))


def display_boundaries(boundaries: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Every shape, rounded, as compact GeoJSON; `measures` tells which exceed the budget."""
    return boundaries.withColumn(geometry, P.to_geojson(P.rounded(F.col(geometry))))


def flag_boundaries(territories: DataFrame, boundaries: DataFrame,
                    keys: tuple[str, ...] = ("release_id", "territory_id")) -> DataFrame:
    """`has_boundary` is computed before the write; a stored table is never updated."""
    known = boundaries.select(*keys).distinct().withColumn("_has", F.lit(True))
    return territories.drop("has_boundary").join(known, list(keys), "left").withColumn(
        "has_boundary", F.coalesce("_has", F.lit(False))).drop("_has")


def reproject(vertices: DataFrame, easting: str, northing: str,
              meridian: float = P.UTM32_MERIDIAN) -> DataFrame:
    point = P.utm_to_lonlat(F.col(easting), F.col(northing), meridian)
    return vertices.withColumn("_p", point).select(
        *vertices.columns, F.col("_p.x").alias("longitude"), F.col("_p.y").alias("latitude"))


def reproject_geometry(boundaries: DataFrame, geometry: str = "geometry",
                       meridian: float = P.UTM32_MERIDIAN) -> DataFrame:
    moved = F.transform(F.col(geometry), lambda poly: F.transform(poly, lambda ring: F.transform(
        ring, lambda p: P.utm_to_lonlat(p["x"], p["y"], meridian))))
    return boundaries.withColumn(geometry, moved)


def roll_up(places: DataFrame, level: str) -> DataFrame:
    """Municipalities to provinces or regions: totals and the marker position.

    The marker sits on the member nearest to the population-weighted centre (first code on ties);
    members without coordinates count in the totals only.
    """
    code = {"region": "region_code", "province": "province_code"}[level]
    weight = F.greatest(F.lit(1), F.col("persons"))
    located = F.col("longitude").isNotNull() & F.col("latitude").isNotNull()

    def mean(column: str) -> F.Column:
        return F.sum(F.when(located, F.col(column) * weight)) / F.sum(F.when(located, weight))

    totals = places.groupBy(F.col(code).alias("territory")).agg(
        F.sum("persons").cast("long").alias("persons"),
        F.sum("households").cast("long").alias("households"),
        mean("longitude").alias("_x"), mean("latitude").alias("_y"))
    members = places.filter(located).select(F.col(code).alias("territory"), F.col("code"),
                                            "longitude", "latitude")
    dx, dy = F.col("longitude") - F.col("_x"), F.col("latitude") - F.col("_y")
    nearest = members.join(totals.select("territory", "_x", "_y"), "territory").groupBy(
        "territory").agg(F.min_by(
            F.struct("code", "longitude", "latitude"),
            F.struct(F.sqrt(dx * dx + dy * dy), F.col("code"))).alias("_a"))
    return totals.join(nearest, "territory", "left").select(
        F.col("territory").alias("code"), F.lit(level).alias("level"), "persons", "households",
        F.col("_a.code").alias("anchor_code"), F.col("_a.longitude").alias("longitude"),
        F.col("_a.latitude").alias("latitude"))
