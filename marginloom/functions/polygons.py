"""Multipolygons as nested arrays (polygons of rings of points) and row-parallel arithmetic on them.

Built-in higher-order functions only. Overlay, repair and simplification are not expressible this
way and are not offered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
MULTIPOLYGON = f"array<array<array<{POINT}>>>"
VERTEX_BUDGET = 20_000
DISPLAY_DECIMALS = 5

# Fixed values of the WGS 84 / UTM zone 32N projection.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_EASTING = 500000.0
UTM32_MERIDIAN = 9.0


def points(geometry: Column) -> Column:
    return F.flatten(F.flatten(geometry))


def rings(geometry: Column) -> Column:
    return F.flatten(geometry)


def vertex_count(geometry: Column) -> Column:
    return F.size(points(geometry))


def bounds(geometry: Column) -> Column:
    xs = F.transform(points(geometry), lambda p: p["x"])
    ys = F.transform(points(geometry), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def within_box(geometry: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """An axis-aligned box contains a polygon exactly when it contains its vertices."""
    return F.forall(points(geometry), lambda p: p["x"].between(xmin, xmax)
                    & p["y"].between(ymin, ymax))


def well_formed(geometry: Column, max_x: float = 180.0, max_y: float = 85.0) -> Column:
    """Not empty, rings closed with four points or more, coordinates finite and in range."""
    def finite(v: Column, limit: float) -> Column:
        return ~F.isnan(v) & (F.abs(v) <= limit)

    closed = F.forall(rings(geometry), lambda r: (F.size(r) >= 4) & (
        F.element_at(r, 1) == F.element_at(r, -1)))
    in_range = F.forall(points(geometry), lambda p: finite(p["x"], max_x) & finite(p["y"], max_y))
    filled = (F.size(geometry) > 0) & F.forall(geometry, lambda poly: F.size(poly) > 0)
    return F.coalesce(filled & closed & in_range, F.lit(False))


def segments(ring: Column) -> Column:
    """Array of (a, b) for consecutive points of a closed ring."""
    size = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), size - 1), F.slice(ring, F.lit(2), size - 1),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_area(ring: Column) -> Column:
    """Signed planar area (shoelace), positive for counter-clockwise rings."""
    twice = F.aggregate(segments(ring), F.lit(0.0), lambda total, s: total
                        + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    return twice / 2


def area(geometry: Column) -> Column:
    """Outer rings minus holes, orientation ignored."""
    def polygon(rings_: Column) -> Column:
        sizes = F.transform(rings_, lambda r: F.abs(ring_area(r)))
        return 2 * F.element_at(sizes, 1) - F.aggregate(sizes, F.lit(0.0), lambda t, v: t + v)

    return F.aggregate(F.transform(geometry, polygon), F.lit(0.0), lambda t, v: t + v)


def relative_difference(measured: Column, expected: Column) -> Column:
    return F.abs(measured - expected) / F.nullif(expected, F.lit(0.0))


def rounded(geometry: Column, decimals: int = DISPLAY_DECIMALS) -> Column:
    return F.transform(geometry, lambda poly: F.transform(poly, lambda ring: F.transform(
        ring, lambda p: F.struct(F.round(p["x"], decimals).alias("x"),
                                 F.round(p["y"], decimals).alias("y")))))


def to_geojson(geometry: Column) -> Column:
    plain = F.transform(geometry, lambda poly: F.transform(poly, lambda ring: F.transform(
        ring, lambda p: F.array(p["x"], p["y"]))))
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), plain.alias("coordinates")))


def from_geojson(text: Column) -> Column:
    """Polygon or MultiPolygon text to nested arrays; NULL for anything else."""
    kind = F.get_json_object(text, "$.type")
    coordinates = F.get_json_object(text, "$.coordinates")
    deep = F.from_json(coordinates, "array<array<array<array<double>>>>")
    flat = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    plain = F.when(kind == "MultiPolygon", deep).when(kind == "Polygon", flat)
    return F.transform(plain, lambda poly: F.transform(poly, lambda ring: F.transform(
        ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))


def mercator(lon: Column, lat: Column, max_lat: float = 85.0) -> Column:
    """Unit-sphere web map coordinates, y growing southwards."""
    held = F.greatest(F.lit(-max_lat), F.least(F.lit(max_lat), lat))
    y = -F.log(F.tan(F.lit(math.pi / 4) + F.radians(held) / 2))
    return F.struct(F.radians(lon).alias("x"), y.alias("y"))


def population_radius(persons: Column, zoom: Column | float = 1.0) -> Column:
    """Marker radius: area proportional to persons, 100,000 persons = 6 px."""
    zoom = F.lit(zoom) if isinstance(zoom, (int, float)) else zoom
    people = F.greatest(F.lit(0), persons) / F.lit(100_000)
    return 6 * F.sqrt(people) * F.least(F.lit(1.6), F.sqrt(zoom))


def utm_to_lonlat(easting: Column, northing: Column,
                  meridian: float = UTM32_MERIDIAN) -> Column:
    """Inverse transverse Mercator (Krüger series to n^4), northern hemisphere, in degrees."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280)
    xi = northing / (UTM_SCALE * radius)
    eta = (easting - UTM_EASTING) / (UTM_SCALE * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    # Conformal to geodetic latitude by the inverse series of the same parameter.
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
             7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
             56 * n**3 / 15 - 136 * n**4 / 35,
             4279 * n**4 / 630)
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.struct((F.degrees(lam) + meridian).alias("x"), F.degrees(phi).alias("y"))
