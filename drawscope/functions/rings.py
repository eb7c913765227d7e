"""Geometry as nested arrays, in built-in functions.

A point is ``struct<x,y>``, a ring an array of points (first = last), a polygon an array of
rings (the first is the shell, the others are holes), a shape an array of polygons.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
POLYGON = f"array<{RING}>"
SHAPE = f"array<{POLYGON}>"


def point_of(text: Column) -> Column:
    """``"lat lon"`` as (x = lon, y = lat), null if it isn't two numbers (FN5)."""
    p = F.split(F.trim(text), r"\s+")
    x, y = F.try_element_at(p, F.lit(2)).try_cast("double"), F.try_element_at(p, F.lit(1)).try_cast("double")
    return F.when((F.size(p) == 2) & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def vertices_of(text: Column) -> Column:
    """``"lat lon,lat lon,…"``; tokens that are no point are skipped (FN6)."""
    return F.filter(F.transform(F.split(text, ","), point_of), lambda p: p.isNotNull())


def closed(ring: Column) -> Column:
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def ring_of(text: Column) -> Column:
    """A closed ring, null for under three vertices (GEO1)."""
    v = vertices_of(text)
    return F.when(F.size(v) >= 3, closed(v))


def shape_of(ring: Column) -> Column:
    return F.array(F.array(ring))


def _over_edges(ring: Column, term) -> Column:
    """Sum of ``term(a, b)`` over the ring's edges."""
    return F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda s, i: s + term(F.element_at(ring, i), F.element_at(ring, i + 1)))


def signed_area(ring: Column) -> Column:
    return F.when(F.size(ring) < 4, 0.0).otherwise(_over_edges(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2.0)


def ring_length(ring: Column) -> Column:
    return F.when(F.size(ring) < 2, 0.0).otherwise(_over_edges(ring, lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))))


def area(shape: Column) -> Column:
    """Shells less holes (GEO5)."""
    of = lambda polygon: F.aggregate(F.transform(polygon, lambda r, i: F.when(i == 0, F.abs(signed_area(r))).otherwise(-F.abs(signed_area(r)))), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.transform(shape, of), F.lit(0.0), lambda s, x: s + x)


def exterior_length(shape: Column) -> Column:
    return F.aggregate(F.transform(shape, lambda p: ring_length(F.element_at(p, 1))), F.lit(0.0), lambda s, x: s + x)


def n_parts(shape: Column) -> Column:
    return F.size(shape)


def n_holes(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(0), lambda s, p: s + F.size(p) - 1)


def polsby_popper(a: Column, perimeter: Column) -> Column:
    """4 pi A / P^2; null where it means nothing (FN9)."""
    return F.when((a > 0) & (perimeter > 0), 4.0 * math.pi * a / (perimeter * perimeter))


def centroid(ring: Column) -> Column:
    """Area centroid of a ring; the mean vertex of one without area (GEO14)."""
    a = signed_area(ring)
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    x = _over_edges(ring, lambda p, q: (p["x"] + q["x"]) * cross(p, q)) / (6.0 * a)
    y = _over_edges(ring, lambda p, q: (p["y"] + q["y"]) * cross(p, q)) / (6.0 * a)
    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[f]) / F.size(ring)
    return F.when(a != 0, F.struct(x.alias("x"), y.alias("y"))).otherwise(F.struct(mean("x").alias("x"), mean("y").alias("y")))


def bounds(shape: Column) -> Column:
    xs = F.transform(F.flatten(F.flatten(shape)), lambda p: p["x"])
    ys = F.transform(F.flatten(F.flatten(shape)), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


# WGS 84 ellipsoid, UTM scale and false easting, sixth-order Krueger series in n.
_A, _F_INV, _K0, _E0 = 6378137.0, 298.257223563, 0.9996, 500000.0
_N = (1 / _F_INV) / (2 - 1 / _F_INV)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def utm(p: Column, central_meridian: float = 15.0) -> Column:
    """Longitude and latitude (degrees) in metres, by default zone 33 north (GEO4)."""
    lat, lon = F.radians(p["y"]), F.radians(p["x"] - central_meridian)
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(lat)) - e * F.atanh(e * F.sin(lat)))
    xi, eta = F.atan2(t, F.cos(lon)), F.atanh(F.sin(lon) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((_E0 + _K0 * _RADIUS * x).alias("x"), (_K0 * _RADIUS * y).alias("y"))


def lonlat(p: Column, central_meridian: float = 15.0) -> Column:
    """The way back from ``utm``: metres in longitude and latitude (degrees), within 1e-9 degrees (GEO4)."""
    # Each step's values are bound once, so the expression doesn't grow with every use of them.
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    scaled = F.struct((p["y"] / (_K0 * _RADIUS)).alias("xi"), ((p["x"] - _E0) / (_K0 * _RADIUS)).alias("eta"))

    def sphere(q: Column) -> Column:
        a, b = q["xi"], q["eta"]
        for j, c in enumerate(_BETA, 1):
            a = a - c * F.sin(2 * j * q["xi"]) * F.cosh(2 * j * q["eta"])
            b = b - c * F.cos(2 * j * q["xi"]) * F.sinh(2 * j * q["eta"])
        return F.struct(a.alias("a"), b.alias("b"))

    def degrees(w: Column) -> Column:
        lon = F.degrees(F.atan2(F.sinh(w["b"]), F.cos(w["a"]))) + central_meridian
        lat = bound(F.asin(F.sin(w["a"]) / F.cosh(w["b"])), lambda chi: sum((c * F.sin(2 * j * chi) for j, c in enumerate(_DELTA, 1)), chi))
        return F.struct(lon.alias("x"), F.degrees(lat).alias("y"))

    return bound(scaled, lambda q: bound(sphere(q), degrees))


def web_mercator(p: Column) -> Column:
    return F.struct((F.radians(p["x"]) * _A).alias("x"), (F.log(F.tan(math.pi / 4 + F.radians(p["y"]) / 2)) * _A).alias("y"))


def projected(shape: Column, by=utm) -> Column:
    return F.transform(shape, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, by)))


def hexagon_area(radius: Column) -> Column:
    """From the circumradius (FN10)."""
    return F.lit(1.5 * math.sqrt(3)) * radius * radius


def hexagon_radius(a: Column) -> Column:
    return F.when(a > 0, F.sqrt(a * 2.0 / (3 * math.sqrt(3))))


def hexagon_cell_area(mean_area: Column, factor: float = 1.5, least: float = 10_000.0, most: float = 5_000_000.0, override: float | None = None, auto: bool = True) -> Column:
    """Area of a void's hexagons: the override or a multiple of the mean unit, within limits;
    null if neither says anything (FN11)."""
    if override is not None:
        return F.lit(max(least, min(override, most)) if override > 0 else None).cast("double")
    if not auto:
        return F.lit(None).cast("double")
    return F.when((mean_area > 0) & ~F.isnan(mean_area), F.greatest(F.lit(least), F.least(mean_area * factor, F.lit(most))))


def least_void_to_part(mean_area: Column, factor: float = 4.0, least: float = 10_000.0, override: float | None = None) -> Column:
    """Voids under this area stay whole."""
    if override is not None:
        return F.lit(override).cast("double")
    return F.when((mean_area > 0) & ~F.isnan(mean_area), F.greatest(F.lit(least), mean_area * factor)).otherwise(F.lit(least))


def hexagon(centre: Column, radius: Column) -> Column:
    """Vertices at 30 + 60 k degrees, closed (GEO10)."""
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.struct((centre["x"] + radius * F.cos(math.pi / 6 + (k % 6) * math.pi / 3)).alias("x"), (centre["y"] + radius * F.sin(math.pi / 6 + (k % 6) * math.pi / 3)).alias("y")))


def hexagon_centres(b: Column, radius: Column) -> Column:
    """Centres of a hexagon grid that covers the bounds ``b`` with a rim of two radii:
    rows 1.5 radii apart, every other one shifted by half a hexagon (GEO10)."""
    wide, high, pad = radius * math.sqrt(3), radius * 1.5, radius * 2.0
    rows = F.sequence(F.lit(0), F.floor((b["maxy"] - b["miny"] + 2.0 * pad) / high + 1e-9).cast("int"))

    def row(r: Column) -> Column:
        shift = F.when(r % 2 == 1, wide / 2.0).otherwise(F.lit(0.0))
        columns = F.sequence(F.lit(0), F.floor((b["maxx"] - b["minx"] + 2.0 * pad - shift) / wide + 1e-9).cast("int"))
        return F.transform(columns, lambda c: F.struct((b["minx"] - pad + shift + c * wide).alias("x"), (b["miny"] - pad + r * high).alias("y")))

    return F.flatten(F.transform(rows, row))
