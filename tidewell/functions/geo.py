"""Geometry by column arithmetic: distances, projection, grid cells, rings and segments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius in metres; some sources use 6,371,000.
EARTH_RADIUS = 6_371_008.8

# WGS84 and the transverse Mercator zone 17 north.
_A, _F, _K0, _E0, _LON0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, -81.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS) -> Column:
    """Great-circle distance in metres; null if a coordinate is."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), F.lit(2))
    return F.when(h.isNotNull(), 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def to_utm17(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres by the series of the transverse Mercator projection."""
    n = _F / (2 - _F)
    scale = _K0 * _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - _LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + scale * east, scale * north


def grid_cell(x: Column, y: Column, x0: float, y0: float, size: float, columns: int, rows: int) -> Column:
    """Row-major cell of a point, null outside the grid."""
    c, r = F.floor((x - x0) / size), F.floor((y - y0) / size)
    return F.when(c.between(0, columns - 1) & r.between(0, rows - 1), r * columns + c)


def cell_centre(cell: Column, x0: float, y0: float, size: float, columns: int) -> tuple[Column, Column]:
    return x0 + (F.pmod(cell, F.lit(columns)) + 0.5) * size, y0 + (F.floor(cell / columns) + 0.5) * size


def zone_id(lat: Column, lon: Column, step: float = 0.002) -> Column:
    """Name of the coordinate zone of `step` degrees."""
    return F.concat_ws(":", F.lit("zone"), F.floor(lat / step).cast("string"), F.floor(lon / step).cast("string"))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def point_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length)))
    return distance(px, py, x1 + t * dx, y1 + t * dy)


def line_length(points: Column) -> Column:
    """Length of an array of (x, y)."""
    pairs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: distance(a.x, a.y, b.x, b.y))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)


def ring_area(points: Column) -> Column:
    """Area of a closed ring of (x, y) by the shoelace sum."""
    pairs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: a.x * b.y - b.x * a.y)
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)) / 2


def point_in_ring(x: Column, y: Column, points: Column) -> Column:
    """Even-odd test of a point against a closed ring."""
    crossed = F.zip_with(
        F.slice(points, 1, F.size(points) - 1),
        F.slice(points, 2, F.size(points) - 1),
        lambda a, b: ((a.y > y) != (b.y > y)) & (x < (b.x - a.x) * (y - a.y) / F.when(b.y == a.y, 1.0).otherwise(b.y - a.y) + a.x),
    )
    return F.size(F.filter(crossed, lambda c: c)) % 2 == 1
