"""Great-circle and planar geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the sphere in km.
RADIUS_KM = 6371.0088


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance of two points given in degrees."""
    a = F.radians(lat2 - lat1) / 2
    b = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(a), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(b), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """The same distance as SQL text."""
    return (
        f"2 * {RADIUS_KM} * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) "
        f"* cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a triangle: positive where c lies left of a to b."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def crosses(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """Whether two segments (x1, y1, x2, y2) cross properly; segments that only touch from the positive side don't."""
    ax, ay, bx, by = p
    cx, cy, dx, dy = q
    d1, d2 = orientation(cx, cy, dx, dy, ax, ay), orientation(cx, cy, dx, dy, bx, by)
    d3, d4 = orientation(ax, ay, bx, by, cx, cy), orientation(ax, ay, bx, by, dx, dy)
    return ((d1 > 0) != (d2 > 0)) & ((d3 > 0) != (d4 > 0))


def in_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd test of a point against an array of rings of struct<x, y>; null rings hold nothing."""
    def crossings(ring: Column) -> Column:
        edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))
        hit = F.filter(edges, lambda e: ((e["p"]["y"] > lat) != (e["q"]["y"] > lat)) & (
            lon < (e["q"]["x"] - e["p"]["x"]) * (lat - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]))
        return F.size(hit)

    total = F.aggregate(F.transform(rings, crossings), F.lit(0), lambda a, n: a + n)
    return F.coalesce(total % 2 == 1, F.lit(False))
