"""Geometry as Column expressions: distances in km and planar degrees, rings, WKT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.config import EARTH_KM


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def planar_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.sqrt(F.pow(lon1 - lon2, 2) + F.pow(lat1 - lat2, 2))


def approx_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Planar degrees times 111, without a latitude correction."""
    return planar_deg(lon1, lat1, lon2, lat2) * 111.0


def along(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Share of the way along a segment at which it comes nearest in the plane; 0 for a point."""
    d2 = F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2)
    t = ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / d2
    return F.when(d2 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))


def segment_distance(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """(planar degrees, great-circle km) from a point to a segment's nearest point in the plane."""
    t = along(lon, lat, x1, y1, x2, y2)
    px, py = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
    return planar_deg(lon, lat, px, py), haversine_km(lon, lat, px, py)


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring: array<struct<lon,lat>>, closed or not. NULL ring is outside."""
    n = F.size(ring)

    def crosses(k: Column) -> Column:
        a, b = F.element_at(ring, k), F.element_at(ring, F.when(k == n, 1).otherwise(k + 1).cast("int"))
        ay, by = a["lat"], b["lat"]
        x = a["lon"] + (lat - ay) / F.when(by == ay, None).otherwise(by - ay) * (b["lon"] - a["lon"])
        return F.when(((ay > lat) != (by > lat)) & (lon < x), 1).otherwise(0)

    count = F.aggregate(F.transform(F.sequence(F.lit(1), n), crosses), F.lit(0), lambda s, v: s + v)
    return F.when(ring.isNull() | (n < 3), False).otherwise(count % 2 == 1)


def _points(body: Column) -> Column:
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.transform(
        F.split(body, ","),
        lambda p: F.struct(F.get(pair(p), F.lit(0)).try_cast("double").alias("lon"), F.get(pair(p), F.lit(1)).try_cast("double").alias("lat")),
    )


def wkt_points(wkt: Column) -> Column:
    """Points of a POINT, LINESTRING or one-ring POLYGON; NULL for other text."""
    body = F.regexp_extract(wkt, r"(?i)^\s*(?:POINT|LINESTRING|POLYGON)\s*\(+([^()]+)\)+\s*$", 1)
    return F.when(body != "", _points(body))


def to_wkt(points: Column, kind: str = "LINESTRING") -> Column:
    body = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", ")
    return F.concat(F.lit(f"{kind} (("), body, F.lit("))")) if kind == "POLYGON" else F.concat(F.lit(f"{kind} ("), body, F.lit(")"))


def closed(points: Column) -> Column:
    """The ring, closed if it was open."""
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return F.when(first == last, points).otherwise(F.concat(points, F.array(first)))


def square(lon: Column, lat: Column, side: float) -> Column:
    h = side / 2
    corner = lambda dx, dy: F.struct((lon + dx).alias("lon"), (lat + dy).alias("lat"))
    return F.array(corner(-h, -h), corner(h, -h), corner(h, h), corner(-h, h), corner(-h, -h))


def ring_centroid(points: Column) -> Column:
    """Area centroid of a ring by the shoelace sums; the mean of its points if it has no area."""
    ring, zero = closed(points), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, k: Column) -> Column:
        p, q = F.element_at(ring, k), F.element_at(ring, (k + 1).cast("int"))
        c = p["lon"] * q["lat"] - q["lon"] * p["lat"]
        return F.struct((s["a"] + c).alias("a"), (s["x"] + (p["lon"] + q["lon"]) * c).alias("x"), (s["y"] + (p["lat"] + q["lat"]) * c).alias("y"))

    s = F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), zero, add)
    n = F.size(points).cast("double")
    mean = lambda f: F.aggregate(points, F.lit(0.0), lambda t, p: t + p[f]) / n
    return F.struct(
        F.when(s["a"] == 0, mean("lon")).otherwise(s["x"] / (3 * s["a"])).alias("lon"),
        F.when(s["a"] == 0, mean("lat")).otherwise(s["y"] / (3 * s["a"])).alias("lat"),
    )
