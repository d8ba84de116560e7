"""Polygons with holes and parts as rings: array<array<struct<lon,lat>>>, by the even-odd rule over all rings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.functions.geo import _points, closed

POINT = "struct<lon:double,lat:double>"


def wkt_rings(wkt: Column) -> Column:
    """All rings of a POLYGON or MULTIPOLYGON, all lines of a MULTILINESTRING, all points of a MULTIPOINT as rings of one; NULL for other text."""
    body = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    known = wkt.rlike(r"(?i)^\s*(?:POLYGON|MULTIPOLYGON|MULTILINESTRING|LINESTRING|POINT)\s*\(")
    points = F.transform(F.flatten(F.transform(body, _points)), lambda p: F.array(p))
    many = wkt.rlike(r"(?i)^\s*MULTIPOINT\s*\(")
    return F.when(many, points).when(known & (F.size(body) > 0), F.transform(body, _points))


def rings_wkt(rings: Column) -> Column:
    """A POLYGON of the rings, the first the shell."""
    text = lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))
    one = lambda ring: F.concat(F.lit("("), F.array_join(F.transform(closed(ring), text), ", "), F.lit(")"))
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, one), ", "), F.lit(")"))


def _edges(rings: Column) -> Column:
    """Edges (a, b) of all rings, each closed."""
    def of(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(ring, lambda p, k: F.struct(p.alias("a"), F.element_at(ring, F.when(k + 1 == n, 1).otherwise(k + 2).cast("int")).alias("b")))

    return F.flatten(F.transform(rings, of))


def in_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Whether a point lies inside an odd number of rings; on an edge it may be either, see ``on_rings``. NULL rings hold nothing."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        x = a["lon"] + (lat - a["lat"]) / F.when(a["lat"] == b["lat"], None).otherwise(b["lat"] - a["lat"]) * (b["lon"] - a["lon"])
        return F.when(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < x), 1).otherwise(0)

    count = F.aggregate(F.transform(_edges(rings), crosses), F.lit(0), lambda s, v: s + v)
    return F.coalesce(count % 2 == 1, F.lit(False))


def on_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Whether a point lies on an edge of a ring, corners included. NULL rings hold nothing."""
    def holds(e: Column) -> Column:
        a, b = e["a"], e["b"]
        level = (b["lon"] - a["lon"]) * (lat - a["lat"]) == (b["lat"] - a["lat"]) * (lon - a["lon"])
        return level & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    return F.coalesce(F.exists(_edges(rings), holds), F.lit(False))


def box(rings: Column) -> Column:
    """(x_lo, y_lo, x_hi, y_hi) of all rings."""
    p = F.flatten(rings)
    lons, lats = F.transform(p, lambda q: q["lon"]), F.transform(p, lambda q: q["lat"])
    return F.struct(F.array_min(lons).alias("x_lo"), F.array_min(lats).alias("y_lo"), F.array_max(lons).alias("x_hi"), F.array_max(lats).alias("y_hi"))


def _touch(e: Column, f: Column) -> Column:
    """Whether two edges share a point, ends included."""
    def side(p, q, r):
        return F.signum((q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"]))

    def between(p, q, r):
        return r["lon"].between(F.least(p["lon"], q["lon"]), F.greatest(p["lon"], q["lon"])) & r["lat"].between(F.least(p["lat"], q["lat"]), F.greatest(p["lat"], q["lat"]))

    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    s1, s2, s3, s4 = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    on = ((s1 == 0) & between(a, b, c)) | ((s2 == 0) & between(a, b, d)) | ((s3 == 0) & between(c, d, a)) | ((s4 == 0) & between(c, d, b))
    return ((s1 * s2 < 0) & (s3 * s4 < 0)) | on


def rings_meet(a: Column, b: Column) -> Column:
    """Whether two polygons share a point: edges that touch, or one inside the other."""
    first = lambda r: F.element_at(F.element_at(r, 1), 1)
    inside = in_rings(first(a)["lon"], first(a)["lat"], b) | in_rings(first(b)["lon"], first(b)["lat"], a)
    edges = _edges(b)
    return F.coalesce(inside | F.exists(_edges(a), lambda e: F.exists(edges, lambda f: _touch(e, f))), F.lit(False))


def is_simple(ring: Column) -> Column:
    """Whether no two edges of a ring cross properly (a bow tie is not valid)."""
    edges = _edges(F.array(ring))

    def cross(e: Column, f: Column) -> Column:
        def side(p, q, r):
            return F.signum((q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"]))

        a, b, c, d = e["a"], e["b"], f["a"], f["b"]
        return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)

    return ~F.exists(edges, lambda e: F.exists(edges, lambda f: cross(e, f)))


def kept_points(xs: list[float], ys: list[float], tolerance: float) -> list[int]:
    """Places of a line's points that Douglas and Peucker's method keeps."""
    keep, stack = {0, len(xs) - 1}, [(0, len(xs) - 1)]
    while stack:
        a, b = stack.pop()
        dx, dy = xs[b] - xs[a], ys[b] - ys[a]
        d2, far, at = dx * dx + dy * dy, -1.0, -1
        for k in range(a + 1, b):
            t = min(1.0, max(0.0, ((xs[k] - xs[a]) * dx + (ys[k] - ys[a]) * dy) / d2)) if d2 else 0.0
            d = (xs[k] - xs[a] - t * dx) ** 2 + (ys[k] - ys[a] - t * dy) ** 2
            if d > far:
                far, at = d, k
        if at >= 0 and far > tolerance * tolerance:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return sorted(keep)


def simplify(path: Column, tolerance: float) -> Column:
    """A path of (lon, lat) without the points that lie within ``tolerance`` of what is left; lines of two points stay."""

    @F.pandas_udf("array<int>")
    def places(lons: pd.Series, lats: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kept_points(list(x), list(y), tolerance) if len(x) > 2 else list(range(len(x))) for x, y in zip(lons, lats)])

    at = places(F.transform(path, lambda p: p["lon"]), F.transform(path, lambda p: p["lat"]))
    return F.transform(at, lambda k: F.element_at(path, k + 1))
