"""Spatial joins on lattice bins (J04, J10, G05) and the union of polygons by code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions import polygons


def _box_bins(areas: DataFrame, size: float) -> DataFrame:
    """``areas`` with (bx, by) of every bin that their box touches."""
    b = F.col("_box")
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))
    rows = areas.withColumn("_box", polygons.box(F.col("rings"))).filter("_box.x_lo is not null")
    return rows.withColumn("bx", spread(b["x_lo"], b["x_hi"])).withColumn("by", spread(b["y_lo"], b["y_hi"]))


def points_in(points: DataFrame, areas: DataFrame, size: float = 0.5, border: bool = True) -> DataFrame:
    """``points`` (lon, lat, ...) with the columns of every area (rings, ...) that holds them; those on an edge only with ``border``."""
    at = points.withColumns({"bx": F.floor(F.col("lon") / size), "by": F.floor(F.col("lat") / size)})
    met = at.join(_box_bins(areas, size), ["bx", "by"])
    inside = F.col("lon").between(F.col("_box.x_lo"), F.col("_box.x_hi")) & F.col("lat").between(F.col("_box.y_lo"), F.col("_box.y_hi"))
    at = F.col("lon"), F.col("lat"), F.col("rings")
    met = met.filter(inside)
    met = met.filter(polygons.in_rings(*at) | polygons.on_rings(*at)) if border else met.filter(polygons.in_rings(*at) & ~polygons.on_rings(*at))
    return met.drop("bx", "by", "_box", "rings")


def stamp(points: DataFrame, areas: DataFrame, key: str, code: str, size: float = 0.5, border: bool = True) -> DataFrame:
    """``points`` with ``code`` filled where it is NULL from the area that holds them; of several the least code."""
    found = points_in(points.filter(F.col(code).isNull()).select(key, "lon", "lat"), areas.select(F.col(code).alias("_code"), "rings"), size, border)
    found = found.groupBy(key).agg(F.min("_code").alias("_code"))
    return points.join(found, key, "left").withColumn(code, F.coalesce(code, "_code")).drop("_code")


def meeting(left: DataFrame, right: DataFrame, size: float = 0.5) -> DataFrame:
    """(a, b) of polygons (a, rings) and (b, rings) that share a point; boxes meet on bins first."""
    x = _box_bins(left.select("a", "rings"), size).withColumnsRenamed({"rings": "ra", "_box": "xa"})
    y = _box_bins(right.select("b", "rings"), size).withColumnsRenamed({"rings": "rb", "_box": "xb"})
    met = x.join(y, ["bx", "by"])
    boxes = (F.col("xa.x_lo") <= F.col("xb.x_hi")) & (F.col("xb.x_lo") <= F.col("xa.x_hi")) & (F.col("xa.y_lo") <= F.col("xb.y_hi")) & (F.col("xb.y_lo") <= F.col("xa.y_hi"))
    # a pair meets in the bin of its common box's lower corner only
    corner = (F.floor(F.greatest("xa.x_lo", "xb.x_lo") / size) == F.col("bx")) & (F.floor(F.greatest("xa.y_lo", "xb.y_lo") / size) == F.col("by"))
    return met.filter(boxes & corner).filter(polygons.rings_meet(F.col("ra"), F.col("rb"))).select("a", "b")


def _rings_of(edges: set) -> list[list[tuple]]:
    """Directed edges chained to closed rings; at a point of several ways the least is taken first."""
    ways: dict = {}
    for a, b in sorted(edges, reverse=True):
        ways.setdefault(a, []).append(b)
    rings = []
    for start in sorted(ways):
        while ways[start]:
            ring, at = [start], ways[start].pop()
            while at != start:
                ring.append(at)
                at = ways[at].pop()
            rings.append(ring)
    return rings


def dissolve(areas: DataFrame, code: str = "state_code") -> DataFrame:
    """(code, rings): the union of the polygons of each code.

    Parts of one code that share an edge, vertex by vertex, lose it: an edge that is there in both directions is inside.
    Parts must not overlap otherwise, as in a map; shells run one way and holes the other, whatever the input's order.
    One task holds the edges of one code.
    """
    kind = areas.schema[code].dataType.simpleString()

    def union(part: pd.DataFrame) -> pd.DataFrame:
        edges: set = set()
        for rings in part["rings"]:
            for k, ring in enumerate(rings):
                p = [(q["lon"], q["lat"]) for q in ring]
                if len(p) > 1 and p[0] == p[-1]:
                    p.pop()
                turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]]))
                if (turn < 0) != (k > 0):
                    p.reverse()
                for e in zip(p, [*p[1:], p[0]]):
                    if e[::-1] in edges:
                        edges.remove(e[::-1])
                    else:
                        edges.add(e)
        rings = [[{"lon": x, "lat": y} for x, y in [*r, r[0]]] for r in _rings_of(edges)]
        return pd.DataFrame({code: [part[code].iloc[0]], "rings": [rings]})

    return areas.select(code, "rings").groupBy(code).applyInPandas(union, f"{code} {kind}, rings array<array<{polygons.POINT}>>")
