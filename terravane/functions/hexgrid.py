"""A hexagonal cell grid over lon/lat with 64-bit ids; an own lattice, not bit-compatible with H3.

An id holds resolution (4 bits), and the axial coordinates q and r (28 bits each, biased). Cells are
pointy-top hexagons whose size shrinks by sqrt(7) a resolution. A cell's parent is the coarser cell that
holds its centre, so parent and children agree by construction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIAS = 1 << 27
SQRT3 = math.sqrt(3)


def size_deg(resolution: int) -> float:
    """Centre-to-corner length in degrees."""
    return 10.0 / 7 ** (resolution / 2)


def _pack(resolution: int, q: Column, r: Column) -> Column:
    return F.lit(resolution).cast("long") * (1 << 56) + (q + BIAS) * (1 << 28) + (r + BIAS)


def resolution_of(cell: Column) -> Column:
    return F.shiftright(cell, 56).cast("int")


def axial(cell: Column) -> tuple[Column, Column]:
    mask = (1 << 28) - 1
    return F.shiftright(cell, 28).bitwiseAND(F.lit(mask)) - BIAS, cell.bitwiseAND(F.lit(mask)) - BIAS


def cell_at(lon: Column, lat: Column, resolution: int) -> Column:
    s = size_deg(resolution)

    def rounded(a: Column) -> Column:
        q, r = a["q"], a["r"]
        x, z = F.round(q), F.round(r)
        y = F.round(-q - r)
        dx, dy, dz = F.abs(x - q), F.abs(y + q + r), F.abs(z - r)
        qx = F.when((dx > dy) & (dx > dz), -y - z).otherwise(x)
        rz = F.when((dx > dy) & (dx > dz), z).when(dy > dz, z).otherwise(-x - y)
        return _pack(resolution, qx.cast("long"), rz.cast("long"))

    axes = F.struct(((SQRT3 / 3 * lon - lat / 3) / s).alias("q"), ((2 / 3 * lat) / s).alias("r"))
    return F.transform(F.array(axes), rounded)[0]  # a lambda variable, so that the axes stand in the plan once


def center(cell: Column, resolution: int) -> Column:
    s = size_deg(resolution)
    q, r = axial(cell)
    return F.struct((s * (SQRT3 * q + SQRT3 / 2 * r)).alias("lon"), (s * 1.5 * r).alias("lat"))


def parent(cell: Column, resolution: int) -> Column:
    """The cell one resolution coarser; ``resolution`` is the child's."""
    c = center(cell, resolution)
    return cell_at(c["lon"], c["lat"], resolution - 1)


def disk(cell: Column, k: int, resolution: int) -> Column:
    """All cells within k steps, the cell itself included."""
    q, r = axial(cell)
    steps = [(a, b) for a in range(-k, k + 1) for b in range(max(-k, -a - k), min(k, -a + k) + 1)]
    return F.array(*(_pack(resolution, q + a, r + b) for a, b in steps))


def children(cell: Column, resolution: int) -> Column:
    """Cells one resolution finer whose parent is ``cell``; ``resolution`` is the parent's."""
    # bound as lambda variables, so that the long expressions stand in the plan once
    bind = lambda value, use: F.transform(F.array(value), use)[0]
    near = bind(center(cell, resolution), lambda c: cell_at(c["lon"], c["lat"], resolution + 1))
    return bind(near, lambda n: F.filter(disk(n, 3, resolution + 1), lambda x: parent(x, resolution + 1) == cell))


def boundary(cell: Column, resolution: int) -> Column:
    """Seven corners, the first repeated."""
    s, c = size_deg(resolution), center(cell, resolution)
    turn = [math.radians(60 * k + 30) for k in (*range(6), 0)]
    return F.array(*(F.struct((c["lon"] + s * math.cos(t)).alias("lon"), (c["lat"] + s * math.sin(t)).alias("lat")) for t in turn))


def area_km2(cell: Column, resolution: int) -> Column:
    return F.lit(1.5 * SQRT3 * size_deg(resolution) ** 2 * 111.195**2) * F.cos(F.radians(center(cell, resolution)["lat"]))


def to_text(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def from_text(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")


def cover(polygons: DataFrame, resolution: int, ring: str = "ring") -> DataFrame:
    """``polygons`` with one row per cell whose centre lies inside the ring; candidates come from the box."""
    from terravane.functions.geo import in_ring

    s = size_deg(resolution)
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    steps = lambda lo, hi, step: F.sequence(F.floor(lo / step) - 1, F.floor(hi / step) + 1)
    rows = polygons.withColumn("_r", F.explode(steps(F.array_min(lats), F.array_max(lats), 1.5 * s)))
    shift = SQRT3 / 2 * s * F.col("_r")
    rows = rows.withColumn("_q", F.explode(steps(F.array_min(lons) - shift, F.array_max(lons) - shift, SQRT3 * s)))
    rows = rows.withColumn("cell", _pack(resolution, F.col("_q"), F.col("_r"))).withColumn("_c", center(F.col("cell"), resolution))
    return rows.filter(in_ring(F.col("_c.lon"), F.col("_c.lat"), F.col(ring))).drop("_q", "_r", "_c")
