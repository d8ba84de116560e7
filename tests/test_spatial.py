"""Polygons, H3 ids and spatial joins against brute force and known values."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from terravane.functions import geo, h3bits, hexgrid, polygons
from terravane.operators import spatial
from tests.test_functions import one

RINGS = f"array<array<{polygons.POINT}>>"


def _rings(*rings):
    return [[(float(x), float(y)) for x, y in r] for r in rings]


def _inside(x, y, rings):
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]]):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
    return odd


def test_h3_ids_of_known_cells(spark):
    ids = spark.createDataFrame([("8928308280fffff",), ("872830828ffffff",), ("85283083fffffff",)], "t string").withColumn("c", h3bits.from_text(F.col("t")))
    rows = {r.t: r for r in ids.select("t", "c", h3bits.resolution(F.col("c")).alias("r"), h3bits.base_cell(F.col("c")).alias("b"), h3bits.to_text(F.col("c")).alias("back"), h3bits.is_cell(F.col("c")).alias("ok"), h3bits.to_text(h3bits.parent(F.col("c"), 5)).alias("up")).collect()}
    assert {t: r.r for t, r in rows.items()} == {"8928308280fffff": 9, "872830828ffffff": 7, "85283083fffffff": 5}
    assert all(r.back == t and r.ok and r.b == 20 and r.up == "85283083fffffff" for t, r in rows.items())
    kids = ids.filter("t = '872830828ffffff'").select(F.explode(h3bits.children(F.col("c"), 7)).alias("k")).select(h3bits.to_text(F.col("k")).alias("k"), h3bits.to_text(h3bits.parent(F.col("k"), 7)).alias("p")).collect()
    assert len(kids) == 7 and {r.p for r in kids} == {"872830828ffffff"} and "8828308281fffff" in {r.k for r in kids}
    pentagon = spark.createDataFrame([("8009fffffffffff",)], "t string").withColumn("c", h3bits.from_text(F.col("t")))  # base cell 4
    row = pentagon.select(h3bits.is_pentagon(F.col("c")).alias("p"), F.size(h3bits.children(F.col("c"), 0)).alias("n"), h3bits.is_cell(F.col("c") + 1).alias("ok"), h3bits.parent(F.col("c"), 3).alias("up")).first()
    assert (row.p, row.n, row.ok, row.up) == (True, 6, False, None)


def test_points_in_polygons_with_holes_match_brute_force(spark):
    rnd = random.Random(4)
    areas = [(1, _rings([(0, 0), (6, 0), (6, 6), (0, 6)], [(1, 1), (3, 1), (3, 3), (1, 3)])), (2, _rings([(4, 4), (9, 5), (5, 9)], [(20, 20), (22, 20), (21, 23)])), (3, _rings([(-3, -3), (-1, -3), (-2, -1)]))]
    points = [(i, rnd.uniform(-4, 23), rnd.uniform(-4, 23)) for i in range(400)] + [(1000 + i, rnd.uniform(0, 7), rnd.uniform(0, 7)) for i in range(200)]
    df, at = spark.createDataFrame(areas, f"code int, rings {RINGS}"), spark.createDataFrame(points, "id int, lon double, lat double")
    want = {(i, c) for i, x, y in points for c, rings in areas if _inside(x, y, rings)}
    assert {(r.id, r.code) for r in spatial.points_in(at, df).collect()} == want and len(want) > 50
    stamped = spatial.stamp(at.withColumn("code", F.when(F.col("id") < 5, 9)), df, "id", "code").collect()
    assert {r.id: r.code for r in stamped} == {i: 9 if i < 5 else min((c for k, c in want if k == i), default=None) for i, *_ in points}


def test_polygons_that_meet_match_sampling(spark):
    square = lambda x, y, s: _rings([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])
    left = [(1, square(0, 0, 4)), (2, square(10, 10, 1)), (3, square(-5, 0, 5)), (4, _rings([(0, 0), (8, 0), (8, 8), (0, 8)], [(1, 1), (7, 1), (7, 7), (1, 7)]))]
    right = [(1, square(1, 1, 1)), (2, square(4, 4, 2)), (3, square(11.5, 10, 1)), (4, square(3, 3, 20)), (5, square(2, 2, 2)), (6, _rings([(-1, 2), (9, 2.1), (9, 2.2)]))]
    got = spatial.meeting(spark.createDataFrame(left, f"a int, rings {RINGS}"), spark.createDataFrame(right, f"b int, rings {RINGS}"))
    # 4 has a hole from 1 to 7: 5 lies in it without touching, 1 and 2 touch or lie in it
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, 1), (1, 2), (1, 4), (1, 5), (1, 6), (2, 4), (3, 6), (4, 1), (4, 4), (4, 6)]


def test_dissolve(spark):
    box = lambda x, y: [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
    ring_of_eight = [("A", _rings(box(x, y) if (x + y) % 2 else box(x, y)[::-1])) for x, y in itertools.product(range(3), range(3)) if (x, y) != (1, 1)]
    rows = [*ring_of_eight, ("B", _rings(box(9, 9))), ("B", _rings(box(20, 9), ))]
    found = {r.state_code: r.rings for r in spatial.dissolve(spark.createDataFrame(rows, f"state_code string, rings {RINGS}")).collect()}
    assert len(found["A"]) == 2 and len(found["B"]) == 2
    rings = [[(p.lon, p.lat) for p in r[:-1]] for r in found["A"]]
    assert sorted(map(len, rings)) == [4, 12] and not _inside(1.5, 1.5, rings) and all(_inside(x + 0.5, y + 0.5, rings) for x, y in itertools.product(range(3), range(3)) if (x, y) != (1, 1))
    assert all(r[0] == r[-1] for r in found["A"] + found["B"])


def test_simple_rings_and_simplification(spark):
    ring = lambda text: geo.wkt_points(F.lit(f"LINESTRING ({text})"))
    assert one(spark, polygons.is_simple(ring("0 0, 2 0, 2 2, 0 2"))) and not one(spark, polygons.is_simple(ring("0 0, 2 2, 2 0, 0 2")))
    rnd = random.Random(2)
    xs, ys = list(range(30)), [rnd.uniform(0, 1) for _ in range(30)]
    kept = polygons.kept_points(xs, ys, 0.3)
    assert kept[0] == 0 and kept[-1] == 29 and len(kept) < 30
    for a, b in zip(kept, kept[1:]):
        for k in range(a + 1, b):
            t = min(1, max(0, ((xs[k] - xs[a]) * (xs[b] - xs[a]) + (ys[k] - ys[a]) * (ys[b] - ys[a])) / ((xs[b] - xs[a]) ** 2 + (ys[b] - ys[a]) ** 2)))
            assert ((xs[k] - xs[a] - t * (xs[b] - xs[a])) ** 2 + (ys[k] - ys[a] - t * (ys[b] - ys[a])) ** 2) ** 0.5 <= 0.3
    path = one(spark, polygons.simplify(ring("0 0, 1 0.001, 2 0, 3 1"), 0.01))
    assert [(p.lon, p.lat) for p in path] == [(0, 0), (2, 0), (3, 1)]
    assert one(spark, polygons.wkt_rings(F.lit("GEOMETRYCOLLECTION EMPTY"))) is None
    many = one(spark, polygons.wkt_rings(F.lit("MULTIPOINT (1 2, 3 4)")))
    assert [(r[0].lon, r[0].lat) for r in many] == [(1, 2), (3, 4)]


@pytest.mark.parametrize("resolution", [2, 5])
def test_cover_is_every_centre_inside(spark, resolution):
    shape = spark.createDataFrame([(1, [(70.0, 10.0), (76.0, 11.0), (73.0, 15.0)])], f"id int, ring array<{polygons.POINT}>")
    found = hexgrid.cover(shape, resolution).select("cell", hexgrid.center(F.col("cell"), resolution).alias("c")).collect()
    assert found and len({r.cell for r in found}) == len(found) and all(_inside(r.c.lon, r.c.lat, _rings([(70, 10), (76, 11), (73, 15)])) for r in found)
    box = spark.range(40 * 40).select((F.lit(69.5) + F.col("id") % 40 * 0.18).alias("x"), (F.lit(9.5) + F.floor(F.col("id") / 40) * 0.15).alias("y"))
    hit = box.select(hexgrid.cell_at(F.col("x"), F.col("y"), resolution).alias("cell")).distinct().select("cell", hexgrid.center(F.col("cell"), resolution).alias("c")).collect()
    assert {r.cell for r in hit if _inside(r.c.lon, r.c.lat, _rings([(70, 10), (76, 11), (73, 15)]))} <= {r.cell for r in found}
