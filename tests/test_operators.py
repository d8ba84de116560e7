import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from terravane.operators import governance, knn, ranking, upsert
from terravane.operators.components import connected_components


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(500, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert found == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _distance(p, q):
    """Planar distance of a point to a segment (x1, y1, x2, y2)."""
    dx, dy = q[2] - q[0], q[3] - q[1]
    d2 = dx * dx + dy * dy
    t = min(1, max(0, ((p[0] - q[0]) * dx + (p[1] - q[1]) * dy) / d2)) if d2 else 0
    return math.hypot(p[0] - q[0] - t * dx, p[1] - q[1] - t * dy)


@pytest.mark.parametrize(("bin_deg", "length"), [(None, 0.4), (0.05, 0.4), (0.5, 9.0), (3.0, 0.0)])
def test_nearest_matches_all_pairs(spark, bin_deg, length):
    rnd = random.Random(5)
    cells = [(i, rnd.uniform(-70, 90), rnd.uniform(-8, 30)) for i in range(80)]
    lines = []
    for i in range(50):
        x, y = rnd.choice([rnd.uniform(68, 72), rnd.uniform(-75, 95)]), rnd.uniform(-10, 35)
        lines.append((i, x, y, x + rnd.uniform(-length, length), y + rnd.choice([0, rnd.uniform(-length, length)]), i % 4 or None))
    df = spark.createDataFrame(cells, "cell_id long, lon double, lat double")
    targets = spark.createDataFrame(lines, "target_id long, x1 double, y1 double, x2 double, y2 double, grp int")
    want, two = {}, {}
    for c, *p in cells:
        order = sorted((round(_distance(p, q[1:5]), 9), q[0], q[5]) for q in lines)
        want[c] = order[0][0]
        two[c] = [order[0][0], next(d for d, _, g in order if g != order[0][2])]
    assert {r.cell_id: round(r.best.deg, 9) for r in knn.nearest(df, targets, bin_deg).collect()} == want
    found = {}
    for r in knn.nearest(df, targets, bin_deg, groups=True).collect():
        found.setdefault(r.cell_id, []).append(round(r.best.deg, 9))
    assert {k: sorted(v)[:2] for k, v in found.items()} == two
    assert knn.nearest(df, targets.limit(0)).count() == 0
    one_group = knn.nearest_two_groups(df, targets.withColumn("grp", F.lit(1))).collect()
    assert len(one_group) == len(cells) and all(r.other_id is None and r.other_km is None for r in one_group)


def test_within_epsilon_matches_all_pairs(spark):
    rnd = random.Random(6)
    rows = [(0, 0.0, 0.0, 5.0, 5.0)]  # a long diagonal is in bins along itself only
    for i in range(1, 60):
        x, y = rnd.uniform(0, 5), rnd.uniform(0, 5)
        rows.append((i, x, y, x + rnd.uniform(-0.1, 0.1), y + rnd.choice([0, rnd.uniform(-0.1, 0.1)])))
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def apart(p, q):
        a, b, c, d = p[1:3], p[3:5], q[1:3], q[3:5]
        if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
            return 0.0
        return min(_distance(a, q[1:]), _distance(b, q[1:]), _distance(c, p[1:]), _distance(d, p[1:]))

    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and apart(p, q) <= 0.15}
    got = knn.within_epsilon(spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double"), 0.15)
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 5


def test_contract_rejects(spark):
    rows = spark.createDataFrame([(1, "110", "x", 1, "LINESTRING (0 0, 1 1)"), (2, "400", "x", 1, "LINESTRING (0 0, 1 1)"), (3, "abc", None, None, None)], "osm_id long, voltage_kv string, operator string, circuits long, wkt string")
    clean, letters = governance.split(rows, governance.CONTRACTS["osm.power_lines"], "r1")
    assert [r.osm_id for r in clean.collect()] == [2]
    assert sorted(r.error for r in letters.collect()) == ["voltage_kv:low", "voltage_kv:type; wkt:null"]
    with pytest.raises(ValueError):
        governance.split(rows.drop("wkt"), governance.CONTRACTS["osm.power_lines"])
    paris = spark.createDataFrame([("Paris", 2000000, "FR", 2.35, 48.85)], "name string, population long, state_code string, lon double, lat double")
    assert governance.split(paris, governance.CONTRACTS["static.metros"])[0].count() == 0


def test_skip_guard(spark):
    now = dt.datetime(2024, 1, 2, 12)
    runs = spark.createDataFrame([("a", "x", 7, "success", dt.datetime(2024, 1, 2)), ("b", "y", 7, "failed", dt.datetime(2024, 1, 2))], "run_id string, source string, resolution int, status string, finished_at timestamp")
    assert governance.should_skip(runs, "x", 7, now) == "a"
    assert governance.should_skip(runs, "x", 6, now) is None and governance.should_skip(runs, "y", 7, now) is None
    assert governance.should_skip(runs, "x", 7, now, fresh=True) is None and governance.should_skip(runs, "x", 7, now, ttl_hours=1) is None
    rows = []
    with pytest.raises(KeyError), governance.ingestion_run("s", rows):
        raise KeyError("gone")
    assert rows[0]["status"] == "failed" and rows[0]["duration_s"] >= 0


def test_spacing_and_upserts(spark):
    rnd = random.Random(1)
    rows = [(i, "A" if i % 2 else "B", round(rnd.random(), 1), rnd.uniform(70, 74), rnd.uniform(10, 14)) for i in range(80)]
    df = spark.createDataFrame(rows, "cell_id long, state_code string, score double, lon double, lat double")
    top = ranking.spaced_top(df, 5, 100.0).collect()
    for a in top:
        for b in top:
            if a.state_code == b.state_code and a.rank < b.rank:
                assert ranking._km(a.lon, a.lat, b.lon, b.lat) >= 100 and a.score >= b.score
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in upsert.last_wins(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    kept = upsert.preserving(old.withColumn("w", F.lit(9)), new, ["k"])
    assert sorted(tuple(r) for r in kept.select("k", "v", F.coalesce("w", F.lit(0))).collect()) == [(1, "a", 9), (2, "c", 9), (3, "d", 0)]
