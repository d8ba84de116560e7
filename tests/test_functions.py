import math

import pytest
from pyspark.sql import functions as F

from terravane.functions import classify, geo, hexgrid
from terravane.functions import transforms as t


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(col.alias("v")).first().v


def test_transforms(spark):
    x = F.col("x")
    assert one(spark, t.exp_decay(x, 15), x=0.0) == 1
    assert one(spark, t.exp_decay(x, 15), x=15.0) == pytest.approx(math.exp(-1))
    assert one(spark, t.exp_decay(x, 15), x=math.nan) == 0
    assert one(spark, t.sigmoid(x, 1400, 200), x=1400.0) == 0.5
    assert [one(spark, t.linear_clamp(x, 18, 38, True), x=v) for v in (10.0, 28.0, 50.0)] == [1, 0.5, 0]
    single = one(spark, t.power_redundancy(x, F.col("y")), x=1.0, y=999.0)
    assert single == pytest.approx(0.6 * math.exp(-1 / 15), abs=1e-4)
    assert one(spark, t.power_redundancy(x, F.col("y")), x=1.0, y=1.0) > single


@pytest.mark.parametrize("name,kind", [("POWERGRID", "psu"), ("NTPC Ltd", "psu"), ("KPTCL", "state"), ("MahaTransco", "state"), (" Tata Power Company Ltd", "private"), ("Adani", "private"), ("", "unknown"), (None, "unknown"), ("Someone", "unknown")])
def test_operator_type(spark, name, kind):
    assert one(spark, classify.operator_type(F.col("n")), n=name) == kind


def test_company_tier_policy(spark):
    c = lambda n, o: one(spark, classify.company(F.col("n"), F.col("o")), n=n, o=o)
    assert c("AWS Mumbai", None) == "Amazon Web Services" and c(None, "Reliance Jio") == "Reliance Jio"
    assert c("Generic colo", None) is None and c("x", "Own Hall") == "Own Hall"
    tier = lambda n, g=None: one(spark, classify.tier(F.col("n"), F.col("g")), n=n, g=g)
    assert (tier("Tier-III Data Center"), tier("Tier 4 facility"), tier("x", "Tier-II"), tier("none"), tier("tier IV")) == (3, 4, 2, None, 4)
    p = lambda n: one(spark, classify.sez_policy(F.col("n")), n=n)
    assert (p("Data Center Park"), p("IT City"), p("Textile"), p(None)) == ("data_center_incentive", "it_services", "multi_product", None)
    v = lambda n: one(spark, classify.voltage_kv(F.col("n")), n=n)
    assert (v("132000;220000"), v("400 kV"), v("none")) == (220, 400, None)
    assert one(spark, classify.state_code(F.col("n")), n="TamilNadu") == "TN"


def test_hexgrid(spark):
    cell = hexgrid.cell_at(F.lit(73.8567), F.lit(18.5204), 6)
    row = spark.range(1).select(
        cell.alias("c"), hexgrid.boundary(cell, 6).alias("b"), hexgrid.disk(cell, 1, 6).alias("d"), hexgrid.children(cell, 6).alias("k"), hexgrid.from_text(hexgrid.to_text(cell)).alias("back"), hexgrid.resolution_of(cell).alias("r")
    ).first()
    assert len(row.b) == 7 and row.b[0] == row.b[6] and len(set(row.d)) == 7 and row.c in row.d
    assert row.back == row.c and row.r == 6 and 5 <= len(row.k) <= 9
    kids = spark.createDataFrame([(k,) for k in row.k], "k long").select(hexgrid.parent(F.col("k"), 7).alias("p")).distinct().collect()
    assert [x.p for x in kids] == [row.c]


def test_rings_and_wkt(spark):
    ring = "array(struct(0D as lon, 0D as lat), struct(4D as lon, 0D as lat), struct(4D as lon, 4D as lat), struct(0D as lon, 4D as lat))"
    inside = lambda x, y: one(spark, geo.in_ring(F.lit(x), F.lit(y), F.expr(ring)))
    assert inside(1.0, 1.0) and not inside(5.0, 1.0) and not inside(-1.0, 3.9)
    c = one(spark, geo.ring_centroid(F.expr(ring)))
    assert (c.lon, c.lat) == (2, 2)
    assert one(spark, geo.wkt_points(F.lit("LINESTRING (1 2, 3 4)")))[1].lat == 4 and one(spark, geo.wkt_points(F.lit("junk"))) is None
