"""Points on the edges and corners of areas."""

import duckdb
import pytest
from pyspark.sql import functions as F

from terravane import catalog
from terravane.operators import spatial
from terravane.plans.views import with_views
from tests.test_catalog import SF, same
from tests.test_spatial import RINGS, _rings

# keys whose cells lie on an edge of a protected area
ON_EDGE = [8500, 10000, 11500, 36500]
# cells of keys so far apart have one position
PERIOD = 1_829_000


@pytest.mark.parametrize("name", ["state_stamp_pip", "exclusion_mask", "exclusion_reasons_exploded", "stamp_with_holes"])
def test_cells_on_an_edge_against_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("region", "nation"):
        con.execute(f"copy (from '{SF}/{t}.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
    keys = ", ".join(f"({k})" for k in [*ON_EDGE, *range(1, 400)])
    con.execute(f"copy (select cast(k as bigint) as c_custkey, cast(k % 25 as integer) as c_nationkey from (values {keys}) v(k)) to '{tmp_path}/customer.parquet' (format parquet)")
    for t in ("region", "nation", "customer"):
        con.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert want and same([tuple(r) for r in df.select(*names).collect()], want)


@pytest.mark.parametrize("border", [True, False])
def test_points_on_an_edge_count_as_asked(spark, border):
    areas = spark.createDataFrame([(1, _rings([(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)])), (2, _rings([(4, 0), (8, 0), (8, 4), (4, 4)]))], f"code int, rings {RINGS}")
    edge = [(0.0, 2.0), (4.0, 2.0), (2.0, 0.0), (2.0, 4.0), (0.0, 0.0), (4.0, 4.0), (1.0, 1.5), (2.0, 2.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate([*edge, (3.0, 3.0), (1.5, 1.5), (9.0, 2.0)])], "id int, lon double, lat double")
    inner, both = {(8, 1)}, {(1, 2), (5, 2)}
    want = inner | both | {(i, 1) for i in range(len(edge))} if border else inner
    assert {(r.id, r.code) for r in spatial.points_in(points, areas, border=border).collect()} == want
    stamped = spatial.stamp(points.withColumn("code", F.lit(None).cast("int")), areas, "id", "code", border=border).filter("code is not null").collect()
    assert {(r.id, r.code) for r in stamped} == want - both


@pytest.mark.parametrize("name", ["exclusion_mask", "exclusion_reasons_exploded"])
def test_every_cell_on_an_edge_against_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("region", "nation"):
        con.execute(f"copy (from '{SF}/{t}.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    con.execute(f"create table customer as select range as c_custkey, cast(range % 25 as integer) as c_nationkey from range({PERIOD})")
    edges = with_views("SELECT cell_id FROM cells JOIN protected ON lon BETWEEN x_lo AND x_hi AND lat BETWEEN y_lo AND y_hi AND (lon IN (x_lo, x_hi) OR lat IN (y_lo, y_hi))")
    con.execute(f"delete from customer where c_custkey not in ({edges})")
    assert con.execute("select count(*) from customer").fetchone() == (100,)
    con.execute(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*names).collect()]
    assert want and same(got, want) and not any("protected_area" in str(r) for r in got)
