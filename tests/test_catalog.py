import math
from pathlib import Path

import duckdb
import pytest

from terravane import catalog

SF = "/root/testdata/sf0.001"
SAMPLE = ["dual_feed_distances", "nearest_infra_capped", "exclusion_mask", "score_default", "top_sites_diverse", "state_stats", "score_histogram", "contract_split_rejects", "outage_cells", "zonal_climate_rh", "upsert_preserving", "graph_nodes", "graph_edges", "contracts_all", "hexgrid_cover", "zones_meet_protected", "parallel_lines"]


def same(a, b):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    key = lambda rows: sorted(tuple(map(cell, r)) for r in rows)
    return key(a) == key(b)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert same([tuple(r) for r in df.select(*names).collect()], want)


def test_overpass(spark, tmp_path):
    import json

    from terravane.sources import vector

    ring = [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}, {"lat": 0, "lon": 0}]
    elements = [
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "AWS hall tier 3"}},
        {"type": "way", "id": 2, "geometry": ring[:2], "tags": {"voltage": "220000", "highway": "trunk"}},
        {"type": "way", "id": 3, "geometry": ring, "tags": {"water": "pond", "name": "Data Centre Park"}},
        {"type": "way", "id": 4, "geometry": ring[:1]},
        {"type": "relation", "id": 5, "center": {"lat": 5, "lon": 6}, "tags": {}},
    ]
    (tmp_path / "o.json").write_text(json.dumps({"elements": elements}))
    e = vector.overpass(spark, str(tmp_path / "o.json"))
    ids = lambda df: sorted(r.osm_id for r in df.collect())
    assert ids(vector.ways_to_lines(e)) == [2, 3] and ids(vector.nodes_to_points(e)) == [1]
    assert ids(vector.power_lines(e)) == [2] and ids(vector.highways(e)) == [2] and ids(vector.water(e)) == [2, 3, 5]
    zones = {r.osm_id: r for r in vector.zones(e).collect()}
    assert zones[3].policy_tag == "data_center_incentive" and abs(zones[5].centroid.lon - 6) < 1e-9
    assert vector.data_centers(e).first().tier == 3
