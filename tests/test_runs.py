"""Sources over HTTP, table writers, chunk runs, layer runs, phases, checks, projections and the command line."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from terravane import cli, config
from terravane.operators import governance, ranking, runs, upsert
from terravane.plans import projection, readapi
from terravane.sources import fetch, tables, vector
from terravane.streaming import incremental


def test_fetch_retries_and_caches(tmp_path):
    waits, calls = [], []

    def post(url, query, timeout):
        calls.append(query)
        if len(calls) < 4:
            raise OSError("busy")
        return b'{"elements": []}'

    query = fetch.fill("[timeout:{timeout}];{project}{kept}", timeout=9, project="p")
    assert query == "[timeout:9];p{kept}"
    path = fetch.fetch(query, "http://x", str(tmp_path), post=post, wait=waits.append)
    assert json.loads(path.read_text()) == {"elements": []} and waits == [5, 10, 20] and len(calls) == 4
    assert fetch.fetch(query, "http://x", str(tmp_path), post=post, wait=waits.append) == path and len(calls) == 4
    fetch.fetch(query, "http://x", str(tmp_path), use_cache=False, post=post)
    assert len(calls) == 5

    def broken(url, query, timeout):
        calls.append(query)
        return b"<html>"

    with pytest.raises(ValueError):
        fetch.fetch("other", "http://x", str(tmp_path), post=broken, wait=waits.append)
    assert len(calls) == 10 and len(list(tmp_path.iterdir())) == 1
    assert fetch.union(["way[a]", "node[b];"]) == "[out:json][timeout:180];(way[a];node[b];);out body geom;"


def test_table_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string, w int")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).collect())
    assert tables.truncate_and_load(rows((1, "a", 1), (2, "b", 2)), path) == 2
    tables.append_rows(rows((3, "c", 3)), path, rows_per_file=1)
    assert read() == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    # a table replaced by a frame that reads it
    assert tables.truncate_and_load(spark.read.parquet(path).filter("k > 1"), path) == 2
    assert tables.upsert_table(rows((3, "x", 1), (3, "y", 2), (4, "z", 4)), path, ["k"], "w") == 3
    assert read() == [(2, "b", 2), (3, "y", 2), (4, "z", 4)]
    assert tables.update_from(path, spark.createDataFrame([(2, None), (9, "no")], "k int, v string"), ["k"], ["v"]) == 3
    assert sorted((r.k, r.v or "", r.w) for r in spark.read.parquet(path).collect()) == [(2, "", 2), (3, "y", 2), (4, "z", 4)]
    tables.insert_with_geometry(spark.createDataFrame([(1, "LINESTRING (1 2, 3 4)"), (2, "junk")], "id int, wkt string"), str(tmp_path / "g"))
    assert {r.id: r.points and r.points[1].lat for r in spark.read.parquet(str(tmp_path / "g")).collect()} == {1: 4.0, 2: None}
    part = str(tmp_path / "p")
    frame = lambda *x: spark.createDataFrame(list(x), "run int, v int")
    tables.replace_partition(frame((1, 1), (2, 2)), part, "run")
    tables.replace_partition(frame((2, 9)), part, "run")
    assert sorted((r.run, r.v) for r in spark.read.parquet(part).collect()) == [(1, 1), (2, 9)]
    assert [len(b) for b in tables.batches(spark.range(12), 5)] == [5, 5, 2]


def test_migrations(spark, tmp_path):
    path, contract = str(tmp_path / "m"), governance.CONTRACTS["gee.flood"]
    schema = governance.schema_of(contract)
    assert [f.name for f in schema] == ["h3_id", "occurrence_pct", "seasonality"] and not schema["h3_id"].nullable
    assert tables.migrate(spark, path, schema) == ["made"] and tables.migrate(spark, path, schema) == []
    spark.createDataFrame([("a", 1, "own")], "h3_id string, occurrence_pct int, note string").write.mode("overwrite").parquet(path)
    assert tables.migrate(spark, path, schema) == ["occurrence_pct to double", "added seasonality"] and tables.migrate(spark, path, schema) == []
    row = spark.read.parquet(path).first()
    assert (row.h3_id, row.occurrence_pct, row.note, row.seasonality) == ("a", 1.0, "own", None)


def test_chunks_are_computed_once(spark, tmp_path):
    path, calls, seen = str(tmp_path / "zonal"), [], []
    cells = spark.createDataFrame([(i,) for i in (11, 12, 13)], "cell_id long")

    def compute(df):
        calls.append(sorted(r.cell_id for r in df.collect()))
        return df.filter("cell_id <> 12").select("cell_id", (F.col("cell_id") * 2.0).alias("v"))

    out = tables.run_chunks(cells, compute, path, 2, lambda name, df: seen.append(sorted(r.cell_id for r in df.collect())))
    assert {r.cell_id: r.v for r in out.collect()} == {11: 22.0, 12: None, 13: 26.0} and seen == [[11, 12], [13]]
    # a second run computes nothing, a larger grid only what is new
    tables.run_chunks(cells, compute, path, 2, lambda *x: seen.append(x))
    assert len(calls) == 1 and len(seen) == 2
    more = spark.createDataFrame([(i,) for i in range(11, 19)], "cell_id long")
    out = tables.run_chunks(more, compute, path, 2)
    assert calls[1:] == [[14, 15, 16, 17, 18]] and out.count() == 8


def test_parts_are_found_in_order(spark, tmp_path):
    for name, value in (("a_part_0002", 2), ("a_part_0001", 1), ("b", 3), ("a_other", 4)):
        spark.createDataFrame([(value,)], "v int").write.parquet(str(tmp_path / name))
    found = tables.discover_parts(spark, str(tmp_path / "a"))
    assert [p.rsplit("/", 1)[1] for p in found] == ["a_part_0001", "a_part_0002"]
    assert sorted(r.v for r in tables.read_asset(spark, str(tmp_path / "a")).collect()) == [1, 2]
    assert tables.read_asset(spark, str(tmp_path / "b")).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_asset(spark, str(tmp_path / "none"))


def _layer(spark, tmp_path, elements):
    (tmp_path / "o.json").write_text(json.dumps({"elements": elements}))
    return runs.Layer("osm.power_lines", lambda s: vector.overpass(s, str(tmp_path / "o.json")), lambda e: vector.power_lines(e, 0), governance.CONTRACTS["osm.power_lines"], str(tmp_path / "lines"))


def test_layer_run(spark, tmp_path):
    line = [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}]
    elements = [{"type": "way", "id": 1, "geometry": line, "tags": {"voltage": "400000"}}, {"type": "way", "id": 2, "geometry": line, "tags": {"voltage": "110000"}}]
    layer, hooked = _layer(spark, tmp_path, elements), []

    def hook(record):
        hooked.append(record["source"])
        raise RuntimeError("sync is down")

    log = runs.RunLog(spark, str(tmp_path / "runs"), [hook])
    assert runs.run_layer(log, layer, str(tmp_path / "letters")) == 1
    row = log.table().first()
    assert (row.status, row.row_count, row.rejected, row.notes) == ("success", 1, 1, "hook: sync is down") and row.duration_s >= 0 and hooked == ["osm.power_lines"]
    assert spark.read.parquet(layer.target).first().osm_id == 1
    letter = spark.read.parquet(str(tmp_path / "letters")).first()
    assert letter.run_id == row.run_id and letter.error == "voltage_kv:low" and json.loads(letter.payload)["osm_id"] == 2
    # within the time to live nothing is done, fresh goes on, and the table is loaded anew
    assert runs.run_layer(log, layer, str(tmp_path / "letters")) == 0 and log.table().count() == 1
    assert runs.run_layer(log, layer, str(tmp_path / "letters"), fresh=True) == 1 and spark.read.parquet(layer.target).count() == 1
    assert runs.run_layer(log, layer, str(tmp_path / "letters"), now=dt.datetime.now() + dt.timedelta(hours=48)) == 1
    broken = runs.Layer(layer.name, layer.fetch, lambda e: e.select("id"), layer.contract, layer.target)
    with pytest.raises(ValueError):
        runs.run_layer(log, broken, str(tmp_path / "letters"), fresh=True)
    assert sorted(r.status for r in log.table().collect()) == ["failed", "success", "success", "success"] and spark.read.parquet(layer.target).count() == 1


def test_all_layers_have_their_turn():
    turn = []

    def job(name, fails=False):
        def run():
            turn.append(name)
            if fails:
                raise OSError(f"no {name}")
            return 1

        return run

    names = ["seismic", "flood", "slope", "landcover", "solar", "climate", "population"]
    with pytest.raises(RuntimeError, match="slope: no slope; climate: no climate"):
        runs.run_all({n: job(n, n in ("slope", "climate")) for n in names})
    assert turn == names and runs.run_all({"a": job("a")}) == {"a": 1}


def test_phases():
    order = []

    def job(name, fails=False):
        def run():
            order.append(name)
            if fails:
                raise OSError("down")
            return len(order)

        return run

    out = runs.run_phases({p: job(p, p == "cells") for p in runs.PHASES})
    assert order.index("power") < order.index("cells") < min(order.index("scoring"), order.index("stakeholder"))
    assert out["cells"] == "failed: down" and isinstance(out["scoring"], int)
    assert list(runs.run_phases({"lineage": job("lineage")}, only=["lineage"])) == ["lineage"]
    with pytest.raises(ValueError):
        runs.run_phases({}, only=["nothing"])


def test_checks_are_kept_and_summarised(spark, tmp_path):
    good = governance.row_bounds(spark.range(5), "t", 1, 10)
    bad = governance.null_geometry(spark.createDataFrame([(None,)], "wkt string"), "g")
    found, summary, code = runs.run_checks([good, bad], str(tmp_path / "checks"))
    assert (summary, code) == ({"total": 2, "passed": 1, "errors": 1, "warnings": 0}, 1) and found.count() == 2
    assert runs.run_checks([good], str(tmp_path / "checks"))[2] == 0 and spark.read.parquet(str(tmp_path / "checks")).count() == 3
    assert runs.health(spark, {"a": spark.range(3)}) == {"a": 3}


def test_letters_have_no_infinity(spark):
    rows = spark.createDataFrame([("a", math.inf), ("b", math.nan), ("c", 1.0), (None, 7.0)], "h3_id string, pga_g double")
    clean, letters = governance.split(rows, governance.CONTRACTS["gee.seismic"])
    assert sorted(r.h3_id for r in clean.collect()) == ["b", "c"]
    said = [json.loads(r.payload) for r in letters.collect()]
    assert {"h3_id": "a", "pga_g": None} in said and {"h3_id": None, "pga_g": 7.0} in said
    long = spark.createDataFrame([("x" * 10, "y")], "osm_id string, wkt string")
    assert governance.split(long, governance.CONTRACTS["osm.railways"])[1].first().error == "osm_id:type"
    many = governance.Contract("many", tuple(governance.Rule(f"column_number_{k:04}", nullable=False) for k in range(150)))
    empty = spark.range(1).select(*(F.lit(None).cast("string").alias(r.name) for r in many.rules))
    assert len(governance.split(empty, many)[1].first().error) == 2000


def test_last_write_wins_and_spacing_beyond_the_head(spark):
    old, new = spark.createDataFrame([(1, "a", 0)], "k int, v string, t int"), spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1), (2, "d", 1)], "k int, v string, t int")
    assert sorted((r.k, r.v) for r in upsert.last_wins(old, new, ["k"], "t").collect()) == [(1, "c"), (2, "d")]
    rnd = random.Random(8)
    rows = [(i, "A" if i % 3 else "B", round(rnd.random(), 2), rnd.uniform(70, 73), rnd.uniform(10, 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "cell_id long, state_code string, score double, lon double, lat double")
    want = []
    for s in "AB":
        taken = []
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[2], r[0])):
            if len(taken) < 6 and all(ranking._km(r[3], r[4], t[3], t[4]) >= 90 for t in taken):
                taken.append(r)
        want += [(s, k + 1, r[0]) for k, r in enumerate(taken)]
    for head in (1000, 5):
        assert sorted((r.state_code, r.rank, r.cell_id) for r in ranking.spaced_top(df, 6, 90.0, head=head).collect()) == sorted(want)


def test_quantile_and_sentences(spark):
    rnd = random.Random(3)
    values = [rnd.choice([rnd.random(), 0.5, 1.0]) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for q in (0.0, 0.333, 0.9, 1.0):
        assert readapi.quantile(df, "v", q, buckets=7) == pytest.approx(df.agg(F.percentile("v", F.lit(q))).first()[0])
    assert readapi.quantile(df.limit(0), "v", 0.5) is None
    assert [readapi.eta_text(F.lit(float(s))) is not None for s in (1, 100)] == [True, True]
    preset = config.preset_from({"climate": 0.9})
    assert preset.climate == 0.9 and preset.latency == config.DEFAULT.latency
    with pytest.raises(TypeError):
        config.preset_from({"nothing": 1.0})


def test_states_and_protected_areas(spark, tmp_path):
    box = lambda x, y: [[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]]
    feature = lambda name, kind, c: {"type": "Feature", "properties": {"NAME_1": name}, "geometry": {"type": kind, "coordinates": c}}
    parts = [feature("Assam", "Polygon", box(0, 0)), feature("Assam", "Polygon", box(1, 0)), feature("DamanandDiu", "MultiPolygon", [box(9, 9), box(5, 5)]), feature("DadraandNagarHaveli", "Polygon", box(20, 20))]
    (tmp_path / "s.json").write_text(json.dumps({"type": "FeatureCollection", "features": parts}))
    found = {r.state_code: r.rings for r in vector.states(spark, str(tmp_path / "s.json")).collect()}
    assert {k: len(v) for k, v in found.items()} == {"AS": 1, "DH": 3} and len(found["AS"][0]) == 7
    (tmp_path / "u.json").write_text(json.dumps({"features": [feature("Atlantis", "Polygon", box(0, 0))]}))
    with pytest.raises(Exception, match="no state code for Atlantis"):
        vector.states(spark, str(tmp_path / "u.json")).collect()
    area = lambda i, iso, c: {"properties": {"wdpaid": str(i), "name": f"n{i}", "iso3": iso}, "geometry": {"type": "Polygon", "coordinates": c}}
    (tmp_path / "w.json").write_text(json.dumps({"features": [area(1, "IND", box(0, 0)), area(2, "FRA", box(0, 0)), area(3, "IND", [])]}))
    kept = vector.read_protected_areas(spark, str(tmp_path / "w.json")).collect()
    assert [(r.wdpa_id, r.wkt.startswith("POLYGON ((0.0 0.0, 1.0 0.0")) for r in kept] == [(1, True)]


def test_first_element_of_an_id_stays(spark, tmp_path):
    point = lambda i, name: {"type": "node", "id": i, "lat": 1.0, "lon": 2.0, "tags": {"name": name}}
    (tmp_path / "a.json").write_text(json.dumps({"elements": [point(1, "first tier 2"), point(2, "x"), point(1, "second tier 3")]}))
    got = {r.osm_id: r.name for r in vector.data_centers(vector.overpass(spark, str(tmp_path / "a.json"))).collect()}
    assert got == {1: "first tier 2", 2: "x"}
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.001), (2.0, 0.0)])], "osm_id long, path array<struct<lon:double,lat:double>>")
    assert json.loads(vector.feature_collection(lines, 5))["features"][0]["geometry"]["coordinates"] == [[0.0, 0.0], [2.0, 0.0]]


def test_each_chunk_once_resumes(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    spark.createDataFrame([(1,), (2,)], "v int").coalesce(1).write.parquet(src)
    run = lambda: incremental.each_chunk_once(spark, src, "v int", lambda df, k: seen.extend(r.v for r in df.collect()), str(tmp_path / "cp"))
    run()
    run()
    assert sorted(seen) == [1, 2]
    spark.createDataFrame([(3,)], "v int").coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(seen) == [1, 2, 3]


def test_cached_frames_age(spark):
    now, made = [0.0], []
    held = runs.Cached(300, lambda: now[0])
    make = lambda: made.append(1) or spark.range(len(made))
    assert held.get("a", make).count() == 1 and held.get("a", make).count() == 1
    now[0] = 301.0
    assert held.get("a", make).count() == 2 and len(made) == 2


def test_projection_keys(spark):
    rows = spark.createDataFrame([(1, 2), (None, 3)], "cell_id long, run_id long")
    assert [r.k for r in rows.select(projection.score_key().alias("k")).collect()] == ["1::2::res7", None]


def test_command_line(spark, tmp_path, capsys):
    tables_dir = "/root/testdata/sf0.001"
    assert cli.main(["list"]) == 0 and "score_default" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "--tables", tables_dir], spark) == 2
    (tmp_path / "p.json").write_text(json.dumps({"mine": {"climate": 0.5}}))
    if not __import__("os").path.exists(tables_dir):
        pytest.skip("needs the driver's tables")
    assert cli.main(["score", "mine", "--presets", str(tmp_path / "p.json"), "--tables", tables_dir, "--out", str(tmp_path / "o")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
    assert cli.main(["sql", "SELECT count(*) AS n FROM cells", "--tables", tables_dir], spark) == 0
    assert cli.main(["validate", "--tables", tables_dir, "--out", str(tmp_path / "c")], spark) == 0
