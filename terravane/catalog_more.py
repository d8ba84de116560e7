"""More registered queries: H3 ids, polygons, the lattice, projections, contracts and the read side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane import config
from terravane.catalog import _TWO, _TYPE, _lines, _protected_rings, query, r6
from terravane.functions import classify, geo, h3bits, hexgrid, polygons
from terravane.operators import governance, knn, spatial, upsert, zonal
from terravane.plans import graph, projection, readapi
from terravane.sources import vector

# --- H3 ids, made from keys: base cell and seven digits

_PRIMES = (1, 3, 5, 11, 13, 17, 19)
_DIGITS = {r: f"(((c_custkey * {p}) % 7) << {3 * (15 - r)})" for r, p in enumerate(_PRIMES, 1)}


def _h3_sql(resolution: int, digits: int) -> str:
    parts = [f"({1 << 59})", f"({resolution << 52})", "((c_custkey % 122) << 45)", *(_DIGITS[r] for r in range(1, digits + 1)), str((1 << 3 * (15 - resolution)) - 1)]
    return " | ".join(parts)


@query(
    f"SELECT c_custkey AS id, lower(to_hex({_h3_sql(7, 7)})) AS cell, {_h3_sql(5, 5)} AS parent, CAST(c_custkey % 122 AS INTEGER) AS base, "
    f"CASE WHEN c_custkey % 122 IN {h3bits.PENTAGONS} AND c_custkey % 7 = 0 THEN 6 ELSE 7 END AS n_children, {_h3_sql(8, 7)} AS first_child FROM customer"
)
def h3_parents(s):
    made = F.lit((1 << 59) | (7 << 52) | ((1 << 24) - 1)).bitwiseOR(F.shiftleft(F.col("c_custkey") % 122, 45))
    for r, p in enumerate(_PRIMES, 1):
        made = made.bitwiseOR(F.shiftleft((F.col("c_custkey") * p) % 7, 3 * (15 - r)))
    rows = s.customer.select("c_custkey", made.alias("c")).withColumn("c", h3bits.from_text(h3bits.to_text(F.col("c")))).filter(h3bits.is_cell(F.col("c")))
    kids = h3bits.children(F.col("c"), 7)
    return rows.select(
        F.col("c_custkey").alias("id"), h3bits.to_text(F.col("c")).alias("cell"), h3bits.parent(F.col("c"), 5).alias("parent"), h3bits.base_cell(F.col("c")).alias("base"),
        F.size(kids).alias("n_children"), F.array_min(kids).alias("first_child"),
    )


# --- the engine's own lattice, written again as SQL


def _cell_sql(lon: str, lat: str, resolution: int) -> str:
    """The id of the hexagon that holds a point: cube rounding of axial coordinates."""
    s = hexgrid.size_deg(resolution)
    q, r = f"(({hexgrid.SQRT3 / 3!r}e0 * ({lon}) - ({lat}) / 3) / {s!r}e0)", f"(({2 / 3!r}e0 * ({lat})) / {s!r}e0)"
    x, z, y = f"round({q})", f"round({r})", f"round(-{q} - {r})"
    dx, dy, dz = f"abs({x} - {q})", f"abs({y} + {q} + {r})", f"abs({z} - {r})"
    first = f"({dx} > {dy} AND {dx} > {dz})"
    qq, rr = f"CASE WHEN {first} THEN -{y} - {z} ELSE {x} END", f"CASE WHEN {first} OR {dy} > {dz} THEN {z} ELSE -{x} - {y} END"
    return _pack_sql(f"CAST({qq} AS BIGINT)", f"CAST({rr} AS BIGINT)", resolution)


def _pack_sql(q: str, r: str, resolution: int) -> str:
    return f"(CAST({resolution << 56} AS BIGINT) + ({q} + {hexgrid.BIAS}) * {1 << 28} + ({r} + {hexgrid.BIAS}))"


def _centre_sql(q: str, r: str, resolution: int) -> tuple[str, str]:
    s = hexgrid.size_deg(resolution)
    return f"({s!r}e0 * ({hexgrid.SQRT3!r}e0 * {q} + {hexgrid.SQRT3 / 2!r}e0 * {r}))", f"({s * 1.5!r}e0 * {r})"


_S4 = hexgrid.size_deg(4)
_CX, _CY = _centre_sql("q", "r", 4)


@query(
    f"WITH g AS (SELECT osm_id, x_lo, y_lo, x_hi, y_hi, unnest(generate_series(CAST(floor(y_lo / {1.5 * _S4!r}e0) AS BIGINT) - 1, CAST(floor(y_hi / {1.5 * _S4!r}e0) AS BIGINT) + 1)) AS r FROM protected), "
    f"h AS (SELECT *, unnest(generate_series(CAST(floor((x_lo - {hexgrid.SQRT3 / 2 * _S4!r}e0 * r) / {hexgrid.SQRT3 * _S4!r}e0) AS BIGINT) - 1, CAST(floor((x_hi - {hexgrid.SQRT3 / 2 * _S4!r}e0 * r) / {hexgrid.SQRT3 * _S4!r}e0) AS BIGINT) + 1)) AS q FROM g), "
    f"c AS (SELECT osm_id, x_lo, y_lo, x_hi, y_hi, {_pack_sql('q', 'r', 4)} AS cell, {_CX} AS cx, {_CY} AS cy FROM h) "
    f"SELECT osm_id, lower(to_hex(cell)) AS cell, {_cell_sql('cx', 'cy', 3)} AS parent, round({1.5 * hexgrid.SQRT3 * _S4**2 * 111.195**2!r}e0 * cos(radians(cy)), 6) AS area_km2 FROM c WHERE cx > x_lo AND cx < x_hi AND cy > y_lo AND cy < y_hi"
)
def hexgrid_cover(s):
    found = hexgrid.cover(_protected_rings(s), 4)
    return found.select("osm_id", hexgrid.to_text(F.col("cell")).alias("cell"), hexgrid.parent(F.col("cell"), 4).alias("parent"), r6(hexgrid.area_km2(F.col("cell"), 4)).alias("area_km2"))


def _axial_sql(cell: str) -> tuple[str, str]:
    return f"((({cell}) >> 28) & {(1 << 28) - 1}) - {hexgrid.BIAS}", f"(({cell}) & {(1 << 28) - 1}) - {hexgrid.BIAS}"


_PQ, _PR = _axial_sql("parent_cell")
_PX, _PY = _centre_sql("pq", "pr", 7)
_NQ, _NR = _axial_sql("near")
_KX, _KY = _centre_sql("(nq + a)", "(nr + b)", 8)


@query(
    f"WITH t AS (SELECT DISTINCT {_cell_sql('lon', 'lat', 7)} AS parent_cell, state_code FROM (SELECT * FROM scores WHERE run_id = 1 AND NOT is_excluded ORDER BY score DESC, cell_id LIMIT {config.Settings().drill_top_n})), "
    f"u AS (SELECT *, {_PQ} AS pq, {_PR} AS pr FROM t), v AS (SELECT *, {_cell_sql(_PX, _PY, 8)} AS near FROM u), w AS (SELECT *, {_NQ} AS nq, {_NR} AS nr FROM v), "
    f"k AS (SELECT w.*, d.a, e.b FROM w, (SELECT unnest(generate_series(-3, 3)) AS a) d, (SELECT unnest(generate_series(-3, 3)) AS b) e WHERE abs(d.a + e.b) <= 3) "
    f"SELECT {_pack_sql('(nq + a)', '(nr + b)', 8)} AS child, parent_cell, state_code FROM k WHERE {_cell_sql(_KX, _KY, 7)} = parent_cell"
)
def drilldown_children(s):
    top = s.scores.filter("run_id = 1 and not is_excluded").orderBy(F.desc("score"), "cell_id").limit(config.Settings().drill_top_n)
    top = top.select(hexgrid.cell_at(F.col("lon"), F.col("lat"), 7).alias("parent_cell"), "state_code").distinct()
    kids = top.select("parent_cell", F.explode(hexgrid.children(F.col("parent_cell"), 7)).alias("child"))
    # a child's state is that of its parent, found again from the child's own id
    states = top.withColumnRenamed("parent_cell", "own")
    return kids.join(states, hexgrid.parent(F.col("child"), 8) == F.col("own")).select("child", "parent_cell", "state_code").distinct()


_GX, _GY = _centre_sql("gq", "gr", 6)
_GQ, _GR = _axial_sql("cell")
_S6 = hexgrid.size_deg(6)


@query(
    f"WITH a AS (SELECT cell_id, {_cell_sql('lon', 'lat', 6)} AS cell FROM cells), b AS (SELECT cell_id, cell, {_GQ} AS gq, {_GR} AS gr FROM a) "
    f"SELECT cell_id, lower(to_hex(cell)) AS cell, cell AS back, 7 AS n_corners, round({_GX} + {_S6 * 3**0.5 / 2!r}e0, 6) AS x0, round({_GY} + {_S6 / 2!r}e0, 6) AS y0, round({_GX}, 6) AS cx, round({_GY}, 6) AS cy, "
    f"{_pack_sql('(gq - 2)', 'gr', 6)} AS low, {_pack_sql('(gq + 2)', 'gr', 6)} AS high, 19 AS n_disk FROM b"
)
def cell_geometry(s):
    """Text and back, corners, centre and the disk of two steps of the cell that holds each point."""
    rows = s.cells.select("cell_id", hexgrid.cell_at(F.col("lon"), F.col("lat"), 6).alias("c"))
    corners, centre, disk = hexgrid.boundary(F.col("c"), 6), hexgrid.center(F.col("c"), 6), hexgrid.disk(F.col("c"), 2, 6)
    return rows.select(
        "cell_id", hexgrid.to_text(F.col("c")).alias("cell"), hexgrid.from_text(hexgrid.to_text(F.col("c"))).alias("back"), F.size(corners).alias("n_corners"), r6(corners[0]["lon"]).alias("x0"), r6(corners[0]["lat"]).alias("y0"),
        r6(centre["lon"]).alias("cx"), r6(centre["lat"]).alias("cy"), F.array_min(disk).alias("low"), F.array_max(disk).alias("high"), F.size(disk).alias("n_disk"),
    )


_OX, _OY = "68 + CAST((o_orderkey * 7919) % 29500 AS DOUBLE) / 1000", "6.5 + CAST((o_orderkey * 10473) % 31000 AS DOUBLE) / 1000"


@query(f"SELECT {_cell_sql('lon', 'lat', 3)} AS cell_id, count(*) AS n, round(avg(v), 4) AS mean FROM (SELECT CAST({_OX} AS DOUBLE) AS lon, CAST({_OY} AS DOUBLE) AS lat, o_totalprice AS v FROM orders) GROUP BY 1")
def pixel_cells(s):
    pixels = s.orders.selectExpr(f"cast({_OX} as double) AS lon", f"cast({_OY} as double) AS lat", "o_totalprice AS v")
    found = zonal.assign_pixels(pixels, 3)
    cells = found.select("cell_id").distinct()
    return zonal.zonal(cells, found, n=F.count("*"), mean=F.avg("v")).withColumn("mean", F.round("mean", 4))


# --- polygons


def _rect(x_lo, y_lo, x_hi, y_hi):
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(corner(x_lo, y_lo), corner(x_hi, y_lo), corner(x_hi, y_hi), corner(x_lo, y_hi))


@query("SELECT p.osm_id AS a, z.osm_id AS b FROM protected p JOIN zones z ON z.lon - 2.6 <= p.x_hi AND z.lon + 2.6 >= p.x_lo AND z.lat - 2.6 <= p.y_hi AND z.lat + 2.6 >= p.y_lo")
def zones_meet_protected(s):
    c = F.col
    left = _protected_rings(s).select(c("osm_id").alias("a"), F.array("ring").alias("rings"))
    right = s.zones.select(c("osm_id").alias("b"), F.array(_rect(c("lon") - 2.6, c("lat") - 2.6, c("lon") + 2.6, c("lat") + 2.6)).alias("rings"))
    return spatial.meeting(left, right)


@query(
    "SELECT c.cell_id, min(p.osm_id) AS area_id FROM cells c JOIN protected p ON c.lon > p.x_lo AND c.lon < p.x_hi AND c.lat > p.y_lo AND c.lat < p.y_hi "
    "WHERE NOT (c.lon > p.x_lo + 0.5005 AND c.lon < p.x_hi - 0.5005 AND c.lat > p.y_lo + 0.5005 AND c.lat < p.y_hi - 0.5005) GROUP BY c.cell_id"
)
def stamp_with_holes(s):
    c, d = F.col, 0.5005
    whole, hole = _rect(c("x_lo"), c("y_lo"), c("x_hi"), c("y_hi")), _rect(c("x_lo") + d, c("y_lo") + d, c("x_hi") - d, c("y_hi") - d)
    areas = s.protected.select(c("osm_id").alias("area_id"), polygons.wkt_rings(polygons.rings_wkt(F.array(whole, hole))).alias("rings"))
    cells = s.cells.withColumn("area_id", F.lit(None).cast("int"))
    return spatial.stamp(cells, areas, "cell_id", "area_id", border=False).filter("area_id is not null").select("cell_id", "area_id")


@query("SELECT n_regionkey AS code, 1 AS n_rings, CAST(count(*) AS DOUBLE) AS area FROM nation GROUP BY n_regionkey")
def dissolved_regions(s):
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("double")
    y = F.col("n_regionkey").cast("double") * 2
    # unit boxes side by side, every second one the other way round
    ring = _rect(k, y, k + 1, y + 1)
    parts = s.nation.select(F.col("n_regionkey").alias("code"), F.array(F.when(k % 2 == 0, ring).otherwise(F.reverse(ring))).alias("rings"))
    found = spatial.dissolve(parts, "code")
    ring = F.element_at("rings", 1)
    area = F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda t, i: t + F.element_at(ring, i)["lon"] * F.element_at(ring, i + 1)["lat"] - F.element_at(ring, i + 1)["lon"] * F.element_at(ring, i)["lat"])
    return found.select("code", F.size("rings").alias("n_rings"), (area / 2).alias("area"))


@query("SELECT osm_id, CASE osm_id % 20 WHEN 0 THEN 2 ELSE 3 END AS n_points, 'LineString' AS kind, round(x2, 6) AS x_end FROM power_lines")
def simplified_lines(s):
    """The middle point of every second line stands aside by twice the tolerance."""
    c = F.col
    aside = F.when(c("osm_id") % 20 == 0, 0.0).otherwise(0.01)
    length = F.sqrt(F.pow(c("x2") - c("x1"), 2) + F.pow(c("y2") - c("y1"), 2))
    dx = F.when(length == 0, 0.0).otherwise((c("y1") - c("y2")) / length) * aside
    dy = F.when(length == 0, 1.0).otherwise((c("x2") - c("x1")) / length) * aside
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    path = F.array(point(c("x1"), c("y1")), point((c("x1") + c("x2")) / 2 + dx, (c("y1") + c("y2")) / 2 + dy), point(c("x2"), c("y2")))
    made = vector.to_geojson(s.power_lines.select("osm_id", path.alias("path")), 0.005)
    at = F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), "array<array<double>>")
    return made.select("osm_id", F.size(at).alias("n_points"), F.get_json_object("feature", "$.geometry.type").alias("kind"), r6(F.element_at(F.element_at(at, -1), 1)).alias("x_end"))


# --- the graph's projections

_KIND = "CASE source WHEN 'view' THEN 'osm.power_lines' WHEN 'click' THEN 'gee.slope' ELSE source END"
_WEIGHTS = [(0, {"climate": 0.5, "latency": 0.5}), (1, {"power": 1.0})]
_COMPANY = "CASE osm_id % 5 WHEN 0 THEN 'Amazon Web Services' WHEN 1 THEN 'Reliance Jio' WHEN 2 THEN 'CtrlS Datacenters' WHEN 3 THEN 'NTT' ELSE 'Local Colo' END"


def _projections(s) -> list[tuple[DataFrame, DataFrame]]:
    runs = s.runs.withColumn("source", F.expr(_KIND))
    weights = s.spark.createDataFrame(_WEIGHTS, "run_id int, weights map<string,double>")
    centers = s.zones.select("osm_id", F.lit(None).cast("string").alias("name"), "operator")
    return [
        projection.cells(s.cells), projection.power(s.power_lines, s.substations, s.connects), projection.lineage(runs, s.letters),
        projection.scoring(s.scores, weights), projection.stakeholders(s.power_lines, s.substations, s.zones, centers),
    ]


@query(
    "SELECT 'State' AS label, count(DISTINCT state_code) AS n FROM cells UNION ALL SELECT 'Cell', count(*) FROM cells UNION ALL SELECT 'Line', count(*) FROM power_lines UNION ALL SELECT 'Substation', count(*) FROM substations "
    "UNION ALL SELECT 'SubGrid', count(DISTINCT subgrid) FROM power_lines UNION ALL SELECT 'SchemaContract', 17 UNION ALL SELECT 'IngestionRun', count(*) FROM runs UNION ALL SELECT 'RejectedRow', count(*) FROM letters "
    "UNION ALL SELECT 'ScoringRun', count(DISTINCT run_id) FROM scores UNION ALL SELECT 'Weight', 3 UNION ALL SELECT 'Score', count(*) FROM scores UNION ALL SELECT 'SEZ', count(*) FROM zones "
    f"UNION ALL SELECT 'Hyperscaler', count(DISTINCT {_COMPANY}) FROM zones UNION ALL SELECT 'Operator', count(*) FROM (SELECT trim(operator) AS o FROM power_lines UNION SELECT trim(operator) FROM substations) x WHERE o <> '' "
    "UNION ALL SELECT 'Metro', 10 UNION ALL SELECT 'CableLanding', 7 UNION ALL SELECT 'WaterBody', count(*) FROM water UNION ALL SELECT 'Highway', count(*) FROM highways UNION ALL SELECT 'ProtectedArea', count(*) FROM protected"
)
def graph_nodes(s):
    keys = projection.key_only({
        "Metro": (vector.metros(s.spark), "name"), "CableLanding": (vector.landings(s.spark), "name"), "WaterBody": (s.water, "target_id"), "Highway": (s.highways, "target_id"), "ProtectedArea": (s.protected, "osm_id"),
    })
    found = keys
    for own, _ in _projections(s):
        found = found.unionByName(own)
    return graph.stats(found, "label")


@query(
    "SELECT 'IN_STATE' AS type, count(*) AS n FROM cells UNION ALL SELECT 'CONNECTS', count(*) FROM connects UNION ALL "
    "SELECT 'IN_SUBGRID', (SELECT count(*) FROM power_lines WHERE subgrid IS NOT NULL) + (SELECT count(*) FROM (SELECT DISTINCT c.sub_id, l.subgrid FROM connects c JOIN power_lines l ON l.osm_id = c.line_id WHERE l.subgrid IS NOT NULL "
    "EXCEPT SELECT osm_id, subgrid FROM power_lines)) UNION ALL SELECT 'VALIDATED_BY', count(*) FROM runs WHERE source IN ('view', 'click') UNION ALL SELECT 'REJECTED_BY', count(*) FROM letters UNION ALL SELECT 'APPLIES', 3 UNION ALL "
    "SELECT 'HAS_SCORE', count(*) FROM scores UNION ALL SELECT 'DERIVED_FROM', count(*) FROM scores UNION ALL SELECT 'USES_WEIGHTS', CAST(sum(CASE run_id WHEN 0 THEN 2 ELSE 1 END) AS BIGINT) FROM scores UNION ALL "
    f"SELECT 'OPERATED_BY', count(*) FROM (SELECT osm_id, trim(operator) AS o FROM power_lines WHERE trim(operator) <> '' UNION SELECT osm_id, trim(operator) FROM substations WHERE trim(operator) <> '' UNION SELECT osm_id, {_COMPANY} FROM zones)"
)
def graph_edges(s):
    found = None
    for _, ties in _projections(s):
        found = ties if found is None else found.unionByName(ties)
    return graph.stats(found, "type")


@query("SELECT CAST(cell_id AS VARCHAR) || '::' || CAST(run_id AS VARCHAR) || '::res7' AS score_key, CASE WHEN cell_id % 3 = 0 THEN 'row:' || CAST(run_id AS VARCHAR) ELSE 'osm:' || CAST(cell_id AS VARCHAR) END AS place FROM scores")
def composite_keys(s):
    rows = s.scores.withColumn("osm_id", F.when(F.col("cell_id") % 3 != 0, F.col("cell_id")))
    return rows.select(projection.score_key().alias("score_key"), projection.osm_or_row("osm_id", "run_id").alias("place"))


@query("SELECT c.cell_id, c.run_id, c.score FROM scores c WHERE c.run_id = 1 AND c.cell_id % 1 = 0")
def scoring_of_one_run(s):
    """The incremental part of one run, read back from its nodes and edges."""
    weights = s.spark.createDataFrame(_WEIGHTS, "run_id int, weights map<string,double>")
    own, ties = projection.scoring(s.scores, weights, run_id=1)
    scored = own.filter("label = 'Score'").select(F.col("key").alias("dst"), F.get_json_object("props", "$.score").cast("double").alias("score"))
    found = ties.filter("type = 'HAS_SCORE'").join(scored, "dst")
    return found.select(F.col("src").cast("long").alias("cell_id"), F.split("dst", "::")[1].cast("int").alias("run_id"), "score")


@query(f"SELECT DISTINCT {_COMPANY} AS company FROM zones")
def distinct_companies(s):
    return projection.companies(s.zones.select(F.lit(None).cast("string").alias("name"), "operator"))


@query("SELECT n.cell_id, n.line_id, round(n.km, 6) AS km, s.score FROM nearest_line n JOIN (SELECT DISTINCT line_id FROM connects WHERE sub_id = 7) c ON c.line_id = n.line_id LEFT JOIN scores s ON s.cell_id = n.cell_id")
def outage_cells_any_run(s):
    return graph.outage_cells(s.connects, s.nearest_line, s.scores, 7).withColumn("km", r6("km"))


@query("SELECT l.type, count(*) AS n FROM (SELECT state_code, 'IN_STATE' AS type FROM cells) l GROUP BY l.type")
def ad_hoc_sql(s):
    _, ties = projection.cells(s.cells)
    return projection.ask({"graph_ties": ties}, "SELECT type, count(*) AS n FROM graph_ties GROUP BY type", 10)


# --- the graph on what the joins find


@query(f"WITH {_TWO} SELECT coalesce(l.subgrid, -1) AS subgrid, count(*) AS n_cells, count(o.osm_id) AS n_dual FROM two t JOIN power_lines l ON l.osm_id = t.line_id LEFT JOIN power_lines o ON o.osm_id = t.other_id GROUP BY 1")
def cells_by_nearest_subgrid(s):
    """Cells whose nearest line, as the join finds it, is of a sub-grid, and how many of them have a line of another one."""
    found = knn.nearest_two_groups(s.cells, _lines(s))
    grid = s.power_lines.select(F.col("osm_id").alias("line_id"), F.coalesce("subgrid", F.lit(-1)).alias("subgrid"))
    return found.join(grid, "line_id").groupBy("subgrid").agg(F.count("*").alias("n_cells"), F.count("other_id").alias("n_dual"))


_EPS = 1.7


def _to_segment(px: str, py: str, l: str) -> str:
    t = f"least(1.0, greatest(0.0, coalesce((({px} - {l}.x1) * ({l}.x2 - {l}.x1) + ({py} - {l}.y1) * ({l}.y2 - {l}.y1)) / nullif(pow({l}.x2 - {l}.x1, 2) + pow({l}.y2 - {l}.y1, 2), 0), 0.0)))"
    return f"sqrt(pow({px} - {l}.x1 - {t} * ({l}.x2 - {l}.x1), 2) + pow({py} - {l}.y1 - {t} * ({l}.y2 - {l}.y1), 2))"


def _side(l: str, x: str, y: str) -> str:
    return f"(({l}.x2 - {l}.x1) * ({y} - {l}.y1) - ({l}.y2 - {l}.y1) * ({x} - {l}.x1))"


_APART = (
    f"CASE WHEN {_side('a', 'b.x1', 'b.y1')} * {_side('a', 'b.x2', 'b.y2')} < 0 AND {_side('b', 'a.x1', 'a.y1')} * {_side('b', 'a.x2', 'a.y2')} < 0 THEN 0.0 ELSE "
    f"least({_to_segment('a.x1', 'a.y1', 'b')}, {_to_segment('a.x2', 'a.y2', 'b')}, {_to_segment('b.x1', 'b.y1', 'a')}, {_to_segment('b.x2', 'b.y2', 'a')}) END"
)


@query(
    f"WITH RECURSIVE e AS (SELECT a.osm_id AS a, b.osm_id AS b FROM power_lines a, power_lines b WHERE {_APART} <= {_EPS}), "
    "w(n, m) AS (SELECT a, b FROM e UNION SELECT w.n, e.b FROM w JOIN e ON e.a = w.m), c AS (SELECT n, min(m) AS c FROM w GROUP BY n) SELECT x.n AS a, y.n AS b FROM c x JOIN c y ON x.c = y.c AND x.n < y.n"
)
def parallel_lines(s):
    """Pairs of lines of one epsilon cluster, from the lines' own geometry."""
    segments = s.power_lines.select(F.col("osm_id").alias("id"), "x1", "y1", "x2", "y2")
    found = knn.epsilon_clusters(segments, _EPS)
    return graph.parallel_pairs(found.select(F.col("id").alias("osm_id"), F.col("cluster").alias("cluster_id")))


# --- contracts and checks


def _contract_sql() -> str:
    out = []
    for name, c in governance.CONTRACTS.items():
        needed, low = next((r for r in c.rules if not r.nullable), None), next((r for r in c.rules if r.low is not None), None)
        bad = ["c_custkey % 7 = 0"] if needed else []
        if low and (low is not needed):
            bad.append("c_custkey % 11 = 0")
        elif low:
            bad.append("c_custkey % 11 = 0")
        among = next((r for r in c.rules if r.among), None)
        if among:
            bad.append("c_custkey % 13 = 0")
        test = " OR ".join(bad) or "false"
        out.append(f"SELECT '{name}' AS source, count(*) FILTER (WHERE NOT ({test})) AS kept, count(*) FILTER (WHERE {test}) AS rejected FROM customer")
    return " UNION ALL ".join(out)


@query(_contract_sql())
def contracts_all(s):
    """Every contract on rows made for it: a needed value is missing, one lies under its bound, one is no word of the list."""
    k, found = F.col("c_custkey"), None
    for name, contract in governance.CONTRACTS.items():
        needed, low = next((r for r in contract.rules if not r.nullable), None), next((r for r in contract.rules if r.low is not None), None)
        columns = []
        for r in contract.rules:
            if r.among:
                value = F.when(k % 13 == 0, "none of them").otherwise(r.among[-1])
            elif r.kind == "string":
                value = F.lit("text")
            else:
                good = r.low if r.low is not None else 1
                value = F.when(k % 11 == 0, F.lit(good - 1)).otherwise(F.lit(good)) if r is low else F.lit(good)
                value = value.cast("string")
            columns.append((F.when(k % 7 != 0, value) if r is needed else value).alias(r.name))
        clean, letters = governance.split(s.customer.select(*columns), contract)
        one = lambda df, kept: df.select(F.lit(name).alias("source"), F.lit(kept).alias("kept"), F.lit(1 - kept).alias("rejected"))  # noqa: B023, E731
        rows = one(clean, 1).unionByName(one(letters, 0))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("source").agg(F.sum("kept").alias("kept"), F.sum("rejected").alias("rejected"))


_GEOMETRY = {"power_lines": "osm_id", "substations": "osm_id", "highways": "target_id", "water": "target_id", "protected": "osm_id"}


@query(
    " UNION ALL ".join(
        f"SELECT 'null_geometry' AS check_name, '{t}' AS subject, CASE WHEN count(*) FILTER (WHERE {k} % 70 = 0) > 0 THEN 'error' ELSE 'info' END AS severity, count(*) FILTER (WHERE {k} % 70 = 0) = 0 AS passed, count(*) FILTER (WHERE {k} % 70 = 0) AS observed FROM {t}"
        for t, k in _GEOMETRY.items()
    )
    + " UNION ALL SELECT 'null_geometry', 'railways', 'info', false, -1 UNION ALL SELECT 'null_geometry', 'cable_landings', 'info', true, 0 UNION ALL SELECT 'null_geometry', 'metros', 'info', true, 0"
)
def dq_null_geometry(s):
    """Eight tables; railways are missing here."""
    found = governance.null_geometry(None, "railways", spark=s.spark)
    point = F.format_string("POINT (%s %s)", F.col("lon").cast("string"), F.col("lat").cast("string"))
    for name, df in (("cable_landings", vector.landings(s.spark)), ("metros", vector.metros(s.spark))):
        found = found.unionByName(governance.null_geometry(df.withColumn("wkt", point), name))
    for t, k in _GEOMETRY.items():
        df = getattr(s, t).withColumn("wkt", F.when(F.col(k) % 70 != 0, F.lit("POINT (0 0)")))
        found = found.unionByName(governance.null_geometry(df, t))
    return found


@query(" UNION ALL ".join(f"SELECT 'schema_hash' AS check_name, '{n}' AS subject, 'warn' AS severity, {str(n != 'wdpa').lower()} AS passed, {int(n == 'wdpa')} AS observed" for n in governance.CONTRACTS))
def schema_hashes(s):
    """The contracts as registered once; one has changed since."""
    registered = governance.register_contracts(s.spark)
    old = registered.withColumn("schema_hash", F.when(F.col("source") == "wdpa", F.sha2(F.lit("old"), 256)).otherwise(F.col("schema_hash")))
    return governance.schema_hash_check(old)


@query("SELECT CAST(17 + 8 AS BIGINT) AS total, CAST(16 + x.ok AS BIGINT) AS passed, CAST(x.err AS BIGINT) AS errors, CAST(1 AS BIGINT) AS warnings FROM (SELECT sum(CASE WHEN e THEN 0 ELSE 1 END) + 2 AS ok, sum(CASE WHEN e THEN 1 ELSE 0 END) AS err FROM (" + " UNION ALL ".join(f"SELECT count(*) FILTER (WHERE {k} % 70 = 0) > 0 AS e FROM {t}" for t, k in _GEOMETRY.items()) + ")) x")
def check_summary(s):
    return governance.summarise(schema_hashes(s).unionByName(dq_null_geometry(s)))


@query("SELECT source, max(run_id) AS run_id FROM (SELECT event_type AS source, event_id AS run_id FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0) GROUP BY source")
def upsert_repeated_keys(s):
    """Keys that are in the new rows many times: the last write wins."""
    old = s.runs.select("source", F.lit(-1).cast("long").alias("run_id")).distinct()
    new = s.runs.filter("status = 'success' and run_id % 5 <> 0").select("source", "run_id")
    return upsert.last_wins(old, new, ["source"], "run_id")


# --- the read side

_SECONDS = "CASE c_custkey % 3 WHEN 0 THEN c_custkey % 60 WHEN 1 THEN (10 + c_custkey % 500) * 6 ELSE (10 + c_custkey % 1000) * 360 END"


@query(f"SELECT c_custkey AS id, CASE WHEN x < 60 THEN printf('%.0fs', x) WHEN x < 3600 THEN printf('%.1fmin', x / 60) ELSE printf('%.1fh', x / 3600) END AS eta FROM (SELECT c_custkey, CAST({_SECONDS} AS DOUBLE) AS x FROM customer)")
def eta_texts(s):
    return s.customer.select(F.col("c_custkey").alias("id"), readapi.eta_text(F.expr(_SECONDS).cast("double")).alias("eta"))


@query("SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN 'TN' WHEN 1 THEN 'TN' WHEN 2 THEN NULL WHEN 3 THEN 'DH' ELSE NULL END AS code FROM nation")
def state_codes(s):
    name = F.expr("CASE n_nationkey % 5 WHEN 0 THEN 'Tamil Nadu' WHEN 1 THEN 'TamilNadu' WHEN 2 THEN 'tamil nadu' WHEN 3 THEN 'Dadra and Nagar Haveli and Daman and Diu' ELSE 'Atlantis' END")
    return s.nation.select(F.col("n_nationkey").alias("id"), classify.state_code(name).alias("code"))


_SAY = "lower({p}.l) || ' ' || printf('%.2f', -{p}.v)"


@query(
    "WITH p AS (SELECT cell_id, score, list_sort([{'v': -CAST(cell_id % 9 AS DOUBLE) / 10, 'k': 'sub_water', 'l': 'Water proximity'}, {'v': -CAST(cell_id % 7 AS DOUBLE) / 10, 'k': 'sub_conn', 'l': 'Connectivity (fiber)'}, {'v': -CAST(cell_id % 5 AS DOUBLE) / 10, 'k': 'sub_lat', 'l': 'Demand latency'}]) AS x FROM scores) "
    f"SELECT cell_id, 'Score ' || printf('%.3f', score) || ', led by ' || {_SAY.format(p='x[1]')} || ' and ' || {_SAY.format(p='x[2]')} || CASE WHEN -x[3].v < 0.4 THEN '; weakest: ' || {_SAY.format(p='x[3]')} ELSE '' END || '.' AS sentence FROM p"
)
def reasoning_sentences(s):
    d = lambda n: (F.col("cell_id") % n).cast("double") / 10
    parts = readapi.ranked_parts(F.to_json(F.struct(d(9).alias("sub_water"), d(7).alias("sub_conn"), d(5).alias("sub_lat"))))
    return s.scores.select("cell_id", readapi.reasoning(F.col("score"), parts).alias("sentence"))


@query("SELECT state_code, cell_id, score FROM scores WHERE run_id = 1 ORDER BY state_code, score DESC, cell_id LIMIT 100")
def sites_by_state(s):
    return readapi.top_sites(s.scores.filter("run_id = 1").select("state_code", "cell_id", "score"), limit=100)


@query("SELECT run_id, source FROM runs ORDER BY finished_at DESC NULLS LAST, run_id DESC LIMIT 100")
def runs_latest(s):
    return readapi.list_runs(s.runs).select("run_id", "source")


@query("SELECT DISTINCT state_code FROM scores WHERE state_code IS NOT NULL")
def states_listed(s):
    return readapi.list_states(s.scores)


@query("SELECT f.cell_id, f.nearest_water_km, s.run_id, s.score FROM features f LEFT JOIN (SELECT s.* FROM scores s JOIN runs r ON r.run_id = s.run_id WHERE s.cell_id = 42 ORDER BY r.finished_at DESC, s.run_id DESC LIMIT 1) s ON s.cell_id = f.cell_id WHERE f.cell_id = 42")
def cell_detail(s):
    return readapi.cell_detail(s.features, s.scores, s.runs, 42).select("cell_id", "nearest_water_km", "run_id", "score")


@query(f"SELECT osm_id, {_TYPE.format(n='o')} AS type, len(o) AS n FROM (SELECT osm_id, trim(operator) AS o FROM power_lines WHERE trim(operator) <> '')")
def line_operators(s):
    return graph.operated_by(s.power_lines).select(F.col("line_id").alias("osm_id"), F.col("operator_type").alias("type"), F.char_length("operator").cast("long").alias("n"))


@query("SELECT osm_id, len(r) AS n_rings, CAST(list_sum(list_transform(r, lambda x: len(string_split(x, ',')))) AS INTEGER) AS n_points FROM (SELECT osm_id, CASE osm_id % 3 WHEN 0 THEN ['0 0, 4 0, 4 4, 0 0', '1 1, 2 1, 2 2, 1 1'] WHEN 1 THEN ['0 0, 1 0, 1 1, 0 0'] ELSE ['0 0, 1 0', '5 5, 6 6, 7 7'] END AS r FROM zones)")
def wkt_parts(s):
    text = F.expr("CASE osm_id % 3 WHEN 0 THEN 'POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))' WHEN 1 THEN 'MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))' ELSE 'MULTILINESTRING ((0 0, 1 0), (5 5, 6 6, 7 7))' END")
    rows = s.zones.select("osm_id", polygons.wkt_rings(text).alias("r"))
    return rows.select("osm_id", F.size("r").cast("long").alias("n_rings"), F.size(F.flatten("r")).alias("n_points"))


@query("SELECT osm_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM zones")
def square_centroids(s):
    c = geo.ring_centroid(geo.square(F.col("lon"), F.col("lat"), 0.01))
    return s.zones.select("osm_id", r6(c["lon"]).alias("lon"), r6(c["lat"]).alias("lat"))
