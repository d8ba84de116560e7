"""Query catalogue of the siting engine: a DataFrame query and an independent SQL text for each name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane import config
from terravane.functions import classify, geo
from terravane.operators import governance, knn, ranking, scoring, spatial, upsert, zonal
from terravane.operators.components import connected_components
from terravane.plans import graph, readapi
from terravane.plans.views import register, view, with_views
from terravane.sources import vector
from terravane.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class _Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        from terravane.plans.views import VIEWS

        if name in VIEWS:
            return view(self.spark, self.dir, name)
        register(self.spark, self.dir, [name])
        return self.spark.table(name)


def query(sql: str | None = None):
    """Register a function of tables under its name, with SQL for comparison if it can be expressed."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(_Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[fn.__name__] = with_views(sql)
        return fn

    return add


def r6(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


_HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b} - {y}) / 2), 2) + cos(radians({y})) * cos(radians({b})) * pow(sin(radians({a} - {x}) / 2), 2))))"
_KM = _HAV.format(x="c.lon", y="c.lat", a="t.lon", b="t.lat")
_T = "least(1.0, greatest(0.0, ((c.lon - l.x1) * (l.x2 - l.x1) + (c.lat - l.y1) * (l.y2 - l.y1)) / nullif(pow(l.x2 - l.x1, 2) + pow(l.y2 - l.y1, 2), 0)))"
_PAIRS = f"""pairs AS (SELECT cell_id, state_code, osm_id, subgrid, sqrt(pow(lon - px, 2) + pow(lat - py, 2)) AS deg, {_HAV.format(x='lon', y='lat', a='px', b='py')} AS km FROM
  (SELECT c.cell_id, c.state_code, c.lon, c.lat, l.osm_id, l.subgrid, l.x1 + coalesce({_T}, 0.0) * (l.x2 - l.x1) AS px, l.y1 + coalesce({_T}, 0.0) * (l.y2 - l.y1) AS py FROM cells c CROSS JOIN power_lines l))"""
_TWO = f"""{_PAIRS}, g AS (SELECT cell_id, subgrid, arg_min(osm_id, (deg, km, osm_id)) AS id, min(deg) AS deg, arg_min(km, (deg, km, osm_id)) AS km FROM pairs GROUP BY cell_id, subgrid),
k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY deg, km, id) AS k FROM g),
two AS (SELECT cell_id, max(CASE WHEN k = 1 THEN id END) AS line_id, max(CASE WHEN k = 1 THEN km END) AS km, max(CASE WHEN k = 2 THEN id END) AS other_id, max(CASE WHEN k = 2 THEN km END) AS other_km FROM k WHERE k <= 2 GROUP BY cell_id)"""


def _lines(t_: _Tables) -> DataFrame:
    return t_.power_lines.select(F.col("osm_id").alias("target_id"), "x1", "y1", "x2", "y2", F.col("subgrid").alias("grp"))


@query(f"WITH {_TWO} SELECT cell_id, round(km, 6) AS nearest_km, round(other_km, 6) AS distinct_subgrid_km FROM two")
def dual_feed_distances(s):
    found = knn.nearest_two_groups(s.cells, _lines(s))
    return found.select("cell_id", r6("km").alias("nearest_km"), r6("other_km").alias("distinct_subgrid_km"))


@query(f"WITH {_TWO} SELECT two.cell_id, line_id, other_id AS dual_line_id FROM two JOIN cells c ON c.cell_id = two.cell_id WHERE two.cell_id % 6 <> 0")
def nearest_line_identity(s):
    found = knn.nearest_two_groups(s.features.filter("not is_excluded"), _lines(s))
    return found.select("cell_id", "line_id", F.col("other_id").alias("dual_line_id"))


def _metro_values() -> str:
    return ", ".join(f"({i}, CAST({m[3]} AS DOUBLE), CAST({m[4]} AS DOUBLE))" for i, m in enumerate(config.METROS))


_NEAR = "(SELECT least({km}, 500.0) FROM {t} t ORDER BY sqrt(pow(c.lon - t.lon, 2) + pow(c.lat - t.lat, 2)), {km}, t.target_id LIMIT 1)"


@query(
    f"WITH metros AS (SELECT * FROM (VALUES {_metro_values()}) v(target_id, lon, lat)) SELECT c.cell_id, round({_NEAR.format(km=_KM, t='metros')}, 6) AS nearest_metro_km, "
    f"round({_NEAR.format(km=_KM, t='water')}, 6) AS nearest_water_km, round({_NEAR.format(km=_KM, t='highways')}, 6) AS nearest_highway_km FROM cells c"
)
def nearest_infra_capped(s):
    metros = vector.metros(s.spark).withColumn("target_id", F.monotonically_increasing_id()).select("target_id", "lon", "lat")
    out = s.cells
    for name, targets in (("nearest_metro_km", metros), ("nearest_water_km", s.water), ("nearest_highway_km", s.highways)):
        out = knn.nearest_capped(out, targets, name, config.DISTANCE_CAP_KM)
    return out.select("cell_id", *(r6(c).alias(c) for c in ("nearest_metro_km", "nearest_water_km", "nearest_highway_km")))


_ENDS = _HAV.format(x="a.lon", y="a.lat", a="b.lon", b="b.lat")


@query(
    f"WITH m AS (SELECT left_id, right_id, {_ENDS} AS km FROM line_ends a JOIN snap_points b ON abs(a.lon - b.lon) <= 0.009 AND abs(a.lat - b.lat) <= 0.009), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY km, right_id) AS k FROM m WHERE km <= 1) SELECT left_id, right_id, round(km, 6) AS km FROM r WHERE k = 1"
)
def endpoint_snap(s):
    return knn.within_nearest(s.line_ends, s.snap_points).select("left_id", "right_id", r6("km").alias("km"))


def _point_segments(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))


@query(
    "WITH RECURSIVE e AS (SELECT a.osm_id AS a, b.osm_id AS b FROM substations a, substations b WHERE sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) <= 1.2), "
    "w(n, m) AS (SELECT a, b FROM e UNION SELECT w.n, e.b FROM w JOIN e ON e.a = w.m) SELECT n AS osm_id, min(m) AS cluster_id FROM w GROUP BY n"
)
def epsilon_clusters(s):
    points = _point_segments(s.substations, "osm_id")
    links = knn.within_epsilon(points, 1.2).unionByName(points.select(F.col("id").alias("a"), F.col("id").alias("b")))
    return connected_components(links).select(F.col("node").alias("osm_id"), F.col("component").alias("cluster_id"))


@query()
def subgrid_components(s):
    """Recursive SQL over all edges is too slow; tests hold the components against union-find."""
    e = s.connects.select((F.col("line_id") * 2).alias("a"), (F.col("sub_id") * 2 + 1).alias("b"))
    return connected_components(e)


@query("SELECT c.cell_id, min(p.osm_id) AS area_id FROM cells c JOIN protected p ON c.lon > p.x_lo AND c.lon < p.x_hi AND c.lat > p.y_lo AND c.lat < p.y_hi GROUP BY c.cell_id")
def state_stamp_pip(s):
    areas = _protected_rings(s).select("osm_id", F.array("ring").alias("rings"))
    met = spatial.points_in(s.cells, areas, border=False)
    return met.groupBy("cell_id").agg(F.min("osm_id").alias("area_id"))


def _protected_rings(s) -> DataFrame:
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(corner("x_lo", "y_lo"), corner("x_hi", "y_lo"), corner("x_hi", "y_hi"), corner("x_lo", "y_hi"))
    return s.protected.withColumn("ring", ring)


def _masked(s) -> DataFrame:
    cells = scoring.join_layers(s.cells, {"seismic": s.seismic, "flood": s.flood, "slope": s.slope, "landcover": s.landcover}, 7)
    inside = state_stamp_pip(s).select("cell_id", F.lit(True).alias("in_protected"))
    return scoring.exclusion_mask(cells.join(inside, "cell_id", "left"))


_MASK = """m AS (SELECT c.cell_id, list_filter([CASE WHEN coalesce(z.in_zone_v, false) THEN 'seismic_zone_v' END, CASE WHEN flood_pct > 25 THEN 'flood_recurrence' END, CASE WHEN slope_deg > 10 THEN 'slope_too_steep' END,
 CASE WHEN urban_pct > 70 THEN 'urban_built_up' END, CASE WHEN forest_pct > 60 THEN 'forest_cover' END, CASE WHEN wetland_pct > 30 THEN 'wetland' END, CASE WHEN water_pct > 50 THEN 'water_body' END,
 CASE WHEN EXISTS (SELECT 1 FROM protected p WHERE c.lon > p.x_lo AND c.lon < p.x_hi AND c.lat > p.y_lo AND c.lat < p.y_hi) THEN 'protected_area' END], lambda x: x IS NOT NULL) AS reasons
 FROM cells c LEFT JOIN seismic z ON z.cell_id = c.cell_id LEFT JOIN flood f ON f.cell_id = c.cell_id LEFT JOIN slope s ON s.cell_id = c.cell_id LEFT JOIN landcover v ON v.cell_id = c.cell_id)"""


@query(f"WITH {_MASK} SELECT cell_id, len(reasons) > 0 AS is_excluded, array_to_string(reasons, ',') AS reasons FROM m")
def exclusion_mask(s):
    return _masked(s).select("cell_id", "is_excluded", F.array_join("exclusion_reasons", ",").alias("reasons"))


@query(f"WITH {_MASK} SELECT cell_id, unnest(reasons) AS reason FROM m")
def exclusion_reasons_exploded(s):
    return graph.excluded_by(_masked(s)).select("cell_id", "reason")


@query(
    "SELECT c.cell_id, CASE WHEN t.cell_id IS NOT NULL AND p.cell_id IS NOT NULL THEN s.ghi END AS ghi, CASE WHEN s.cell_id IS NOT NULL AND p.cell_id IS NOT NULL THEN t.mean_temp_c END AS mean_temp_c, "
    "CASE WHEN t.cell_id IS NOT NULL AND s.cell_id IS NOT NULL THEN p.pop_total END AS pop_total FROM cells c LEFT JOIN solar s ON s.cell_id = c.cell_id LEFT JOIN climate t ON t.cell_id = c.cell_id LEFT JOIN population p ON p.cell_id = c.cell_id"
)
def solar_climate_pop_merge(s):
    return scoring.merge_together(s.cells, [s.solar, s.climate, s.population]).select("cell_id", "ghi", "mean_temp_c", "pop_total")


@query("SELECT c.cell_id, coalesce(v.urban_pct, CAST(c.cell_id % 50 AS DOUBLE)) AS urban_pct FROM cells c LEFT JOIN landcover v ON v.cell_id = c.cell_id")
def landcover_coalesce_merge(s):
    old = s.cells.select("cell_id", (F.col("cell_id") % 50).cast("double").alias("urban_pct"))
    return scoring.fill_from(old, s.landcover, ["urban_pct"])


@query(
    "SELECT c.cell_id, " + ", ".join(f"round(avg(CASE WHEN p.code IS NULL THEN NULL WHEN p.code IN ({', '.join(map(str, v))}) THEN 1.0 ELSE 0.0 END) * 100, 6) AS {k}" for k, v in zonal.LANDCOVER.items())
    + " FROM cells c LEFT JOIN pixels p ON p.cell_id = c.cell_id GROUP BY c.cell_id"
)
def class_fraction_pivot(s):
    return zonal.landcover(s.cells, s.pixels).select("cell_id", *(r6(k).alias(k) for k in zonal.LANDCOVER))


@query("SELECT c.cell_id, round(avg(value), 6) AS mean_slope_deg, round(max(value), 6) AS max_slope_deg, round(quantile_cont(value, 0.95), 6) AS p95_slope_deg FROM cells c LEFT JOIN pixels p ON p.cell_id = c.cell_id GROUP BY c.cell_id")
def zonal_slope_stats(s):
    return zonal.slope(s.cells, s.pixels).select("cell_id", *(r6(k).alias(k) for k in ("mean_slope_deg", "max_slope_deg", "p95_slope_deg")))


@query("SELECT c.cell_id, round(least(greatest(coalesce(avg(occurrence), 0), 0), 100), 6) AS occurrence_pct, round(avg(seasonality), 6) AS seasonality FROM cells c LEFT JOIN pixels p ON p.cell_id = c.cell_id GROUP BY c.cell_id")
def zonal_flood_clip(s):
    return zonal.flood(s.cells, s.pixels).select("cell_id", r6("occurrence_pct").alias("occurrence_pct"), r6("seasonality").alias("seasonality"))


@query(
    "WITH a AS (SELECT c.cell_id, avg(temp_k) - 273.15 AS tc, avg(dew_k) - 273.15 AS dc FROM cells c LEFT JOIN pixels p ON p.cell_id = c.cell_id GROUP BY c.cell_id) SELECT cell_id, round(tc, 6) AS mean_temp_c, "
    "round(CASE WHEN tc IS NOT NULL THEN least(greatest(100 * exp(17.625 * dc / (243.04 + dc)) / exp(17.625 * tc / (243.04 + tc)), 0), 100) END, 6) AS mean_rh_pct FROM a"
)
def zonal_climate_rh(s):
    return zonal.climate(s.cells, s.pixels).select("cell_id", r6("mean_temp_c").alias("mean_temp_c"), F.when(F.col("mean_temp_c").isNotNull(), r6("mean_rh_pct")).alias("mean_rh_pct"))


@query("SELECT c.cell_id, round(sum(value), 4) AS pop_total, round(sum(value) / 5.16, 4) AS pop_density_per_km2 FROM cells c LEFT JOIN pixels p ON p.cell_id = c.cell_id GROUP BY c.cell_id")
def zonal_population_density(s):
    return zonal.population(s.cells, s.pixels, 5.16).select("cell_id", F.round("pop_total", 4).alias("pop_total"), F.round("pop_density_per_km2", 4).alias("pop_density_per_km2"))


@query("SELECT c.cell_id, round(sum(monthly_j_m2) / 3.6e6, 6) AS ghi_kwh_per_m2, round(sum(monthly_j_m2) / 3.6e6 * 0.75, 6) AS pvout_kwh_per_kwp FROM cells c LEFT JOIN pixels p ON p.cell_id = c.cell_id GROUP BY c.cell_id")
def solar_fallback(s):
    return zonal.solar(s.cells, s.pixels, has_pvout=False).select("cell_id", r6("ghi_kwh_per_m2").alias("ghi_kwh_per_m2"), r6("pvout_kwh_per_kwp").alias("pvout_kwh_per_kwp"))


@query("SELECT c.cell_id, round(avg(pga), 6) AS pga_g, coalesce(avg(pga) > 0.36, false) AS in_zone_v FROM cells c LEFT JOIN pixels p ON p.cell_id = c.cell_id GROUP BY c.cell_id")
def seismic_zone_flag(s):
    return zonal.seismic(s.cells, s.pixels, "pga").select("cell_id", r6("pga_g").alias("pga_g"), "in_zone_v")


def _score_sql(p: config.Preset) -> str:
    w = p.weights()
    d = lambda c, km: f"exp(-coalesce({c}, 9999) / {km})"
    subs = {
        "sub_power": f"{1 - p.secondary_weight} * {d('nearest_hv_line_km', p.primary_decay_km)} + {p.secondary_weight} * {d('nearest_hv_line_distinct_subgrid_km', p.secondary_decay_km)}",
        "sub_water": d("nearest_water_km", p.water_decay_km),
        "sub_conn": d("nearest_highway_km", p.highway_decay_km),
        "sub_solar": f"1 / (1 + exp(-(coalesce(annual_pvout_kwh_per_kwp, 1000) - {p.pvout_center}) / {p.pvout_spread}))",
        "sub_clim": f"1 - least(1, greatest(0, (coalesce(mean_temp_c, 50) - {p.temp_low_c}) / ({p.temp_high_c} - {p.temp_low_c})))",
        "sub_lat": f"{1 - p.cable_weight} * {d('nearest_metro_km', p.metro_decay_km)} + {p.cable_weight} * {d('nearest_cable_landing_km', p.cable_decay_km)}",
    }
    total = " + ".join(f"{w[k]!r} * ({subs[n]})" for k, n in zip(w, scoring.SUBS))
    return "SELECT cell_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in subs.items()) + f", round(least(1, greatest(0, {total})), 6) AS score FROM features"


def _scored(name: str):
    preset = config.PRESETS[name]

    def run(s):
        out = scoring.score(s.features, preset)
        return out.select("cell_id", *(r6(c).alias(c) for c in [*scoring.SUBS, "score"]))

    run.__name__ = f"score_{name}"
    query(_score_sql(preset))(run)


for _name in config.PRESETS:
    _scored(_name)


_GREEDY = """WITH RECURSIVE s AS (SELECT state_code, cell_id, score, lon, lat, row_number() OVER (PARTITION BY state_code ORDER BY score DESC, cell_id) AS k FROM scores WHERE run_id = 1 AND NOT is_excluded),
w(state_code, k, cell_id, score, lon, lat, taken, ok) AS (
 SELECT state_code, k, cell_id, score, lon, lat, [{'x': lon, 'y': lat}], true FROM s WHERE k = 1
 UNION ALL SELECT s.state_code, s.k, s.cell_id, s.score, s.lon, s.lat, CASE WHEN q.free THEN list_append(q.taken, {'x': s.lon, 'y': s.lat}) ELSE q.taken END, q.free FROM (
  SELECT w.state_code, w.k + 1 AS k, w.taken, n.cell_id, len(w.taken) < 5 AND len(list_filter(w.taken, lambda t: HAV < 400)) = 0 AS free FROM w JOIN s n ON n.state_code = w.state_code AND n.k = w.k + 1) q
  JOIN s ON s.state_code = q.state_code AND s.k = q.k)
SELECT state_code, CAST(len(taken) AS INTEGER) AS rank, cell_id, round(score, 6) AS score FROM w WHERE ok""".replace("HAV", _HAV.format(x="t.x", y="t.y", a="n.lon", b="n.lat"))


@query(_GREEDY)
def top_sites_diverse(s):
    own = s.scores.filter("run_id = 1 and not is_excluded")
    return ranking.spaced_top(own, 5, 400.0).select("state_code", "rank", "cell_id", r6("score").alias("score"))


@query("SELECT state_code, cell_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY state_code ORDER BY score DESC, cell_id) AS rank FROM scores WHERE run_id = 0) WHERE rank <= 10")
def top_n_per_state(s):
    return ranking.top_n(s.scores.filter("run_id = 0"), "state_code", 10, F.desc("score"), "cell_id").select("state_code", "cell_id", "score", F.col("rank").cast("int").alias("rank"))


@query("SELECT cell_id, state_code, score, lon, lat FROM scores WHERE NOT is_excluded AND run_id = 1 AND score >= 0.6 ORDER BY score DESC, cell_id LIMIT 50")
def score_map_filtered(s):
    return readapi.score_map(s.scores, run_id=1, min_score=0.6, limit=50)


@query(
    "SELECT state_code, count(*) AS n, round(avg(score), 6) AS mean_score, max(score) AS max_score, round(quantile_cont(score, 0.9), 6) AS p90_score, count(*) FILTER (WHERE score >= 0.7) AS n_high, count(*) FILTER (WHERE is_excluded) AS n_excluded FROM scores GROUP BY state_code"
)
def state_stats(s):
    return readapi.state_stats(s.scores).withColumns({c: r6(c) for c in ("mean_score", "p90_score")})


@query("SELECT CAST(CASE WHEN score < 0 THEN 0 WHEN score >= 1 THEN 31 ELSE floor(score * 30) + 1 END AS BIGINT) AS bucket, count(*) AS n, min(score) AS lo, max(score) AS hi FROM scores GROUP BY 1")
def score_histogram(s):
    return readapi.histogram(s.scores)


@query("SELECT count(*) AS cells, coalesce(max(score), 0) AS best, round(coalesce(quantile_cont(score, 0.9), 0), 6) AS p90, round(coalesce(count(*) FILTER (WHERE is_excluded) / CAST(nullif(count(*), 0) AS DOUBLE), 0), 6) AS excluded_share FROM scores")
def kpis(s):
    return readapi.kpis(s.scores).withColumns({c: r6(c) for c in ("p90", "excluded_share")})


@query("SELECT k.state_code, k.cell_id, k.rank, '{\"sub_water\":' || CAST(k.cell_id % 9 AS VARCHAR) || ',\"sub_conn\":' || CAST(k.cell_id % 7 AS VARCHAR) || '}' AS breakdown FROM (SELECT state_code, cell_id, CAST(row_number() OVER (PARTITION BY state_code ORDER BY score DESC, cell_id) AS INTEGER) AS rank FROM scores WHERE run_id = 1) k WHERE rank <= 3")
def top_sites_with_breakdown(s):
    top = ranking.top_n(s.scores.filter("run_id = 1"), "state_code", 3, F.desc("score"), "cell_id").select("state_code", "cell_id", F.col("rank").cast("int").alias("rank"), "run_id")
    parts = s.scores.select("cell_id", "run_id", (F.col("cell_id") % 9).alias("sub_water"), (F.col("cell_id") % 7).alias("sub_conn"))
    return top.join(parts, ["cell_id", "run_id"], "left").select("state_code", "cell_id", "rank", readapi.breakdown_json(["sub_water", "sub_conn"]).alias("breakdown"))


@query(
    "WITH p AS (SELECT cell_id, [{'v': -CAST(cell_id % 9 AS DOUBLE) / 10, 'l': 'water proximity'}, {'v': -CAST(cell_id % 7 AS DOUBLE) / 10, 'l': 'connectivity (fiber)'}, {'v': -CAST(cell_id % 5 AS DOUBLE) / 10, 'l': 'solar potential'}] AS x, score FROM scores), "
    "q AS (SELECT cell_id, score, list_sort(x) AS x FROM p WHERE cell_id % 50 <> 0) SELECT cell_id, CAST(len(x) AS INTEGER) AS n_parts, x[1].l AS best, -x[1].v + 0.0 AS best_value FROM q UNION ALL SELECT cell_id, 0 AS n_parts, NULL AS best, NULL AS best_value FROM p WHERE cell_id % 50 = 0"
)
def breakdown_parse_rank(s):
    d = lambda n: (F.col("cell_id") % n).cast("double") / 10
    # labels that tie are ordered by their key, here as in the other text
    good = F.to_json(F.struct(d(9).alias("sub_water"), d(7).alias("sub_conn"), d(5).alias("sub_solar"), F.lit("x").alias("note")))
    rows = s.scores.select("cell_id", F.when(F.col("cell_id") % 50 == 0, "{broken").otherwise(good).alias("breakdown"))
    parts = readapi.ranked_parts(F.col("breakdown"))
    best = F.array_min(F.transform(parts, lambda p: F.struct((-p["value"]).alias("v"), F.lower(p["label"]).alias("l"))))
    return rows.select("cell_id", F.size(parts).alias("n_parts"), best["l"].alias("best"), (-best["v"] + 0.0).alias("best_value"))


@query("SELECT source, run_id, finished_at FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY finished_at DESC NULLS LAST, run_id DESC) AS k FROM runs WHERE status = 'success') WHERE k = 1")
def latest_run_per_source(s):
    return ranking.latest(s.runs.filter("status = 'success'"), "source", "finished_at", "run_id").select("source", "run_id", "finished_at")


@query("SELECT r.source, r.run_id FROM runs r JOIN (SELECT source, max(finished_at) AS m FROM runs GROUP BY source) x ON x.source = r.source AND x.m = r.finished_at")
def latest_runs_with_ties(s):
    return graph.latest_runs(s.runs).select("source", "run_id")


@query(
    "WITH l AS (SELECT source, run_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY finished_at DESC, run_id DESC) AS k FROM runs WHERE status = 'success') WHERE k = 1) "
    "SELECT l.source, l.run_id, count(*) AS rejected, count(*) < 2 AS passed FROM l JOIN letters d ON d.run_id = l.run_id AND d.source = l.source GROUP BY l.source, l.run_id"
)
def dlq_volume_check(s):
    return governance.dlq_volume(s.runs, s.letters, limit=2)


@query("SELECT source, count(*) AS n FROM letters GROUP BY source")
def dlq_summary(s):
    return s.letters.groupBy("source").agg(F.count("*").alias("n"))


@query(
    "SELECT 'row_count' AS check_name, 'cells' AS subject, 'warn' AS severity, count(*) BETWEEN 100 AND 100000000 AS passed, count(*) AS observed FROM cells UNION ALL "
    "SELECT 'row_count', 'power_lines', 'warn', count(*) BETWEEN 100000000 AND 200000000, count(*) FROM power_lines UNION ALL SELECT 'row_count', 'missing', 'warn', false, -1"
)
def dq_row_bounds(s):
    found = [governance.row_bounds(s.cells, "cells", 100, 10**8), governance.row_bounds(s.power_lines, "power_lines", 10**8, 2 * 10**8), governance.row_bounds(None, "missing", 0, 1, s.spark)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _contract_rows(s) -> DataFrame:
    wkt = F.when(F.col("osm_id") % 70 != 0, F.lit("LINESTRING (0 0, 1 1)"))
    raw = F.when(F.col("osm_id") % 90 == 0, "unknown").otherwise(F.col("voltage_kv").cast("string"))
    return s.power_lines.select("osm_id", raw.alias("voltage_kv"), "operator", (F.col("osm_id") % 3).alias("circuits"), wkt.alias("wkt"))


@query("SELECT osm_id, CAST(voltage_kv AS INTEGER) AS voltage_kv, operator, CAST(osm_id % 3 AS BIGINT) AS circuits FROM power_lines WHERE osm_id % 70 <> 0 AND osm_id % 90 <> 0 AND voltage_kv >= 220")
def contract_split_clean(s):
    clean, _ = governance.split(_contract_rows(s), governance.CONTRACTS["osm.power_lines"])
    return clean.select("osm_id", "voltage_kv", "operator", "circuits")


@query(
    "SELECT 'osm.power_lines' AS source, osm_id, array_to_string(list_filter([CASE WHEN osm_id % 90 = 0 THEN 'voltage_kv:type' END, CASE WHEN osm_id % 90 <> 0 AND voltage_kv < 220 THEN 'voltage_kv:low' END, CASE WHEN osm_id % 70 = 0 THEN 'wkt:null' END], lambda x: x IS NOT NULL), '; ') AS error "
    "FROM power_lines WHERE osm_id % 70 = 0 OR osm_id % 90 = 0 OR voltage_kv < 220"
)
def contract_split_rejects(s):
    _, letters = governance.split(_contract_rows(s), governance.CONTRACTS["osm.power_lines"])
    return letters.select("source", F.get_json_object("payload", "$.osm_id").cast("long").alias("osm_id"), "error")


@query("SELECT run_id, source FROM runs WHERE status = 'success' AND finished_at > TIMESTAMP '2024-01-20 00:00:00'")
def skip_recent_sources(s):
    return governance.recent_success(s.runs, __import__("datetime").datetime(2024, 1, 20)).select("run_id", "source")


@query("SELECT cell_id, urban_pct FROM landcover WHERE cell_id % 4 = 0 UNION ALL SELECT c.cell_id, CAST(-1 AS DOUBLE) FROM cells c WHERE c.cell_id NOT IN (SELECT cell_id FROM landcover WHERE cell_id % 4 = 0)")
def upsert_last_wins(s):
    old = s.cells.select("cell_id", F.lit(-1.0).alias("urban_pct"))
    return upsert.last_wins(old, s.landcover.filter("cell_id % 4 = 0").select("cell_id", "urban_pct"), ["cell_id"])


@query("SELECT coalesce(c.cell_id, v.cell_id) AS cell_id, c.state_code, CASE WHEN v.cell_id IS NOT NULL THEN v.urban_pct ELSE CAST(-1 AS DOUBLE) END AS urban_pct FROM (SELECT * FROM cells WHERE cell_id % 3 <> 0) c FULL JOIN landcover v ON v.cell_id = c.cell_id")
def upsert_preserving(s):
    old = s.cells.filter("cell_id % 3 <> 0").select("cell_id", "state_code", F.lit(-1.0).alias("urban_pct"))
    return upsert.preserving(old, s.landcover.select("cell_id", "urban_pct"), ["cell_id"])


@query("SELECT cell_id, min(state_code) AS state_code FROM (SELECT cell_id % 500 AS cell_id, state_code FROM cells) GROUP BY cell_id")
def insert_ignore_first(s):
    return upsert.first_kept(s.cells.select((F.col("cell_id") % 500).alias("cell_id"), "state_code"), ["cell_id"], "state_code")


@query("SELECT a.osm_id AS a, b.osm_id AS b FROM power_lines a JOIN power_lines b ON a.subgrid = b.subgrid AND a.voltage_kv = b.voltage_kv AND a.osm_id < b.osm_id")
def parallel_pairs(s):
    return graph.parallel_pairs(s.power_lines.withColumn("cluster_id", F.col("subgrid") * 1000 + F.col("voltage_kv")))


@query("SELECT subgrid, count(*) AS n_lines, CAST(sum(voltage_kv) AS BIGINT) AS total_kv FROM power_lines WHERE subgrid IS NOT NULL GROUP BY subgrid")
def subgrid_rollup(s):
    return graph.subgrid_rollup(s.power_lines)


_TYPE = "CASE WHEN lower({n}) LIKE '%powergrid%' OR lower({n}) LIKE '%ntpc%' THEN 'psu' WHEN lower({n}) LIKE '%transco%' OR lower({n}) LIKE '%ptcl%' THEN 'state' WHEN lower({n}) LIKE '%tata power%' OR lower({n}) LIKE '%adani%' OR lower({n}) LIKE '%sterlite%' THEN 'private' ELSE 'unknown' END"


@query(
    f"SELECT name, max(kind) AS kind, any_value({_TYPE.format(n='name')}) AS type FROM (SELECT trim(operator) AS name, 'line' AS kind FROM power_lines UNION ALL SELECT trim(operator), 'substation' FROM substations) WHERE name <> '' GROUP BY name"
)
def operators_union_distinct(s):
    return graph.operators(s.power_lines, s.substations)


@query("SELECT n.cell_id, n.line_id, round(n.km, 6) AS km, s.score FROM nearest_line n JOIN (SELECT DISTINCT line_id FROM connects WHERE sub_id = 7) c ON c.line_id = n.line_id LEFT JOIN scores s ON s.cell_id = n.cell_id AND s.run_id = 1")
def outage_cells(s):
    return graph.outage_cells(s.connects, s.nearest_line, s.scores, 7, 1).withColumn("km", r6("km"))


@query("SELECT d.cell_id, d.line_id, round(d.km, 6) AS km FROM dual_line d JOIN power_lines l ON l.osm_id = d.line_id WHERE l.subgrid = 3")
def dual_feed_losers(s):
    return graph.dual_feed_losers(s.power_lines, s.dual_line, 3).withColumn("km", r6("km"))


@query("SELECT trim(l.operator) AS operator, count(*) AS n_cells FROM (SELECT * FROM scores WHERE run_id = 1 ORDER BY score DESC, cell_id LIMIT 100) s JOIN nearest_line n ON n.cell_id = s.cell_id JOIN power_lines l ON l.osm_id = n.line_id WHERE trim(l.operator) <> '' GROUP BY 1")
def operator_concentration(s):
    return graph.operator_concentration(s.scores, s.nearest_line, graph.operated_by(s.power_lines), 1)


@query("SELECT c.sub_id, count(DISTINCT n.cell_id) AS affected FROM connects c JOIN nearest_line n ON n.line_id = c.line_id GROUP BY c.sub_id HAVING count(DISTINCT n.cell_id) >= 25")
def systemic_substations(s):
    return graph.systemic_substations(s.connects, s.nearest_line)


@query(
    f"SELECT s.cell_id, s.score, trim(l.operator) AS operator FROM scores s JOIN nearest_line n ON n.cell_id = s.cell_id JOIN power_lines l ON l.osm_id = n.line_id WHERE s.run_id = 1 AND s.score >= 0.6 AND trim(l.operator) <> '' AND {_TYPE.format(n='trim(l.operator)')} = 'psu' ORDER BY s.score DESC, s.cell_id LIMIT 50"
)
def top_by_operator_type(s):
    return graph.top_by_operator_type(s.scores, s.nearest_line, graph.operated_by(s.power_lines), 1, "psu")


@query(
    "SELECT s.cell_id, s.score, trim(a.operator) AS primary_operator, trim(b.operator) AS dual_operator FROM scores s JOIN nearest_line n ON n.cell_id = s.cell_id JOIN power_lines a ON a.osm_id = n.line_id JOIN dual_line d ON d.cell_id = s.cell_id JOIN power_lines b ON b.osm_id = d.line_id "
    "WHERE s.run_id = 1 AND trim(a.operator) <> '' AND trim(b.operator) <> '' AND trim(a.operator) <> trim(b.operator) ORDER BY s.score DESC, s.cell_id LIMIT 20"
)
def distinct_operator_redundancy(s):
    return graph.distinct_operator_redundancy(s.scores, s.nearest_line, s.dual_line, graph.operated_by(s.power_lines), 1)


_APPROX = "sqrt(pow(s.lon - z.lon, 2) + pow(s.lat - z.lat, 2)) * 111"


@query(f"SELECT s.cell_id, z.osm_id, round({_APPROX}, 6) AS km, s.score FROM scores s JOIN zones z ON z.state_code = s.state_code WHERE s.run_id = 1 AND s.score >= 0.5 AND (z.name LIKE 'Data Center%' OR z.name LIKE 'Cloud%') AND {_APPROX} <= 250")
def near_sez(s):
    return graph.near_zones(s.scores, s.zones, 1, max_km=250).withColumn("km", r6("km"))


@query(f"SELECT s.cell_id, z.osm_id, round({_APPROX}, 6) AS km, m.score FROM cells s JOIN zones z ON z.state_code = s.state_code LEFT JOIN (SELECT cell_id, max(score) AS score FROM scores GROUP BY cell_id) m ON m.cell_id = s.cell_id WHERE z.operator = 'NTT' AND {_APPROX} <= 300")
def hyperscaler_neighbourhood(s):
    return graph.company_neighbourhood(s.cells, s.zones, s.scores, "NTT", 300).withColumn("km", r6("km"))


@query("SELECT s.cell_id, s.run_id, s.score, CAST(len(list(w.criterion)) AS INTEGER) AS n_weights, string_agg(w.criterion, ',' ORDER BY w.criterion) AS criteria FROM scores s JOIN (VALUES (0, 'climate'), (0, 'latency'), (1, 'power')) w(run_id, criterion) ON w.run_id = s.run_id WHERE s.cell_id = 42 GROUP BY ALL")
def score_provenance(s):
    weights = s.spark.createDataFrame([(0, "climate", 0.5), (0, "latency", 0.5), (1, "power", 1.0)], "run_id int, criterion string, weight double")
    found = graph.score_provenance(s.scores, weights, 42)
    return found.select("cell_id", "run_id", "score", F.size("weights").alias("n_weights"), F.array_join("weights.criterion", ",").alias("criteria"))


@query("SELECT DISTINCT x.via, r.run_id, r.source FROM (SELECT 'line' AS via, cell_id, line_id % 1000 AS run_id FROM nearest_line UNION ALL SELECT 'dual', cell_id, line_id % 1000 FROM dual_line) x JOIN runs r ON r.run_id = x.run_id WHERE x.cell_id = 42")
def cell_lineage(s):
    tie = lambda df: df.select("cell_id", (F.col("line_id") % 1000).alias("run_id"))
    return graph.cell_lineage({"line": tie(s.nearest_line), "dual": tie(s.dual_line)}, s.runs, 42).select("via", "run_id", "source")


@query("SELECT 'Cell' AS label, count(*) AS n FROM cells UNION ALL SELECT 'Line', count(*) FROM power_lines UNION ALL SELECT 'Substation', count(*) FROM substations")
def graph_stats(s):
    all_ = graph.nodes("Cell", s.cells, "cell_id").unionByName(graph.nodes("Line", s.power_lines, "osm_id")).unionByName(graph.nodes("Substation", s.substations, "osm_id"))
    return graph.stats(all_, "label")


@query("SELECT type, count(*) AS n FROM (SELECT DISTINCT 'NEAREST_LINE' AS type, cell_id, line_id FROM nearest_line UNION ALL SELECT DISTINCT 'CONNECTS', sub_id, line_id FROM connects) GROUP BY type")
def graph_edge_stats(s):
    all_ = graph.edges("NEAREST_LINE", s.nearest_line, "cell_id", "line_id").unionByName(graph.edges("CONNECTS", s.connects, "sub_id", "line_id"))
    return graph.stats(all_, "type")


@query("SELECT 'cells' AS entity, (SELECT count(*) FROM cells) AS n_left, (SELECT count(*) FROM features) AS n_right, false AS drift UNION ALL SELECT 'lines', (SELECT count(*) FROM power_lines), (SELECT count(*) FROM power_lines WHERE voltage_kv >= 400), true")
def parity_drift(s):
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
    left = one("cells", s.cells).unionByName(one("lines", s.power_lines))
    return governance.parity(left, one("cells", s.features).unionByName(one("lines", s.power_lines.filter("voltage_kv >= 400"))))


@query("SELECT osm_id, CASE osm_id % 4 WHEN 0 THEN 220 WHEN 1 THEN 400 WHEN 2 THEN 765 ELSE NULL END AS voltage_kv FROM substations")
def voltage_parse(s):
    raw = F.expr("CASE osm_id % 4 WHEN 0 THEN '132000;220000' WHEN 1 THEN '400 kV' WHEN 2 THEN '765000' ELSE 'unknown' END")
    return s.substations.select("osm_id", classify.voltage_kv(raw).alias("voltage_kv"))


@query(f"SELECT osm_id, {_TYPE.format(n='operator')} AS type FROM substations")
def operator_classify(s):
    return s.substations.select("osm_id", classify.operator_type(F.col("operator")).alias("type"))


@query("SELECT osm_id, CASE osm_id % 5 WHEN 0 THEN 'Amazon Web Services' WHEN 1 THEN 'Reliance Jio' WHEN 2 THEN 'CtrlS Datacenters' WHEN 3 THEN 'NTT' ELSE 'Local Colo' END AS company FROM zones")
def company_classify(s):
    return s.zones.select("osm_id", classify.company(F.lit(None).cast("string"), F.col("operator")).alias("company"))


@query("SELECT osm_id, CASE osm_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE NULL END AS tier FROM zones")
def tier_extract(s):
    return s.zones.select("osm_id", classify.tier(F.col("tier_text"), F.lit(None).cast("string")).alias("tier"))


@query("SELECT osm_id, CASE osm_id % 5 WHEN 0 THEN 'data_center_incentive' WHEN 3 THEN 'data_center_incentive' WHEN 2 THEN 'multi_product' ELSE 'it_services' END AS policy FROM zones")
def sez_policy(s):
    return s.zones.select("osm_id", classify.sez_policy(F.col("name")).alias("policy"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'reservoir' WHEN 1 THEN 'river' WHEN 2 THEN 'pond' ELSE 'lake' END AS kind FROM supplier")
def water_kind(s):
    tags = F.expr("CASE s_suppkey % 4 WHEN 0 THEN map('water', 'reservoir') WHEN 1 THEN map('waterway', 'stream') WHEN 2 THEN map('natural', 'pond', 'waterway', 'river') ELSE map('name', 'x') END")
    return s.supplier.select(F.col("s_suppkey").alias("id"), classify.water_kind(tags).alias("kind"))


@query("SELECT cell_id, n AS name, v AS value FROM (SELECT cell_id, unnest(['nearest_water_km', 'nearest_metro_km']) AS n, unnest([nearest_water_km, nearest_metro_km]) AS v FROM features)")
def cell_compare_unpivot(s):
    return readapi.compare(s.features, ["nearest_water_km", "nearest_metro_km"])


@query("SELECT source, round((epoch_us(TIMESTAMP '2024-02-10 00:00:00') - epoch_us(max(finished_at))) / 8.64e10, 6) AS age_days, (epoch_us(TIMESTAMP '2024-02-10 00:00:00') - epoch_us(max(finished_at))) / 8.64e10 > 14 AS stale FROM runs WHERE status = 'success' GROUP BY source")
def staleness_days(s):
    return readapi.staleness(s.runs, "2024-02-10 00:00:00").withColumn("age_days", r6("age_days"))


@query("SELECT osm_id, round(x1, 6) AS x1, round(y2, 6) AS y2, 2 AS n FROM power_lines")
def wkt_roundtrip(s):
    p = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    rows = s.power_lines.select("osm_id", geo.wkt_points(geo.to_wkt(F.array(p("x1", "y1"), p("x2", "y2")))).alias("p"))
    return rows.select("osm_id", r6(F.col("p")[0]["lon"]).alias("x1"), r6(F.col("p")[1]["lat"]).alias("y2"), F.size("p").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_by_day(s):
    found = incremental.windowed_counts(s.events)
    return found.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


from terravane import catalog_more  # noqa: E402, F401  registers its queries
