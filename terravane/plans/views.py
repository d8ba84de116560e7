"""Views that give the generic tables the shape of the siting model; one SQL text for Spark and other engines.

Coordinates are spread over the box lon 68..97.5, lat 6.5..37.5 by multiples of the keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]

_X = "CAST(({k} * {m}) % 29500 AS DOUBLE) / 1000 + 68"
_Y = "CAST(({k} * {m}) % 31000 AS DOUBLE) / 1000 + CAST(6.5 AS DOUBLE)"
_mod = lambda k, m, n, d=1: f"CAST(({k} * {m}) % {n} AS DOUBLE) / {d}"

VIEWS = {
    "cells": f"SELECT c_custkey AS cell_id, n_name AS state_code, {_X.format(k='c_custkey', m=7919)} AS lon, {_Y.format(k='c_custkey', m=10473)} AS lat FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "power_lines": f"""SELECT p_partkey AS osm_id, nullif(p_size % 8, 7) AS subgrid, CASE p_partkey % 4 WHEN 0 THEN 220 WHEN 1 THEN 400 WHEN 2 THEN 765 ELSE 110 END AS voltage_kv,
      CASE p_size % 5 WHEN 0 THEN 'POWERGRID ' WHEN 1 THEN 'KPTCL ' WHEN 2 THEN 'Tata Power ' WHEN 3 THEN '' ELSE 'Adani ' END || p_brand AS operator,
      {_X.format(k='p_partkey', m=3571)} AS x1, {_Y.format(k='p_partkey', m=6007)} AS y1,
      {_X.format(k='p_partkey', m=3571)} + {_mod('p_partkey', 37, 600, 1000)} - CAST(0.3 AS DOUBLE) AS x2, {_Y.format(k='p_partkey', m=6007)} + {_mod('p_partkey', 53, 600, 1000)} - CAST(0.3 AS DOUBLE) AS y2
      FROM part WHERE p_partkey % 10 = 0""",
    "substations": f"""SELECT s_suppkey AS osm_id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 220 WHEN 1 THEN 400 WHEN 2 THEN 765 ELSE 800 END AS voltage_kv,
      CASE s_suppkey % 4 WHEN 0 THEN 'NTPC Ltd' WHEN 1 THEN 'MahaTransco' WHEN 2 THEN 'Sterlite Grid' ELSE ' ' END AS operator,
      {_X.format(k='s_suppkey', m=4001)} AS lon, {_Y.format(k='s_suppkey', m=7013)} AS lat FROM supplier""",
    "line_ends": """SELECT osm_id * 2 AS left_id, x1 + CAST(0.004 AS DOUBLE) AS lon, y1 AS lat FROM power_lines UNION ALL SELECT osm_id * 2 + 1 AS left_id, x2 AS lon, y2 AS lat FROM power_lines""",
    "snap_points": """SELECT osm_id AS right_id, x1 AS lon, y1 AS lat FROM power_lines WHERE osm_id % 20 = 0 UNION ALL SELECT osm_id + 1 AS right_id, x2 - CAST(0.003 AS DOUBLE) AS lon, y2 AS lat FROM power_lines WHERE osm_id % 30 = 0""",
    "water": f"SELECT s_suppkey AS target_id, {_X.format(k='s_suppkey', m=9001)} AS lon, {_Y.format(k='s_suppkey', m=5003)} AS lat FROM supplier WHERE s_suppkey % 2 = 0",
    "highways": f"SELECT s_suppkey AS target_id, {_X.format(k='s_suppkey', m=8009)} AS lon, {_Y.format(k='s_suppkey', m=3001)} AS lat FROM supplier WHERE s_suppkey % 3 = 0",
    "zones": f"""SELECT s_suppkey AS osm_id, CASE s_suppkey % 5 WHEN 0 THEN 'Data Center Park ' WHEN 1 THEN 'Software City ' WHEN 2 THEN 'Textile Zone ' WHEN 3 THEN 'Cloud Valley ' ELSE 'IT Hub ' END || s_name AS name,
      CASE s_suppkey % 4 WHEN 0 THEN 'Tier-III Data Center' WHEN 1 THEN 'Tier 4 facility' WHEN 2 THEN 'tier ii hall' ELSE 'hall' END AS tier_text,
      CASE s_suppkey % 5 WHEN 0 THEN 'AWS South' WHEN 1 THEN 'Reliance Jio' WHEN 2 THEN 'Ctrl-S' WHEN 3 THEN 'NTT' ELSE 'Local Colo' END AS operator,
      {_X.format(k='s_suppkey', m=2003)} AS lon, {_Y.format(k='s_suppkey', m=1009)} AS lat, n_name AS state_code FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "seismic": f"SELECT c_custkey AS cell_id, {_mod('c_custkey', 31, 50, 100)} AS pga_g, {_mod('c_custkey', 31, 50, 100)} > CAST(0.36 AS DOUBLE) AS in_zone_v FROM customer WHERE c_custkey % 11 <> 0",
    "flood": f"SELECT c_custkey AS cell_id, {_mod('c_custkey', 17, 40)} AS flood_pct FROM customer WHERE c_custkey % 13 <> 0",
    "slope": f"SELECT c_custkey AS cell_id, {_mod('c_custkey', 7, 13)} AS slope_deg FROM customer WHERE c_custkey % 17 <> 0",
    "landcover": f"SELECT c_custkey AS cell_id, {_mod('c_custkey', 23, 80)} AS urban_pct, {_mod('c_custkey', 29, 75)} AS forest_pct, {_mod('c_custkey', 41, 35)} AS wetland_pct, {_mod('c_custkey', 43, 60)} AS water_pct FROM customer WHERE c_custkey % 19 <> 0",
    "protected": "SELECT r_regionkey AS osm_id, CAST(70 + r_regionkey * 5 AS DOUBLE) AS x_lo, CAST(10 + r_regionkey * 4 AS DOUBLE) AS y_lo, CAST(72 + r_regionkey * 5 AS DOUBLE) AS x_hi, CAST(13 + r_regionkey * 4 AS DOUBLE) AS y_hi FROM region",
    "solar": f"SELECT c_custkey AS cell_id, {_mod('c_custkey', 97, 900)} + 1000 AS annual_pvout_kwh_per_kwp, {_mod('c_custkey', 89, 700)} + 1500 AS ghi FROM customer WHERE c_custkey % 7 <> 0",
    "climate": f"SELECT c_custkey AS cell_id, {_mod('c_custkey', 13, 30)} + 12 AS mean_temp_c, {_mod('c_custkey', 19, 100)} AS mean_rh_pct FROM customer WHERE c_custkey % 5 <> 0",
    "population": f"SELECT c_custkey AS cell_id, {_mod('c_custkey', 71, 10000)} AS pop_total FROM customer WHERE c_custkey % 3 <> 0",
    "features": f"""SELECT c.cell_id, c.state_code, c.lon, c.lat, CASE WHEN c.cell_id % 23 = 0 THEN NULL ELSE {_mod('c.cell_id', 3, 97)} END AS nearest_hv_line_km,
      CASE WHEN c.cell_id % 29 = 0 THEN NULL ELSE {_mod('c.cell_id', 11, 201)} END AS nearest_hv_line_distinct_subgrid_km, {_mod('c.cell_id', 5, 61)} AS nearest_water_km,
      {_mod('c.cell_id', 9, 41)} AS nearest_highway_km, {_mod('c.cell_id', 14, 450)} AS nearest_metro_km, {_mod('c.cell_id', 15, 499)} AS nearest_cable_landing_km,
      s.annual_pvout_kwh_per_kwp, t.mean_temp_c, c.cell_id % 6 = 0 AS is_excluded FROM cells c LEFT JOIN solar s ON s.cell_id = c.cell_id LEFT JOIN climate t ON t.cell_id = c.cell_id""",
    "scores": f"SELECT cell_id, state_code, lon, lat, is_excluded, CAST(cell_id % 2 AS INT) AS run_id, {_mod('cell_id', 7907, 1001, 1000)} AS score FROM features",
    "pixels": f"""SELECT o_custkey AS cell_id, CAST(l_quantity AS INT) % 10 * 10 AS code, l_extendedprice / 997 AS value, l_discount * 1000 - 10 AS occurrence, l_tax * 10 AS seasonality,
      290 + l_quantity / 5 AS temp_k, 285 + l_quantity / 10 AS dew_k, l_extendedprice * 1003.7 AS monthly_j_m2, l_discount * 20 AS pga FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "runs": "SELECT event_id AS run_id, event_type AS source, CASE event_id % 3 WHEN 0 THEN 'failed' ELSE 'success' END AS status, ts AS finished_at, user_id AS row_count FROM events",
    "letters": "SELECT event_id AS run_id, event_type AS source, props AS payload, event_id * 4 + k AS letter_id FROM events CROSS JOIN (VALUES (0), (1), (2)) AS v(k) WHERE k < event_id % 4",
    "connects": "SELECT DISTINCT l_partkey - l_partkey % 10 AS line_id, l_suppkey AS sub_id FROM lineitem WHERE l_partkey >= 10",
    "nearest_line": f"SELECT cell_id, cell_id % 19 * 10 AS line_id, {_mod('cell_id', 3, 97)} AS km FROM cells",
    "dual_line": f"SELECT cell_id, cell_id % 17 * 10 AS line_id, {_mod('cell_id', 11, 201)} AS km FROM cells WHERE cell_id % 9 <> 0",
}

_ORDER = list(VIEWS)


def _needed(text: str, found: set[str]) -> None:
    for name in set(re.findall(r"[a-z_]+", text)) & set(VIEWS):
        if name not in found and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
            found.add(name)
            _needed(VIEWS[name], found)


def with_views(sql: str) -> str:
    """``sql`` with the views it reads as common table expressions in front."""
    found: set[str] = set()
    _needed(sql, found)
    own = [f"{n} AS ({VIEWS[n]})" for n in _ORDER if n in found]
    head, recursive = sql.lstrip(), ""
    if head[:4].upper() == "WITH":
        head = head[4:].lstrip()
        if head[:9].upper() == "RECURSIVE":
            head, recursive = head[9:].lstrip(), "RECURSIVE "
        return f"WITH {recursive}{', '.join([*own, head])}"
    return f"WITH {', '.join(own)} {head}" if own else head


def register(spark: SparkSession, sf_dir: str, names: list[str] = BASE) -> None:
    """Temporary views of the base tables; a table's footer is read once per session and folder."""
    known = spark.__dict__.setdefault("_terravane_tables", {})
    for t in names:
        path = f"{sf_dir}/{t}.parquet"
        if path not in known:
            known[path] = spark.read.parquet(path)
        known[path].createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = with_views(f"SELECT * FROM {name}")
    register(spark, sf_dir, [t for t in BASE if re.search(rf"\b{t}\b", text)])
    return spark.sql(text)
