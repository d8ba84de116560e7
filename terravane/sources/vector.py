"""Vector sources: Overpass JSON, GeoJSON states, protected areas, curated lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.config import LANDINGS, METROS
from terravane.functions import classify, geo, polygons
from terravane.operators import spatial, upsert

_POINT = "struct<lat:double,lon:double>"
OVERPASS = (
    f"elements array<struct<type:string,id:bigint,lat:double,lon:double,center:{_POINT},geometry:array<{_POINT}>,tags:map<string,string>>>"
)


def overpass(spark: SparkSession, path: str) -> DataFrame:
    """One row per element of saved Overpass responses, with its file and place in it."""
    rows = spark.read.schema(OVERPASS).json(path, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("elements").alias("place", "e"))
    return rows.select("e.*", "file", "place")


def _first(elements: DataFrame) -> DataFrame:
    """One row per type and id: the first in order of file and place, if the frame has them, else the least by all columns."""
    order = [c for c in ("file", "place") if c in elements.columns] or [F.xxhash64(F.to_json(F.struct(*elements.columns)))]
    return upsert.first_kept(elements, ["id"], *order)


def _path() -> Column:
    return F.transform("geometry", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))


def ways_to_lines(elements: DataFrame) -> DataFrame:
    rows = elements.filter((F.col("type") == "way") & (F.size("geometry") >= 2))
    return rows.select(F.col("id").alias("osm_id"), "tags", _path().alias("path"), geo.to_wkt(_path()).alias("wkt"))


def nodes_to_points(elements: DataFrame) -> DataFrame:
    rows = elements.filter("type in ('node', 'way')")
    at = F.when(F.col("type") == "node", F.struct("lon", "lat")).otherwise(F.struct(F.col("center.lon").alias("lon"), F.col("center.lat").alias("lat")))
    rows = rows.select(F.col("id").alias("osm_id"), "tags", at.alias("p")).filter("p.lon is not null and p.lat is not null")
    return rows.select("osm_id", "tags", "p.lon", "p.lat", F.format_string("POINT (%s %s)", F.col("p.lon").cast("string"), F.col("p.lat").cast("string")).alias("wkt"))


def water(elements: DataFrame) -> DataFrame:
    """River ways and open ways are lines, closed ways of four points or more polygons, relations small squares."""
    path, n = _path(), F.size("geometry")
    kind = classify.water_kind(F.col("tags"))
    line, ring = geo.to_wkt(path), geo.to_wkt(path, "POLYGON")
    shut = (n >= 4) & (F.element_at(path, 1) == F.element_at(path, F.when(n > 0, n).otherwise(1)))
    box = geo.to_wkt(geo.square(F.col("center.lon"), F.col("center.lat"), 0.005), "POLYGON")
    way = F.when(n >= 2, F.when(kind == "river", line).when(shut, ring).otherwise(line))
    wkt = F.when(F.col("type") == "way", way).when((F.col("type") == "relation") & F.col("center.lon").isNotNull(), box)
    return elements.select(F.col("id").alias("osm_id"), F.col("tags")["name"].alias("name"), kind.alias("kind"), wkt.alias("wkt")).filter("wkt is not null")


def zones(elements: DataFrame) -> DataFrame:
    """Economic zones: rings are closed, a bare centre becomes a square; the first row of an id stays; valid says that
    no two edges of the ring cross."""
    path, n = _path(), F.size("geometry")
    ring = F.when((F.col("type") == "way") & (n >= 3), geo.closed(path)).when(F.col("center.lon").isNotNull(), geo.square(F.col("center.lon"), F.col("center.lat"), 0.01))
    rows = elements.withColumn("ring", ring).filter("ring is not null")
    rows = _first(rows)
    name = F.col("tags")["name"]
    return rows.select(
        F.col("id").alias("osm_id"), name.alias("name"), classify.sez_policy(name).alias("policy_tag"), "ring", geo.ring_centroid(F.col("ring")).alias("centroid"), geo.to_wkt(F.col("ring"), "POLYGON").alias("wkt"), polygons.is_simple(F.col("ring")).alias("valid")
    )


def power_lines(elements: DataFrame, min_kv: int = 220) -> DataFrame:
    tags = F.col("tags")
    rows = ways_to_lines(elements).select(
        "osm_id", classify.voltage_kv(tags["voltage"]).alias("voltage_kv"), tags["operator"].alias("operator"), tags["circuits"].try_cast("long").alias("circuits"), "path", "wkt"
    )
    return rows.filter(F.col("voltage_kv") >= min_kv)


def highways(elements: DataFrame) -> DataFrame:
    rows = ways_to_lines(elements).select("osm_id", F.col("tags")["ref"].alias("ref"), F.col("tags")["highway"].alias("classification"), "wkt")
    return rows.filter(F.col("classification").isin("motorway", "trunk"))


def railways(elements: DataFrame) -> DataFrame:
    return ways_to_lines(elements).select("osm_id", "wkt")


def data_centers(elements: DataFrame) -> DataFrame:
    t = F.col("tags")
    return nodes_to_points(_first(elements)).select(
        "osm_id", t["name"].alias("name"), classify.company(t["name"], t["operator"]).alias("company"), classify.tier(t["name"], t["tier"]).cast("long").alias("tier"), "lon", "lat", "wkt"
    )


_RING = "array<array<double>>"
GEOJSON = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def _features(spark: SparkSession, path: str) -> DataFrame:
    """(properties, parts) of saved FeatureCollections; a part is a polygon's rings, the shell first."""
    f = spark.read.schema(GEOJSON).json(path, multiLine=True).select(F.explode("features").alias("f"))
    text = F.col("f.geometry.coordinates")
    many = F.from_json(text, f"array<array<{_RING}>>")
    one = F.array(F.from_json(text, f"array<{_RING}>"))
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", many).when(F.col("f.geometry.type") == "Polygon", one)
    ring = lambda r: F.transform(r, lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat")))
    return f.select(F.col("f.properties").alias("properties"), F.transform(parts, lambda p: F.transform(p, ring)).alias("parts"))


def states(spark: SparkSession, path: str, name_key: str = "NAME_1") -> DataFrame:
    """(state_code, rings): the union of each state's polygons, holes kept; an unknown name is an error."""
    f = _features(spark, path)
    name = F.col("properties")[name_key]
    code = F.coalesce(classify.state_code(name), F.raise_error(F.concat(F.lit("no state code for "), F.coalesce(name, F.lit("NULL")))).cast("string"))
    return spatial.dissolve(f.select(code.alias("state_code"), F.explode("parts").alias("rings")))


def protected_areas(df: DataFrame, iso3: str = "IND") -> DataFrame:
    """Rows of one country that have a geometry."""
    return df.filter((F.col("iso3") == iso3) & F.col("wkt").isNotNull() & ~F.col("wkt").rlike(r"(?i)empty"))


def read_protected_areas(spark: SparkSession, path: str, iso3: str = "IND") -> DataFrame:
    """(wdpa_id, name, designation, iucn_cat, wkt) from saved pages of features: one country, empty geometries dropped."""
    p = F.col("properties")
    rings = F.flatten("parts")
    wkt = F.when(F.size(rings) > 0, polygons.rings_wkt(rings))
    rows = _features(spark, path).select(
        F.coalesce(p["wdpaid"], p["wdpa_id"]).try_cast("long").alias("wdpa_id"), p["name"].alias("name"), p["designation"].alias("designation"), p["iucn_cat"].alias("iucn_cat"), F.upper(p["iso3"]).alias("iso3"), wkt.alias("wkt")
    )
    return protected_areas(rows, iso3).drop("iso3")


def metros(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METROS, "name string, population long, state_code string, lon double, lat double")


def landings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANDINGS, "name string, city string, lon double, lat double")


def to_geojson(lines: DataFrame, tolerance: float | None = None) -> DataFrame:
    """One Feature per line (osm_id, path) as text, its path simplified by ``tolerance`` degrees if given."""
    if tolerance:
        lines = lines.withColumn("path", polygons.simplify(F.col("path"), tolerance))
    coords = F.transform("path", lambda p: F.array(p["lon"], p["lat"]))
    shape = F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates"))
    return lines.select("osm_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("osm_id").alias("properties"), shape.alias("geometry"))).alias("feature"))


def feature_collection(lines: DataFrame, limit: int, tolerance: float = 0.005) -> str:
    """A FeatureCollection of the first ``limit`` lines by id, for a map."""
    rows = to_geojson(lines.orderBy("osm_id").limit(limit), tolerance).orderBy("osm_id").collect()
    return '{"type":"FeatureCollection","features":[' + ",".join(r.feature for r in rows) + "]}"
