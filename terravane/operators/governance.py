"""Source contracts, clean/reject split, data-quality checks, run records and the skip guard (Q01-Q12)."""

from __future__ import annotations

import contextlib
import datetime as dt
import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.operators.ranking import latest


@dataclass(frozen=True)
class Rule:
    """A column of a contract: type, whether NULL is allowed, and a range or a set of values."""

    name: str
    kind: str = "string"
    nullable: bool = True
    low: float | None = None
    high: float | None = None
    among: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contract:
    name: str
    rules: tuple[Rule, ...]

    def digest(self) -> str:
        """SHA-256 of the columns' types and nullability; value checks are not part of it."""
        columns = {r.name: {"dtype": r.kind, "nullable": r.nullable} for r in self.rules}
        return hashlib.sha256(json.dumps({"columns": columns, "strict": False}, sort_keys=True).encode()).hexdigest()


def _c(name: str, *rules: Rule) -> Contract:
    return Contract(name, rules)


_OSM, _WKT = Rule("osm_id", "long"), Rule("wkt", nullable=False)
_H3 = Rule("h3_id", nullable=False)
_pct = lambda n: Rule(n, "double", low=0, high=100)
_PLACE = (Rule("lon", "double", False, 68, 97.5), Rule("lat", "double", False, 6.5, 37.5))
# fixed values: bounds and vocabularies of the sources
CONTRACTS = {
    c.name: c
    for c in (
        _c("osm.power_lines", _OSM, Rule("voltage_kv", "int", False, 220), Rule("operator"), Rule("circuits", "long"), _WKT),
        _c("osm.substations", _OSM, Rule("name"), Rule("voltage_kv", "long", True, 66), Rule("operator"), _WKT),
        _c("osm.highways", _OSM, Rule("ref"), Rule("classification", nullable=False, among=("motorway", "trunk")), _WKT),
        _c("osm.railways", _OSM, _WKT),
        _c("osm.water_bodies", _OSM, Rule("name"), Rule("kind", nullable=False, among=("river", "lake", "reservoir", "pond")), _WKT),
        _c("wdpa", Rule("wdpa_id", "long"), Rule("name"), Rule("designation"), Rule("iucn_cat"), _WKT),
        _c("osm.sez", _OSM, Rule("name"), Rule("policy_tag"), _WKT),
        _c("osm.data_centers", _OSM, Rule("name"), Rule("company"), Rule("tier", "long", True, 1, 4), _WKT),
        _c("static.cable_landings", Rule("name", nullable=False), Rule("city"), *_PLACE),
        _c("static.metros", Rule("name", nullable=False), Rule("population", "long", False, 100000), Rule("state_code"), *_PLACE),
        _c("gee.seismic", _H3, Rule("pga_g", "double", True, 0, 2)),
        _c("gee.flood", _H3, _pct("occurrence_pct"), Rule("seasonality", "double")),
        _c("gee.slope", _H3, *(Rule(f"{k}_slope_deg", "double", True, 0, 90) for k in ("mean", "max", "p95"))),
        _c("gee.landcover", _H3, *(_pct(f"{k}_pct") for k in ("forest", "cropland", "urban", "water", "bareland", "wetland"))),
        _c("gee.solar", _H3, Rule("pvout_kwh_per_kwp", "double", True, 400, 2500), Rule("ghi_kwh_per_m2", "double")),
        _c("gee.climate", _H3, Rule("mean_temp_c", "double", True, -30, 50), _pct("mean_rh_pct")),
        _c("gee.population", _H3, Rule("pop_total", "double", True, 0), Rule("pop_density_per_km2", "double", True, 0)),
    )
}


def _errors(contract: Contract) -> Column:
    found = []
    for r in contract.rules:
        raw = F.col(r.name)
        value = raw.cast("string").try_cast(r.kind)
        if r.kind == "double":
            value = F.when(F.isnan(value), None).otherwise(value)
            absent = raw.isNull() | F.coalesce(F.isnan(raw.cast("string").try_cast("double")), F.lit(False))
        else:
            absent = raw.isNull()
        checks = [("type", ~absent & value.isNull())]
        if not r.nullable:
            checks.append(("null", absent))
        if r.low is not None:
            checks.append(("low", value < r.low))
        if r.high is not None:
            checks.append(("high", value > r.high))
        if r.among:
            checks.append(("among", ~value.isin(*r.among)))
        found += [F.when(F.coalesce(c, F.lit(False)), F.lit(f"{r.name}:{k}")) for k, c in checks]
    return F.array_compact(F.array(*found))


def _finite(df: DataFrame, name: str) -> Column:
    """The column, with NaN and the infinities as NULL, which JSON cannot say."""
    c = F.col(name)
    if df.schema[name].dataType.simpleString() not in ("double", "float"):
        return c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)


def split(df: DataFrame, contract: Contract, run_id: str = "", source: str = "") -> tuple[DataFrame, DataFrame]:
    """(clean rows, coerced; rejects as dead letters with all failures and the row as it was).

    A column that the contract names and the frame lacks is an error of the frame, not of a row.
    """
    missing = [r.name for r in contract.rules if r.name not in df.columns]
    if missing:
        raise ValueError(f"{contract.name}: missing columns {missing}")
    marked = df.withColumn("_errors", _errors(contract))
    clean = marked.filter(F.size("_errors") == 0).drop("_errors")
    clean = clean.withColumns({r.name: F.col(r.name).cast("string").try_cast(r.kind) for r in contract.rules if r.kind != "string"})
    letters = marked.filter(F.size("_errors") > 0).select(
        F.lit(run_id).alias("run_id"),
        F.lit(source or contract.name).alias("source"),
        F.to_json(F.struct(*(_finite(df, c) for c in df.columns)), {"ignoreNullFields": "false"}).alias("payload"),
        F.substring(F.array_join("_errors", "; "), 1, 2000).alias("error"),
    )
    return clean, letters


def schema_of(contract: Contract) -> T.StructType:
    """The contract's columns as a table schema."""
    return T.StructType([T.StructField(r.name, T._parse_datatype_string(r.kind), r.nullable) for r in contract.rules])


def register_contracts(spark: SparkSession) -> DataFrame:
    rows = [(c.name, 1, c.digest()) for c in CONTRACTS.values()]
    return spark.createDataFrame(rows, "source string, version int, schema_hash string")


def _check(name: str, subject: str, severity: Column, passed: Column, observed: Column) -> list[Column]:
    return [F.lit(name).alias("check_name"), F.lit(subject).alias("subject"), severity.alias("severity"), passed.alias("passed"), observed.cast("long").alias("observed")]


def row_bounds(df: DataFrame | None, subject: str, low: int, high: int, spark: SparkSession | None = None) -> DataFrame:
    """A missing table counts -1 and fails."""
    if df is None:
        n = spark.range(1).select(F.lit(-1).alias("n"))
    else:
        n = df.agg(F.count("*").alias("n"))
    return n.select(*_check("row_count", subject, F.lit("warn"), F.col("n").between(low, high), F.col("n")))


def null_geometry(df: DataFrame | None, subject: str, column: str = "wkt", spark: SparkSession | None = None) -> DataFrame:
    """Rows without a geometry; a missing table counts -1 and fails, as information."""
    if df is None:
        n = spark.range(1).select(F.lit(-1).alias("n"))
        return n.select(*_check("null_geometry", subject, F.lit("info"), F.lit(False), F.col("n")))
    n = df.agg(F.count_if(F.col(column).isNull()).alias("n"))
    return n.select(*_check("null_geometry", subject, F.when(F.col("n") > 0, "error").otherwise("info"), F.col("n") == 0, F.col("n")))


def schema_hash_check(registered: DataFrame) -> DataFrame:
    spark = registered.sparkSession
    now = register_contracts(spark).select("source", F.col("schema_hash").alias("_now"))
    same = registered.join(now, "source", "full_outer").select("source", F.col("schema_hash").eqNullSafe(F.col("_now")).alias("passed"))
    return same.select(F.lit("schema_hash").alias("check_name"), F.col("source").alias("subject"), F.lit("warn").alias("severity"), "passed", (~F.col("passed")).cast("long").alias("observed"))


def dlq_volume(runs: DataFrame, letters: DataFrame, limit: int = 1000) -> DataFrame:
    """Dead letters of each source's latest successful run; sources without any pass silently."""
    last = latest(runs.filter("status = 'success'"), "source", "finished_at", "run_id").select("run_id", "source")
    n = last.join(letters.select("run_id", "source"), ["run_id", "source"]).groupBy("source", "run_id").agg(F.count("*").alias("rejected"))
    return n.withColumn("passed", F.col("rejected") < limit)


def summarise(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("errors"),
        F.count_if(~F.col("passed") & (F.col("severity") == "warn")).alias("warnings"),
    )


def recent_success(runs: DataFrame, cutoff) -> DataFrame:
    return runs.filter((F.col("status") == "success") & (F.col("finished_at") > F.lit(cutoff)))


def should_skip(runs: DataFrame, source: str, resolution: int | None, now: dt.datetime, ttl_hours: float = 24, fresh: bool = False) -> str | None:
    """Id of a successful run of the same source and resolution within the time to live; None to go on."""
    if fresh:
        return None
    found = recent_success(runs, now - dt.timedelta(hours=ttl_hours)).filter(F.col("source") == source)
    if "resolution" in runs.columns:
        found = found.filter(F.col("resolution").eqNullSafe(F.lit(resolution)))
    row = found.orderBy(F.desc("finished_at"), F.desc("run_id")).first()
    return row and str(row.run_id)


@contextlib.contextmanager
def ingestion_run(source: str, rows: list, resolution: int | None = None):
    """Appends a record to ``rows``: running, then success or failed with counts, notes and duration."""
    record = {"run_id": str(uuid.uuid4()), "source": source, "resolution": resolution, "status": "running", "started_at": dt.datetime.now(dt.timezone.utc), "row_count": 0, "notes": ""}
    rows.append(record)
    try:
        yield record
        record["status"] = "success"
    except Exception as x:
        record["status"], record["notes"] = "failed", str(x)[:1000]
        raise
    finally:
        record["finished_at"] = dt.datetime.now(dt.timezone.utc)
        record["duration_s"] = (record["finished_at"] - record["started_at"]).total_seconds()


def parity(left: DataFrame, right: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Drift of (entity, n) counts: over ``tolerance`` of the left count, which counts as 1 at least."""
    j = left.withColumnRenamed("n", "n_left").join(right.withColumnRenamed("n", "n_right"), "entity", "full_outer").fillna(0, ["n_left", "n_right"])
    gap = F.abs(F.col("n_right") - F.col("n_left")) / F.greatest(F.col("n_left"), F.lit(1))
    return j.withColumn("drift", gap > tolerance)
