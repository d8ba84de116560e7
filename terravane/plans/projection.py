"""The graph's node and edge frames, each derived from the base tables (GP1-GP11).

Nodes are (label, key, props), edges (type, src, dst). Everything is a lazy view, so a rebuild is a read, and one run's
part (GP11) is a filter on its id that Catalyst pushes into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import classify
from terravane.operators import governance
from terravane.plans.graph import edges, nodes


def key_of(*parts: str | Column) -> Column:
    """A composite key: the parts joined by two colons; NULL if one is."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    whole = F.lit(True)
    for c in columns:
        whole = whole & c.isNotNull()
    return F.when(whole, F.concat_ws("::", *(c.cast("string") for c in columns)))


def score_key(run: str = "run_id", cell: str = "cell_id", resolution: int = 7) -> Column:
    return key_of(cell, run, F.lit(f"res{resolution}"))


def osm_or_row(osm_id: str, row: str) -> Column:
    """``osm:id`` if there is one, else ``row:number``."""
    return F.coalesce(F.concat(F.lit("osm:"), F.col(osm_id).cast("string")), F.concat(F.lit("row:"), F.col(row).cast("string")))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cells(cells_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State and Cell nodes, IN_STATE."""
    return _all([nodes("State", cells_, "state_code"), nodes("Cell", cells_, "cell_id")]), edges("IN_STATE", cells_, "cell_id", "state_code")


def key_only(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Nodes that are no more than their key: label -> (frame, key column)."""
    return _all([nodes(label, df, key) for label, (df, key) in frames.items()])


def power(lines: DataFrame, substations: DataFrame, connects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line, Substation and SubGrid nodes; IN_SUBGRID of lines, CONNECTS, and IN_SUBGRID of the substations of those lines."""
    grid = lines.filter("subgrid is not null").groupBy("subgrid").agg(F.count("*").alias("n_lines"), F.sum("voltage_kv").alias("total_kv"))
    own = [nodes("Line", lines, "osm_id", voltage_kv="voltage_kv"), nodes("Substation", substations, "osm_id", voltage_kv="voltage_kv"), nodes("SubGrid", grid, "subgrid", n_lines="n_lines", total_kv="total_kv")]
    reached = connects.join(lines.select(F.col("osm_id").alias("line_id"), "subgrid"), "line_id")
    ties = [edges("IN_SUBGRID", lines, "osm_id", "subgrid"), edges("CONNECTS", connects, "sub_id", "line_id"), edges("IN_SUBGRID", reached, "sub_id", "subgrid")]
    return _all(own), _all(ties).distinct()


def lineage(runs: DataFrame, letters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SchemaContract, IngestionRun and RejectedRow nodes; VALIDATED_BY by source, REJECTED_BY by run."""
    contracts = governance.register_contracts(runs.sparkSession)
    rows = letters.withColumn("letter", F.concat(F.lit("dlq:"), F.col("letter_id").cast("string")))
    known = rows.join(runs.select("run_id"), "run_id", "left_semi")
    own = [nodes("SchemaContract", contracts, "schema_hash", source="source"), nodes("IngestionRun", runs, "run_id", source="source", status="status"), nodes("RejectedRow", rows, "letter", source="source")]
    checked = runs.join(F.broadcast(contracts), "source")  # a row for each of the contracts
    return _all(own), _all([edges("VALIDATED_BY", checked, "run_id", "schema_hash"), edges("REJECTED_BY", known, "letter", "run_id")])


def scoring(scores: DataFrame, weights: DataFrame, resolution: int = 7, run_id=None) -> tuple[DataFrame, DataFrame]:
    """ScoringRun, Weight and Score nodes; APPLIES, USES_WEIGHTS, HAS_SCORE, DERIVED_FROM.

    ``weights`` is (run_id, weights map<string,double>): the weights stand one level down in a run's payload. With
    run_id only that run's part.
    """
    if run_id is not None:
        scores, weights = scores.filter(F.col("run_id") == run_id), weights.filter(F.col("run_id") == run_id)
    each = weights.select("run_id", F.explode("weights").alias("criterion", "weight")).withColumn("weight_key", key_of("run_id", "criterion"))
    rows = scores.select("cell_id", "run_id", "score").withColumn("score_key", score_key(resolution=resolution))
    own = [nodes("ScoringRun", scores, "run_id"), nodes("Weight", each, "weight_key", criterion="criterion", weight="weight"), nodes("Score", rows, "score_key", score="score")]
    ties = [edges("APPLIES", each, "run_id", "weight_key"), edges("HAS_SCORE", rows, "cell_id", "score_key"), edges("DERIVED_FROM", rows, "score_key", "run_id")]
    used = rows.select("score_key", "run_id").join(each.select("run_id", "weight_key"), "run_id")
    return _all(own), _all([*ties, edges("USES_WEIGHTS", used, "score_key", "weight_key")])


def stakeholders(lines: DataFrame, substations: DataFrame, zones: DataFrame, centers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operator, SEZ and Hyperscaler nodes; OPERATED_BY from lines, substations and data centres."""
    who = lambda df, name: df.withColumn("who", F.trim(name)).filter("who <> ''")
    sub, line = who(substations, F.col("operator")), who(lines, F.col("operator"))
    named = line.select("who").unionByName(sub.select("who")).distinct().withColumn("kind", classify.operator_type(F.col("who")))
    company = centers.withColumn("who", classify.company(F.col("name"), F.col("operator"))).filter("who is not null")
    own = [nodes("Operator", named, "who", type="kind"), nodes("SEZ", zones, "osm_id", name="name"), nodes("Hyperscaler", company, "who")]
    ties = [edges("OPERATED_BY", line, "osm_id", "who"), edges("OPERATED_BY", sub, "osm_id", "who"), edges("OPERATED_BY", company, "osm_id", "who")]
    return _all(own), _all(ties).distinct()


def companies(centers: DataFrame) -> DataFrame:
    """Distinct companies of data centres (GQ15)."""
    return centers.select(classify.company(F.col("name"), F.col("operator")).alias("company")).filter("company is not null").distinct()


def ask(frames: dict[str, DataFrame], sql: str, limit: int = 100) -> DataFrame:
    """SQL over frames by name, at most ``limit`` rows: the engine's ad-hoc query (GQ13)."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return next(iter(frames.values())).sparkSession.sql(sql).limit(int(limit))
