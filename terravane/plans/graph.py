"""The graph as views: node and edge frames (GP1-GP12) and the pattern queries (GQ1-GQ12) as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.config import REASONS
from terravane.functions import classify, geo
from terravane.runtime import materialize


def nodes(label: str, df: DataFrame, key: str, **props) -> DataFrame:
    """(label, key, props) of distinct non-null keys; of several rows of a key the least properties stay."""
    said = F.to_json(F.struct(*(F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in props.items()))) if props else F.lit("{}")
    rows = df.filter(F.col(key).isNotNull() if isinstance(key, str) else key.isNotNull())
    rows = rows.select((F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), said.alias("props"))
    return rows.groupBy("key").agg(F.min("props").alias("props")).select(F.lit(label).alias("label"), "key", "props")


def edges(kind: str, df: DataFrame, src: str, dst: str) -> DataFrame:
    rows = df.filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    return rows.select(F.lit(kind).alias("type"), F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst")).distinct()


def excluded_by(masked: DataFrame) -> DataFrame:
    known = masked.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    return masked.select("cell_id", F.explode("exclusion_reasons").alias("reason")).join(F.broadcast(known), "reason")


def subgrid_rollup(lines: DataFrame) -> DataFrame:
    return lines.filter("subgrid is not null").groupBy("subgrid").agg(F.count("*").alias("n_lines"), F.sum("voltage_kv").alias("total_kv"))


def parallel_pairs(lines: DataFrame, cluster: str = "cluster_id", chunk: int = 2048) -> DataFrame:
    """(a, b) with a < b: all pairs of lines of one cluster.

    A cluster's ids, in order, are dealt into chunks of at most ``chunk``, and every two chunks of a cluster make a block
    of pairs, so that one large cluster is many tasks' work; a chunk travels packed, as one row. Only numbering the ids is
    one task's work for a cluster, of n rows where its pairs are n * n / 2.

    Generated code holds back every row that it makes of one input row, as a copy each. So the first ids of a block are
    rows before they meet the second ones (the sort of a merge join parts the two steps), and a task holds ``chunk`` pairs
    at a time, not a block of their square. In the order of ids the pairs also pack well: a stays the same for a chunk.
    """
    own = lines.select("osm_id", F.col(cluster).alias("c")).filter("osm_id is not null and c is not null")
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy("osm_id"))).withColumn("n", F.count("*").over(Window.partitionBy("c")))
    dealt = ranked.withColumn("g", F.ceil(F.col("n") / chunk)).withColumn("p", F.expr("(k - 1) * g div n"))
    packed = materialize(dealt.groupBy("c", "g", "p").agg(F.sort_array(F.collect_list("osm_id")).alias("ids")), "chunks")
    blocks = packed.agg(F.coalesce(F.sum(F.col("g") - F.col("p")), F.lit(0)).alias("n")).first().n
    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 16))
    spread = lambda first, last: F.explode(F.sequence(first, last))
    left = packed.select("c", "p", spread(F.col("p"), F.col("g") - 1).alias("q"), F.col("ids").alias("xs")).repartition(tasks, "c", "p", "q")
    right = packed.select("c", F.col("p").alias("q"), spread(F.lit(0).cast("long"), F.col("p")).alias("p"), F.col("ids").alias("ys")).repartition(tasks, "c", "p", "q")
    met = left.select("c", "p", "q", F.explode("xs").alias("a")).join(right.hint("merge"), ["c", "p", "q"])
    return met.select("a", F.explode("ys").alias("b")).filter("a < b")


def operators(lines: DataFrame, substations: DataFrame) -> DataFrame:
    """Distinct trimmed operator names with their type; the substation's kind wins."""
    name = F.trim("operator")
    part = lambda df, kind: df.filter(F.col("operator").isNotNull()).select(name.alias("name"), F.lit(kind).alias("kind")).filter("name <> ''")
    found = part(lines, "line").unionByName(part(substations, "substation")).groupBy("name").agg(F.max("kind").alias("kind"))
    return found.select("name", "kind", classify.operator_type(F.col("name")).alias("type"))


def operated_by(lines: DataFrame) -> DataFrame:
    own = lines.filter(F.trim("operator") != "").select(F.col("osm_id").alias("line_id"), F.trim("operator").alias("operator"))
    return own.withColumn("operator_type", classify.operator_type(F.col("operator")))


def outage_cells(connects, nearest, scores, sub_id, run_id=None) -> DataFrame:
    """Cells whose nearest line connects to a substation; with a run its score, else one row per score."""
    hit = connects.filter(F.col("sub_id") == sub_id).select("line_id").distinct().join(nearest, "line_id")
    own = scores if run_id is None else scores.filter(F.col("run_id") == run_id)
    return hit.join(own.select("cell_id", "run_id", "score"), "cell_id", "left").select("cell_id", "line_id", "km", "score")


def dual_feed_losers(lines, dual, subgrid) -> DataFrame:
    own = lines.filter(F.col("subgrid") == subgrid).select(F.col("osm_id").alias("line_id"))
    return dual.join(own, "line_id").select("cell_id", "line_id", "km")


def operator_concentration(scores, nearest, owned, run_id, top_n=100) -> DataFrame:
    top = scores.filter(F.col("run_id") == run_id).orderBy(F.desc("score"), "cell_id").limit(top_n)
    return top.join(nearest.select("cell_id", "line_id"), "cell_id").join(owned, "line_id").groupBy("operator").agg(F.count("*").alias("n_cells"))


def systemic_substations(connects, nearest, min_affected=25) -> DataFrame:
    met = connects.join(nearest.select("cell_id", "line_id"), "line_id")
    return met.groupBy("sub_id").agg(F.countDistinct("cell_id").alias("affected")).filter(F.col("affected") >= min_affected)


def top_by_operator_type(scores, nearest, owned, run_id, kind, top_n=50, min_score=0.6) -> DataFrame:
    own = scores.filter((F.col("run_id") == run_id) & (F.col("score") >= min_score)).join(nearest.select("cell_id", "line_id"), "cell_id")
    own = own.join(owned.filter(F.col("operator_type") == kind), "line_id")
    return own.select("cell_id", "score", "operator").orderBy(F.desc("score"), "cell_id").limit(top_n)


def distinct_operator_redundancy(scores, nearest, dual, owned, run_id, top_n=20) -> DataFrame:
    first = nearest.select("cell_id", "line_id").join(owned, "line_id").select("cell_id", F.col("operator").alias("primary_operator"))
    second = dual.select("cell_id", "line_id").join(owned, "line_id").select("cell_id", F.col("operator").alias("dual_operator"))
    met = scores.filter(F.col("run_id") == run_id).join(first, "cell_id").join(second, "cell_id").filter("primary_operator <> dual_operator")
    return met.select("cell_id", "score", "primary_operator", "dual_operator").orderBy(F.desc("score"), "cell_id").limit(top_n)


def _near(cells, places, max_km) -> DataFrame:
    """Cells and places of one state within max_km, met on bins of that width: a place is in its bin and the eight around."""
    size = max_km / 111 + 1e-9
    at = lambda c, d=0: F.floor(F.col(c) / size) + d
    around = F.array(*(F.struct(at("lon", i).alias("bx"), at("lat", j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    p = places.withColumn("_bin", F.explode(around)).select("*", "_bin.bx", "_bin.by").drop("_bin").withColumnsRenamed({"lon": "plon", "lat": "plat"})
    km = geo.approx_km(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    binned = cells.withColumns({"bx": at("lon"), "by": at("lat")})
    return binned.join(p, ["state_code", "bx", "by"]).drop("bx", "by").withColumn("km", km).filter(F.col("km") <= max_km)


def near_zones(scores, zones, run_id, max_km=25.0, min_score=0.5) -> DataFrame:
    own = scores.filter((F.col("run_id") == run_id) & (F.col("score") >= min_score))
    tagged = zones.filter(classify.sez_policy(F.col("name")) == "data_center_incentive")
    return _near(own, tagged, max_km).select("cell_id", "osm_id", "km", "score")


def company_neighbourhood(cells, zones, scores, name, max_km=100.0) -> DataFrame:
    own = zones.filter(classify.company(F.lit(None).cast("string"), F.col("operator")) == name).drop("operator")
    met = _near(cells, own, max_km).select("cell_id", "osm_id", "km")
    best = scores.groupBy("cell_id").agg(F.max("score").alias("score"))
    return met.join(best, "cell_id", "left").orderBy(F.desc_nulls_last("score"), "cell_id", "osm_id")


def score_provenance(scores, runs, cell_id) -> DataFrame:
    """A cell's score with its run and the weights of the run as a list of structs."""
    s = scores.filter(F.col("cell_id") == cell_id)
    return s.join(runs, "run_id", "left").groupBy("cell_id", "run_id", "score").agg(F.sort_array(F.collect_list(F.struct("criterion", "weight"))).alias("weights"))


def cell_lineage(edges_: dict[str, DataFrame], runs: DataFrame, cell_id) -> DataFrame:
    """Distinct ingestion runs behind the rows that a cell is tied to."""
    out = None
    for kind, df in edges_.items():
        part = df.filter(F.col("cell_id") == cell_id).select(F.lit(kind).alias("via"), "run_id")
        out = part if out is None else out.unionByName(part)
    return out.distinct().join(runs, "run_id").select("via", "run_id", "source", "finished_at")


def latest_runs(runs: DataFrame) -> DataFrame:
    """All rows that tie for a source's latest finish."""
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("finished_at"))
    return runs.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")


def stats(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))
