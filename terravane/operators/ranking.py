"""Ranking: greedy spaced top sites (W02), top-n per group (W03), latest row per group."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.config import EARTH_KM
from terravane.functions import geo
from terravane.runtime import materialize, ship


def _km(lon1, lat1, lon2, lat2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    a += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, a)))


def _greedy(rows: DataFrame, n: int, min_km: float, kind: str, cell: str) -> DataFrame:
    """Sites of each state taken from ``rows`` in their order; a task holds only the taken ones."""
    rows = rows.select("state_code", "cell_id", "score", "lon", "lat").repartition("state_code").sortWithinPartitions("state_code", F.desc("score"), "cell_id")

    def run(batches):
        now, taken = object(), []
        for b in batches:
            out = []
            for s, cell_, score, lon, lat in zip(*(c.to_pylist() for c in b.columns)):
                if s != now:
                    now, taken = s, []
                if len(taken) < n and all(_km(lon, lat, *t) >= min_km for t in taken):
                    taken.append((lon, lat))
                    out.append((s, len(taken), cell_, score, lon, lat))
            cols = list(zip(*out)) or [()] * 6
            types = [b.schema.types[0], pa.int32(), b.schema.types[1], pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], ["state_code", "rank", "cell_id", "score", "lon", "lat"])

    return rows.mapInArrow(run, f"state_code {kind}, rank int, cell_id {cell}, score double, lon double, lat double")


def spaced_top(scores: DataFrame, n: int, min_km: float, state: str = "state_code", head: int = 1000) -> DataFrame:
    """(state_code, rank, cell_id, score, lon, lat): by falling score, at least min_km from all taken so far.

    The greedy scan runs over each state's ``head`` best rows, which Spark picks on the map side. A state that has
    more rows and too few sites then gets one site a round: the best row that is far from all sites so far, again
    by map-side aggregation. So no task reads a whole state, and the result is that of the scan over all rows.
    """
    ship(scores.sparkSession)
    kinds = dict(scores.dtypes)
    rows = scores.select(F.col(state).alias("state_code"), "cell_id", F.col("score").cast("double").alias("score"), "lon", "lat").filter("score is not null")
    order = Window.partitionBy("state_code").orderBy(F.desc("score"), "cell_id")
    best = rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= head).drop("_k")
    sites = materialize(_greedy(best, n, min_km, kinds[state], kinds["cell_id"]), "sites")
    # states whose scan ended with the head, not with the table or the n-th site
    seen = rows.groupBy("state_code").agg(F.count("*").alias("c")).filter(F.col("c") > head)
    short = seen.join(sites.groupBy("state_code").agg(F.count("*").alias("t")), "state_code").filter(F.col("t") < n)
    short = materialize(short.select("state_code"), "short")  # a row for each state at most
    if not short.isEmpty():
        left = rows.join(F.broadcast(short), "state_code", "left_semi")
        for _ in range(n):
            taken = sites.groupBy("state_code").agg(F.collect_list(F.struct("lon", "lat")).alias("_taken"), F.max("rank").alias("_rank"))
            far = lambda t: geo.haversine_km(F.col("lon"), F.col("lat"), t["lon"], t["lat"]) >= min_km
            free = left.join(F.broadcast(taken.filter(F.col("_rank") < n)), "state_code").filter(F.forall("_taken", far))
            value = F.struct((-F.col("score")).alias("o"), "cell_id", "score", "lon", "lat")
            found = free.groupBy("state_code").agg(F.min(value).alias("v"), (F.max("_rank") + 1).alias("rank"))
            found = materialize(found.select("state_code", F.col("rank").cast("int").alias("rank"), "v.cell_id", "v.score", "v.lon", "v.lat"), "sites")
            if found.isEmpty():
                break
            sites = sites.unionByName(found)
    return sites


def top_n(df: DataFrame, by: str, n: int, *order) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def latest(df: DataFrame, by: str, time: str, tie: str) -> DataFrame:
    return top_n(df, by, 1, F.desc_nulls_last(time), F.desc(tie)).drop("rank")
