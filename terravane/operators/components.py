"""Connected components of an edge table.

An edge table whose counted rows are at most ``one_task_rows`` (16 bytes each for long ends) is settled by union-find
in one task. A larger one goes through alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): each round is two group-bys and two equi-joins, so no component is
gathered in one task, and AQE may split a hub's rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.runtime import materialize, ship


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def smallest_reachable(edges) -> dict:
    """node -> smallest node reachable, for an iterable of (a, b) pairs; union by the smaller root, paths halved."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def _in_one_task(ends: DataFrame) -> DataFrame:
    ship(ends.sparkSession)
    kind = ends.schema["a"].dataType.simpleString()

    def run(batches):
        found = smallest_reachable(e for b in batches for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        nodes = list(found)
        for at in range(0, len(nodes), 100_000):
            part = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_pydict({"node": pa.array(part), "component": pa.array([found[x] for x in part])})

    return ends.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, one_task_rows: int = 500_000) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Null ends are ignored; a self-loop makes its node a component of its own.
    """
    if one_task_rows:
        ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
        edges, a, b = materialize(ends, "ends"), "a", "b"
        if edges.count() <= one_task_rows:
            return _in_one_task(edges)
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    star = materialize(
        ends.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = _state(star)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(star)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    linked = star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    loops = ends.filter("a = b").select(F.col("a").alias("node")).distinct()
    alone = loops.join(linked.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return linked.unionByName(alone)
