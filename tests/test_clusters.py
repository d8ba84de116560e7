"""Clusters of segments by distance and the pairs within a cluster, against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from terravane.operators import knn
from terravane.operators.components import smallest_reachable
from terravane.plans import graph

SEGMENTS = "id long, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("eps", [0.05, 0.12, 0.3, 1.7])
def test_epsilon_clusters_are_the_components_of_all_close_pairs(spark, eps):
    rnd = random.Random(8)
    rows = [(0, 0.0, 0.0, 3.0, 3.0), (900, 9.0, 9.0, 9.0, 9.0), (901, 9.0, 9.0, 9.0, 9.0), (902, 9.0, 9.0 + eps, 9.0, 12.0), (903, None, 1.0, 1.0, 1.0), (904, None, 1.0, 1.0, 1.0), (905, float("nan"), 0.0, 0.0, 0.0)]
    for i in range(1, 160):
        x, y = rnd.uniform(0, 8), rnd.uniform(0, 8)
        rows.append((i, x, y, x + rnd.uniform(-0.2, 0.2), y + rnd.choice([0, rnd.uniform(-0.2, 0.2)])))
    df = spark.createDataFrame(rows, SEGMENTS)
    finite = [r[0] for r in rows if r[0] not in (903, 904, 905)]
    links = [(r.a, r.b) for r in knn.within_epsilon(df.filter("id not in (903, 904, 905)"), eps).collect()]
    want = smallest_reachable([*links, *((i, i) for i in finite)])
    assert {r.id: r.cluster for r in knn.epsilon_clusters(df, eps).collect()} == want


def test_pairs_of_one_large_cluster_are_many_tasks_work(spark):
    lines = spark.range(3000).select(F.col("id").alias("osm_id"), F.when(F.col("id") < 2900, 1).when(F.col("id") < 2990, 2).when(F.col("id") < 2996, F.col("id").cast("int")).alias("cluster_id"))
    counts = [r["count"] for r in graph.parallel_pairs(lines).groupBy(F.spark_partition_id()).count().collect()]
    total = 2900 * 2899 // 2 + 90 * 89 // 2
    assert sum(counts) == total and max(counts) < 0.8 * total
    few = lines.filter("osm_id % 29 = 0 or osm_id > 2985")
    rows = [(r.osm_id, r.cluster_id) for r in few.collect()]
    want = {(a, b) for (a, c), (b, d) in itertools.permutations(rows, 2) if c is not None and c == d and a < b}
    for chunk in (7, 2048):
        found = [tuple(r) for r in graph.parallel_pairs(few, chunk=chunk).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert graph.parallel_pairs(lines.filter("cluster_id is null")).count() == 0


def test_pairs_are_made_a_chunk_at_a_time_and_in_order(spark):
    lines = spark.range(500).select(F.col("id").alias("osm_id"), F.lit(1).alias("cluster_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan shows its generated stages only when it has run
    try:
        plan = graph.parallel_pairs(lines, chunk=50)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    stages = re.findall(r"\*\((\d+)\) (?:.* )?Generate explode\([xy]s", plan)
    assert len(stages) == 2 and len(set(stages)) == 2, plan  # in one stage they would hold back the square of a chunk
    firsts = [r.a for part in graph.parallel_pairs(lines, chunk=50).select("a").rdd.glom().collect() for r in part]
    runs = sum(1 for _ in itertools.groupby(firsts))
    assert len(firsts) == 500 * 499 // 2 and runs <= 500 * 10


def test_pairs_of_repeated_and_text_ids(spark):
    ids = [(x, c) for c in ("u", "v", None) for x in "b a c b b b d é a e f b".split()] + [(None, "u")]
    lines = spark.createDataFrame(ids, "osm_id string, cluster_id string")
    want = sorted((a, b) for (a, c), (b, d) in itertools.product(ids, ids) if a and b and c and c == d and a < b)
    for chunk in (1, 3, 5, 2048):
        assert sorted(tuple(r) for r in graph.parallel_pairs(lines, chunk=chunk).collect()) == want
