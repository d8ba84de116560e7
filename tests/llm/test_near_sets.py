"""The pipeline's near-duplicate stage against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terravane.llm import near_sets

SCHEMA = "doc_id long, text string, key string"


def _sets(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _kept(rows):
    """Smallest doc_id of each component, by all pairs."""
    sets, root = [_sets(t) for _, t, _ in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return sorted(min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root))


def _rows():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(words) for _ in range(30)]
    rows = []
    for _ in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([4, 12, 60, 150]))] + (passage if rnd.random() < 0.4 else [])
        texts = [base]
        for _ in range(rnd.choice([0, 1, 3])):
            w = list(rnd.choice(texts))
            for _ in range(rnd.randrange(1, 2 + len(w) // 40)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(w)
        rows += [" ".join(w) for w in texts]
    base = [rnd.choice(words) for _ in range(100)]
    rows += [" ".join([*base[:k], "edited", *base[k + 1 :]]) for k in range(0, 100, 2)] + [rows[0], rows[0].upper(), "", " \n", None]
    rnd.shuffle(rows)
    return [(k, t, "x") for k, t in enumerate(rows)]


@pytest.mark.parametrize(("rounds", "radius"), [(0, 0), (1, 4), (2, 4)])
def test_keep_one_is_that_of_all_pairs(spark, rounds, radius):
    rows = _rows()
    kept = near_sets.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(4), rounds=rounds, radius=radius)
    assert sorted(r.doc_id for r in kept.collect()) == _kept(rows) and kept.columns == ["doc_id", "text", "key"]


def test_stage_links_at_four_fifths(spark):
    base = [f"a{k}" for k in range(49)]  # 45 shingles; one word changed in the middle: 40 of 50 are shared
    rows = [(1, " ".join(base), "x"), (2, " ".join([*base[:20], "b", *base[21:]]), "x"), (3, " ".join([*base[:20], "c", *base[21:40], "d", *base[41:]]), "x"), (4, " ".join(base[:20]), "x")]
    assert _kept(rows) == [1, 4] or _kept(rows) == [1, 3, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == _kept(rows)


def test_keep_one_rows(spark):
    rows = [(None, "p q r s t u", "x"), (None, "p q r s t u", "y"), (3, "same text here for all", "x"), (3, "same text here for all", "x"), (5, "same text here for all", "z")]
    got = near_sets.keep_one(spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)))
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 3] and got.columns[-1] == "node"
    assert near_sets.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_leaves_one_table_only(spark):
    from pathlib import Path

    from terravane import runtime

    folder = Path(runtime.shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()}
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 3}_{k}" for k in range(40)) + (" more" if i % 3 else "")) for i in range(30)], "doc_id long, text string")
    kept = near_sets.keep_one(docs)
    left = {p.name for p in folder.iterdir()} - before
    assert len(left) == 1 and next(iter(left)).startswith("keep-")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 30, 3))


def test_lean_functions_give_the_same_batches(spark):
    from terravane.runtime import lean

    assert list(lean(lambda batches: (2 * b for b in batches))([1, 2])) == [2, 4]
    assert spark.range(10).mapInArrow(lean(lambda batches: batches), "id long").count() == 10
