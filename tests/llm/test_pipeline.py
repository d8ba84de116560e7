"""The five stages as wired, held against plain Python, and their rows at the edges."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terravane.llm import toxicity
from terravane.runtime import release, shared_dir
from test_llm import _encoding, _lines_left
from test_near_sets import _kept

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.choice([2, 3])))
    words = [word() for _ in range(1500)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts, labels = [], []
    for k in range(260):
        lines = [line(rnd.randrange(12, 30)) for _ in range(rnd.randrange(2, 5))]
        if k % 6 == 0:
            lines[0] += " zonkhead vilekip"
            lines[-1] += " grumblot"
        if k % 9 == 1:
            lines.insert(1, "All rights reserved.")
        texts.append("\n".join(lines))
        if k < 200:
            labels.append((k, int(k % 6 == 0)))
    bench = [" ".join(f"q{k}x{j}" for j in range(14)) for k in range(3)]
    for k in (7, 8, 13):
        texts[k] += f" {bench[k % 3]} end"
    for k in range(20, 40):  # near copies: one long line with a word changed, about 0.9 alike
        w = " ".join(texts[k].split()).split()
        w = w + [rnd.choice(words) for _ in range(60)]
        base = " ".join(w)
        w[len(w) // 2] = "edited"
        w[len(w) // 4] = "another"
        texts[k] = base
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], None, "", " \n ", "All rights reserved.", None]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, "only one without an id here", "en", "s", 3)]
    return rows, labels, [(k, b) for k, b in enumerate(bench)]


def _toxic(rows, labels, threshold=0.3):
    """Rows that stay after the nearest-neighbour votes, by dense vectors; the curve is fitted as the operator does."""
    words = [collections.Counter(re.findall(r"[^\W_]+", (r[1] or "").lower())) for r in rows]
    learnt = {d: y for d, y in labels if zlib.crc32(str(d).encode()) % 4 != 2}
    at = [i for i, r in enumerate(rows) if r[0] in learnt]
    y = np.array([learnt[rows[i][0]] for i in at], float)
    terms = {w: k for k, w in enumerate(sorted({w for i in at for w in words[i]}))}
    count = np.zeros((len(rows), len(terms)))
    for i, c in enumerate(words):
        for w, n in c.items():
            if w in terms:
                count[i, terms[w]] = n
    df, own = (count > 0).sum(0), count[at] > 0
    pos, neg, n1, n0 = own[y == 1].sum(0), own[y == 0].sum(0), y.sum(), (1 - y).sum()
    p = (pos + neg) / (n0 + n1)
    z = np.maximum(0, (pos / n1 - neg / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12))
    weight = (np.log((1 + len(rows)) / (1 + df)) + 1) * (z * z / (z * z + 100) + 0.01)
    vec = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * weight
    norm = np.linalg.norm(vec, axis=1, keepdims=True)
    vec = vec / np.where(norm == 0, 1, norm)

    def share(v, skip=None):
        cos = np.round(vec[at] @ v, 9)
        if skip is not None:
            cos[skip] = 0
        bar = max(np.sort(cos)[-15], 1e-9)
        above, tied = cos > bar, cos == bar
        part = above + tied * min(1.0, (15 - above.sum()) / max(1, tied.sum()))
        return ((part * cos * y).sum() + n1 / (n0 + n1)) / ((part * cos).sum() + 1)

    a, b = toxicity.platt(np.array([share(vec[i], k) for k, i in enumerate(at)]), y, np.ones(len(y)))
    score = [1 / (1 + np.exp(-(a * toxicity._logit(share(v)) + b))) for v in vec]
    return [r for r, s in zip(rows, score) if s < threshold]


def _windows(text, n=10):
    w = re.findall(r"[a-z0-9]+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(max(0, len(w) - n + 1))}


def test_run_against_plain_python(spark, tmp_path):
    rows, labels, bench = _corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = _toxic(rows, labels)
    assert len(rows) - len(left) >= 30 and all(not (r[1] or "").count("zonkhead") for r in left)
    texts, _ = _lines_left([(r[0], r[1], "") for r in left])
    now = [(r[0], texts[r[0]], r) for r in left]
    now = [(d, t) for d, t, r in now if t == r[1] or (t is not None and re.search(r"[^\x20\x09-\x0D]", t))]
    keep = set(_kept([(10**9 if d is None else d, t, "") for d, t in now]))
    after_near = [(d, t) for d, t in now if (10**9 if d is None else d) in keep]
    assert len(now) - len(after_near) >= 10
    bad = set().union(*(_windows(t) for _, t in bench))
    final = [(d, t) for d, t in after_near if not _windows(t) & bad]
    assert len(after_near) - len(final) == 3
    _, _, enc = _encoding()
    want = sorted((str(d), enc.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in final)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), list(r.ids), r.decoded_sha256) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)


@pytest.mark.parametrize("k", range(5))
def test_stage_rows(spark, tmp_path, k):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0), (None, "a b c d e f g", None, "s", 13), (None, "a b c d e f g", None, "s", 13), (3, "word " * 30_000, "en", "s", 150_000), (4, "x", "en", "s", 1), (5, "Été \U0001f600", "fr", "s", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, "never said here by anyone")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    found = out.collect()
    ids = collections.Counter(r.doc_id for r in found)
    assert ids[3] == ids[4] == ids[5] == 1 and 1 <= ids[1] <= 2
    if k < 4:
        assert out.columns == docs.columns
    more = docs.withColumn("score", F.lit("s")).withColumn("node", F.lit(1)).withColumn("t", F.lit(2)).withColumn("_key", F.lit(3)).withColumn("c0", F.lit(4))
    wide = stage(spark, more, str(tmp_path))
    assert wide.count() == len(found) and (k == 4 or wide.columns == more.columns)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_release_deletes_what_was_written(spark):
    from pathlib import Path

    from terravane.runtime import materialize

    release(spark)
    folder = Path(shared_dir(spark))
    materialize(spark.range(3), "gone")
    assert list(folder.glob("gone-*")) and release(spark) == 1 and not list(folder.glob("gone-*"))
