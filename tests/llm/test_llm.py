"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge rows."""

import base64
import collections
import hashlib
import html
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.llm import bpe, decontaminate, html_extract, induced, line_dedup, quality, queries, sharding, simhash, suffix_dedup, toxicity, url_filter

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
EDGE = [(1, None, "x"), (2, "", "x"), (None, "a b c d e f g", "y"), (3, "same text here for all", "y"), (3, "same text here for all", "y"), (4, "word " * 30000, "z"), (5, "Été \U0001f600\n\nend", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def edge(spark, rows=None):
    """Rows with nulls, copies, a long text and extra columns whose names operators use themselves."""
    return spark.createDataFrame(EDGE if rows is None else rows, "doc_id long, text string, key string").withColumn("fp", F.lit(1)).withColumn("score", F.lit("s"))


def test_vantage_search_misses_no_pair():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 300, np.uint64)
    near = base.copy()
    for k in range(300):
        for bit in rnd.choice(64, int(rnd.integers(0, 6)), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    fps = np.unique(np.concatenate([base, near]))
    trees = simhash.build_router(fps[::5], 3, 3)
    shards, blocks = {}, {}

    def leaves(node, k):
        if isinstance(node, int):
            blocks[node] = simhash._blocks(3)[k]
        else:
            leaves(node[2], k)
            leaves(node[3], k)

    for k, t in enumerate(trees):
        leaves(t, k)
    links = set()
    for shard, rows, home in simhash.route(fps, trees, 4):
        (a, b), own = simhash.shard_links(fps[rows[home]], fps[rows], blocks[shard], 1, 4, leaf=8)
        links |= {(int(own[x]), int(own[y])) for x, y in zip(a, b)}
    at = {int(f): i for i, f in enumerate(fps)}
    a, b = (np.array([at[x[k]] for x in links], int) for k in (0, 1))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert (simhash._roots(len(fps), a, b) == simhash._roots(len(fps), i, j)).all()


@needs_tables
def test_simhash(spark, docs, texts):
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    fps = np.array([found[i].fp for i in ids], np.int64).view(np.uint64)
    for i in ids[:20]:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), texts[i].encode()))
        shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        import xxhash

        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert int(np.int64(found[i].fp).view(np.uint64)) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    roots = simhash._roots(len(ids), a, b)
    assert [found[i].component_id for i in ids] == [ids[k] for k in roots]
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({ids[k] for k in roots}) and kept.columns == docs.columns


def test_simhash_edges(spark):
    rows = simhash.near_duplicates(edge(spark)).collect()
    assert len(rows) == len(EDGE) and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert simhash.keep_one(edge(spark)).filter("doc_id = 3").count() == 1
    assert simhash.near_duplicates(edge(spark, [])).count() == 0


def test_url_filter(spark):
    urls = ["https://www.Example.COM/en/76?x", "http://a.example.com/en/1", "http://x.net/de/8", "http://example.net/de/88#a", "nourl", None, "http://cheap-casino.example.org/en/1", "http://thereon.example.org/en/1", "https://h.org"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("www.example.com", "/en/76", "example.com/en/7", "allow")
    assert [got[k].verdict for k in range(9)] == ["allow", "block", "allow", "block", "allow", "allow", "block", "allow", "allow"]
    assert got[3].rule == "example.net/de/8" and got[4].host == got[5].host == "" and got[8].path == ""


@needs_tables
def test_html_extract(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html_of = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", html_of[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<(?:b|br)>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_html_edges_and_min_cut():
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<script>x</script><!-- y") == ""
    page = "<nav><a href=x>home</a></nav><article><h1>T &amp; U</h1><p>One\n two <b>three</b> four five six seven.<form><p>your name</p></form><p>Next.</p><div class='comments'><p>first comment!</p></div></article>"
    assert html_extract.main_text(page) == "T & U\n\nOne two three four five six seven.\n\nNext."
    rnd = random.Random(2)
    for _ in range(60):
        n = rnd.randrange(1, 8)
        gain = [rnd.choice([-1, 1]) * rnd.randrange(1, 9) for _ in range(n)]
        edges = [(a, b, rnd.randrange(1, 6)) for a in range(n) for b in range(a) if rnd.random() < 0.5]
        cost = lambda x: sum(abs(g) for g, y in zip(gain, x) if (g > 0) != y) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: B023, E731
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_extract.min_cut(gain, edges)) == best


def test_sharding(spark):
    names = sharding.shard_names(7)
    table = sharding.lookup_table(names, 1009)
    count = collections.Counter(table)
    assert max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(7))
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 1009 * 0.2
    rows = sharding.assign(edge(spark).withColumn("slot", F.lit("old")), "doc_id", names, 1009).collect()
    for r in rows:
        slot = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % 1009
        assert r.slot == slot and r.shard == names[table[slot]]
    assert len(rows) == len(EDGE) and sharding.assign(edge(spark, []), "doc_id", names, 1009).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


@pytest.mark.parametrize("bounds", [{}, {"max_table": 16, "broadcast_bytes": 0}])
def test_decontamination(spark, bounds):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, item), (2, "Alpha, beta!"), (3, None), (None, "lonely item")], "item_id long, text string")
    rows = [(1, f"x {item.upper()} y", "a"), (2, "ALPHA beta alpha-beta", "a"), (3, None, "a"), (3, "clean text", "a"), (None, "a lonely item", "a"), (5, "one two three", "a")]
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids), r.contaminated) for r in decontaminate.contamination(edge(spark, rows), items, **bounds).collect()]
    want = [(1, 13, 11, 1, "1", True), (2, 4, 4, 1, "2", True), (3, 0, 0, 0, "", False), (3, 2, 0, 0, "", False), (None, 3, 2, 0, "", True), (5, 3, 0, 0, "", False)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = decontaminate.drop_contaminated(edge(spark, rows), items, **bounds)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "5"]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(edge(spark, rows), items, **bounds).collect()}
    assert cut[1].split() == ["x", "y"] and cut[5] == "one two three" and cut[2].strip() == "-"
    assert decontaminate.contamination(edge(spark, []), items).count() == 0 and decontaminate.contamination(edge(spark, rows), items.limit(0)).filter("contaminated").count() == 0


@needs_tables
def test_decontamination_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.op5_decontaminate(spark, SF)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLE_SQL['op5_decontaminate']})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def _spans(data: list[bytes], length: int):
    seen = collections.Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    for t in data:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        yield len(t), int(cover.sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~cover])).hexdigest()


@pytest.mark.parametrize(("shard_bytes", "hot_bytes"), [(1 << 20, 1 << 20), (64, 1 << 20), (64, 150), (64, 0)])
def test_suffix_dedup(spark, shard_bytes, hot_bytes):
    rnd = random.Random(4)
    part = ["".join(rnd.choice("abé ") for _ in range(rnd.randrange(20, 90))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(part) if rnd.random() < 0.6 else rnd.choice("xyz") * rnd.randrange(1, 60) for _ in range(6)), "k") for i in range(60)]
    rows += [(99, None, "k"), (99, "", "k"), (100, rows[0][1], "k"), (None, "q" * 200, "k")]
    found = suffix_dedup.duplicate_spans(edge(spark, rows), length=40, shard_bytes=shard_bytes, hot_bytes=hot_bytes)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in found.collect())
    want = sorted((str(d), *x) for (d, *_), x in zip(rows, _spans([(t or "").encode() for _, t, _ in rows], 40)))
    assert got == want


@needs_tables
def test_suffix_dedup_over_whole_tables(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in queries.op6_suffix_dedup(spark, SF).collect()}
    ids = sorted(texts)
    assert got == dict(zip(ids, _spans([texts[d].encode() for d in ids], 400)))


@pytest.mark.parametrize(("base", "queue_bytes"), [(1 << 20, 1 << 20), (1, 1 << 20), (3, 64)])
def test_induced_sorting_finds_repeats(tmp_path, base, queue_bytes):
    """Small alphabets, runs, zero bytes; recursion from one name up and queues that go to disk at 64 bytes."""
    rnd = random.Random(base + queue_bytes)
    for _ in range(250):
        part = [bytes(rnd.choice([0, 97, 98, 99, 254][: rnd.randrange(1, 6)]) for _ in range(rnd.randrange(1, 30))) for _ in range(4)]
        text = b"".join(rnd.choice(part) * rnd.randrange(1, 3) + b"\xff" for _ in range(rnd.randrange(1, 9)))
        cap = rnd.choice([2, 3, 5, 9, 17])
        count = collections.Counter(text[i : i + cap] for i in range(len(text) - cap + 1))
        want = [i + cap <= len(text) and count[text[i : i + cap]] > 1 for i in range(len(text))]
        got = induced.repeated_places(np.frombuffer(text, np.uint8), cap, base=base, queue_bytes=queue_bytes, spill=str(tmp_path))
        assert got.tolist() == want
    assert not list(tmp_path.iterdir())  # what was written is gone


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.duplicate_spans(edge(spark, [])).count() == 0


def _brute_repeat(words, least):
    n, best = len(words), [0] * len(words)
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    cover = {p for i, b in enumerate(best) if b >= least for p in range(i, i + b)}
    three = collections.Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    hit = {p for i in range(n - 2) if three[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    return len(hit), len(cover), max(best, default=0)


def test_repeats_match_brute_force():
    rnd = random.Random(6)
    docs = [[rnd.randrange(rnd.choice([2, 4, 30])) for _ in range(rnd.randrange(0, 50))] for _ in range(80)] + [[1] * 40, [], [7]]
    three, covered, longest = quality.repeated_words([np.array(d, np.int64) for d in docs], 5)
    assert list(zip(three, covered, longest)) == [_brute_repeat(d, 5) for d in docs]


def test_quality_rows(spark):
    rows = quality.judge(edge(spark)).collect()
    assert len(rows) == len(EDGE) and all(r.base_failed and not r.kept for r in rows)
    passage = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(100))
    got = {r.doc_id: r for r in quality.judge(edge(spark, [(1, f"{passage} {other} {passage}", ""), (2, other, ""), (3, "#a <b>\n#a <b>\n \n \n" + other, "")])).collect()}
    assert (got[1].covered_words, got[1].longest_repeat, got[1].base_failed, got[1].kept) == (80, 40, False, False) and got[2].kept
    long, rest = [f"p{k}" for k in range(101)], [f"r{k}" for k in range(1000)]
    rows = [(1, " ".join(long + rest + long), ""), (2, " ".join(long[1:] + rest + long[1:]), "")]  # under a fifth is covered
    got_long = {r.doc_id: r for r in quality.judge(edge(spark, rows)).collect()}
    assert [(got_long[k].longest_repeat, got_long[k].base_failed, got_long[k].kept) for k in (1, 2)] == [(101, False, False), (100, False, True)]
    assert (got[3].n_symbols, got[3].n_dup_lines, got[3].word_chars) == (6, 1, 10 + len(other.replace(" ", "")))


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def _lines_left(rows):
    """(doc_id, text left) by comparing every line with all earlier ones; and how many lines went."""
    places = [(d is None, d or 0, k, d, x.strip(" \t\x0b\f\r").split(" ")) for d, t, _ in rows for k, x in enumerate((t or "").split("\n"))]
    gone, before = set(), []
    for *_, k, d, w in sorted((p for p in places if p[-1] != [""]), key=lambda p: p[:3]):
        if any(w == x or (len(w) >= 5 and len(x) >= 5 and _near(w, x)) for x in before):
            gone.add((d, k))
        before.append(w)
    return {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t, _ in rows}, len(gone)


def _line_rows():
    rnd = random.Random(1)
    line = lambda: " ".join(rnd.choice("abcdef") for _ in range(rnd.choice([1, 3, 4, 5, 6, 7, 8])))
    rows = [(d, "\n".join(line() for _ in range(6)), "k") for d in range(60)]
    return [*rows, (100, None, "k"), (101, "", "k"), (102, "  one two three four five \n\n one two three four five", "k"), (None, "one two three four five six", "k"), (103, "one two three four x", "k")]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_line_dedup(spark, limit):
    rows = _line_rows()
    left, n = _lines_left(rows)
    got = line_dedup.dedup_lines(edge(spark, rows), report=True, limit=limit).collect()
    assert {r.doc_id: r.text for r in got} == left and sum(r.n_removed for r in got) == n
    assert {r.doc_id: r.n_lines for r in got} == {d: len((t or "").split("\n")) for d, t, _ in rows}


def test_line_dedup_of_text_ids_and_clashing_columns(spark):
    rows = [(None if d is None else f"d{d:04}", t, k) for d, t, k in _line_rows()]
    places = [((d is None, d or ""), t) for d, t, _ in rows]
    assert len(set(places)) == len(rows)
    numbered = {d: i for i, (d, *_) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "")))}
    left, _ = _lines_left([(numbered[d], t, k) for d, t, k in rows])
    docs = spark.createDataFrame(rows, "doc_id string, text string, key string").selectExpr("*", "1 AS t", "2 AS _cut", "3 AS l1", "4 AS c0", "5 AS n_lines")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {d: left[numbered[d]] for d in numbered}


def test_line_dedup_rows(spark):
    assert line_dedup.dedup_lines(edge(spark)).count() == len(EDGE) and line_dedup.dedup_lines(edge(spark, [])).count() == 0


def _encoding():
    import public_tokenizers as p
    import tiktoken

    path = p.path(queries.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, p.PATTERN, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk_bytes", [24 << 20, 500])
def test_bpe(spark, chunk_bytes):
    path, pattern, enc = _encoding()
    rows = [*EDGE, (7, "<|endoftext|> it's  two   spaces \t\n\n x", ""), (8, "日本語 1234 Ünïcode", "")]
    got = bpe.decode(bpe.encode(edge(spark, rows), path, pattern, chunk_bytes=chunk_bytes), path).collect()
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got) == sorted((str(d), enc.encode_ordinary(t or ""), (t or "").encode()) for d, t, _ in rows)
    assert bpe.encode(edge(spark, []), path, pattern).count() == 0
    again = bpe.decode(bpe.encode(edge(spark, rows), path, pattern).withColumn("decoded", F.lit("x")), path)
    assert again.columns == ["doc_id", "ids", "decoded"] and {bytes(r.decoded) for r in again.collect()} == {(t or "").encode() for _, t, _ in rows}


@pytest.mark.parametrize("max_dense", [0, 6])
def test_block_max_search_is_exact(max_dense):
    rnd = random.Random(8)

    def vec():
        v = {t: rnd.choice([0.5, 1.0, rnd.random()]) for t in sorted(rnd.sample(range(30), rnd.randrange(1, 8)))}
        norm = sum(x * x for x in v.values()) ** 0.5
        return np.array(list(v)), np.array([x / norm for x in v.values()])

    rows = [vec() for _ in range(300)]
    flat = lambda j: np.concatenate([v[j] for v in rows])
    index = toxicity.Index(np.repeat(np.arange(300), [len(v[0]) for v in rows]), flat(0), flat(1), 301, 30, block=16, max_dense=max_dense)
    dense = np.zeros((301, 30))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    queries_ = [vec() for _ in range(60)] + [rows[5], (np.zeros(0, np.int64), np.zeros(0))]
    skip = list(range(62))
    for own in (None, skip):
        for i, ((t, w), (ids, got)) in enumerate(zip(queries_, index.nearest(queries_, 7, own))):
            cos = np.round(dense[:, t] @ w, 9)
            if own:
                cos[i] = 0
            bar = max(np.sort(cos)[-7], 1e-9)
            assert sorted(ids.tolist()) == np.flatnonzero(cos >= bar).tolist() and np.allclose(got, cos[ids], atol=2e-9)


def _toxic_rows():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("aeiou") + rnd.choice("lmnrst") for _ in range(3)) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        text = [rnd.choice(words) for _ in range(40)] + (["Zonkhead", "vilekip"][i % 2 :] if bad else [])
        rnd.shuffle(text)
        rows.append((i, " ".join(text), ""))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.mark.parametrize("kind", ["long", "string"])
def test_toxicity(spark, kind):
    rows, labels = _toxic_rows()
    docs = edge(spark, [*rows, (None, None, ""), (1000, "", "")]).withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("evidence_ids", F.lit(3))
    labels = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind))
    model = toxicity.fit(docs, labels)
    got = toxicity.with_scores(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert len(held) > 100 and all((r.score >= 0.3) == (int(r.doc_id) % 5 == 0) for r in held) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(got) - sum(r.score >= 0.3 for r in got)
    assert {r.score for r in kept.collect()} == {"s"}
    assert toxicity.with_scores(docs, toxicity.fit(docs, labels.limit(0))).filter("score > 0.51").count() == 0
    assert toxicity.with_scores(docs.limit(0), model).count() == 0


@needs_tables
def test_toxicity_votes_match_brute_force(spark, docs, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    import zlib

    learnt = {d: y for d, y in known.items() if zlib.crc32(str(d).encode()) % 4 != 2 and d in texts}
    assert sorted(model.doc_ids) == sorted(learnt)  # fewer than the bounds, so all of them
    words = {d: collections.Counter(re.findall(r"[^\W_]+", t.lower())) for d, t in texts.items()}
    n1, n0 = sum(learnt.values()), len(learnt) - sum(learnt.values())
    pos, neg, df = collections.Counter(), collections.Counter(), collections.Counter(w for c in words.values() for w in c)
    for d, y in learnt.items():
        (pos if y else neg).update(set(words[d]))

    def weight(w):
        p = (pos[w] + neg[w]) / (n0 + n1)
        z = max(0.0, (pos[w] / n1 - neg[w] / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12))
        return (np.log((1 + len(texts)) / (1 + df[w])) + 1) * (z * z / (z * z + 100) + 0.01)

    terms = {w: i for i, w in enumerate(sorted({w for d in learnt for w in words[d]}))}
    own = np.array([weight(w) for w in terms])

    def vector(c):
        v = np.zeros(len(terms))
        for w, n in c.items():
            if w in terms:
                v[terms[w]] = (1 + np.log(n)) * own[terms[w]]
        return v / (np.linalg.norm(v) or 1.0)

    ids = list(learnt)
    rows, y = np.array([vector(words[d]) for d in ids]), np.array([learnt[d] for d in ids], float)
    got = {r.doc_id: r for r in toxicity.with_scores(docs.select("doc_id", "text"), model, evidence=1).collect()}
    for d in sorted(texts):
        cos = np.round(rows @ vector(words[d]), 9)
        bar = max(np.sort(cos)[-15], 1e-9)
        above, tied = cos > bar, cos == bar
        part = above + tied * (min(1.0, (15 - above.sum()) / max(1, tied.sum())))
        share = ((part * cos * y).sum() + n1 / (n0 + n1)) / ((part * cos).sum() + 1)
        assert abs(got[d].score - model.calibrated(share)) < 1e-6
        if cos.max() > 0:
            assert abs(got[d].evidence_cosines[0] - cos.max()) < 1e-8


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_toxicity_held_out_accuracy_and_calibration(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in queries.op10_toxicity(spark, "/root/testdata/sf0.01").collect() if r.held_out and labels.get(r.doc_id) is not None]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    brier, base = np.mean([(s - y) ** 2 for s, y in held]), len(pos) * len(neg) / len(held) ** 2
    print(f"held-out rows {len(held)}, AUC {auc:.3f}, Brier {brier:.4f}, of the base rate {base:.4f}")
    assert auc > 0.85 and brier < 0.7 * base


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= n
    assert corpus_pipeline.run(spark, SF).count() > n // 2
