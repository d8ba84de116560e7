"""Benchmark decontamination with DataFrame functions only.

Items are cut into windows of ``n`` consecutive normalised words; an item of fewer words is one window.
The distinct windows form the hash set. Each training text is read and cut into words once. Every window of
it, of each length that the items have, is tested against two one-byte-per-bucket tables of the hash set
(literals of at most ``max_table`` bytes each), and only the windows that pass both are kept, written with
the text's MD5 and word count, and joined with the hash set on the window text itself, so a hit is exact.
The join broadcasts the hash set if its size, as measured, is under ``broadcast_bytes`` and shuffles
otherwise; with more windows than ``max_table`` / 16 the tables are left out and every window is joined.
Hits are keyed by the text's MD5, so copies of a text meet in map-side aggregation. Stages that need the
texts again meet the hits by broadcast up to ``broadcast_keys`` of them, as counted, and by shuffle beyond.

Rows: a null text has no words; a null item text has no windows; a null item_id marks hits but is not
listed. Repeated rows and ids are kept as they are. Other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.runtime import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 10


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, n: int = N) -> DataFrame:
    """(win, len, item_ids) of each distinct window of ``items`` (item_id, text)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    w = w.filter(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(n)))
    at = F.explode(F.expr("sequence(1, size(w) - len + 1)"))
    w = w.select("item_id", "len", "w", at.alias("p"))
    w = w.select("item_id", "len", F.array_join(F.slice("w", F.col("p"), F.col("len")), " ").alias("win"))
    return w.groupBy("win", "len").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def _bucket(words: Column, seed: int, size: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), words), F.lit(size))


def _tables(grams: DataFrame, size: int) -> list[Column]:
    """Two tables of the windows' buckets, one byte a bucket."""
    w = F.split("win", " ")
    out = []
    for seed in (1, 2):
        table = bytearray(size)
        for r in grams.select(_bucket(w, seed, size).alias("x")).distinct().collect():  # at most size rows
            table[r.x] = 1
        out.append(F.lit(bytes(table)))
    return out


def _candidates(lengths: list[int], tables: list[Column], size: int) -> Column:
    """(p, len, win) of the windows of the words w that may be in the hash set; p from 1."""
    n, parts = F.size("w"), []
    for k in lengths:
        starts = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        for seed, table in enumerate(tables, 1):
            starts = F.filter(
                starts,
                lambda p: F.substring(table, (_bucket(F.slice("w", p, F.lit(k)), seed, size) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01"),
            )
        parts.append(F.transform(starts, lambda p: F.struct(p.alias("p"), F.lit(k).alias("len"), F.array_join(F.slice("w", p, F.lit(k)), " ").alias("win"))))
    return F.concat(*parts)


def _key(text: str = "text") -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def scan(docs: DataFrame, items: DataFrame, n: int = N, max_table: int = 1 << 20, broadcast_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): rows are (doc_id, key, n_words) of every document; hits are (key, hits, item_ids) of each distinct text with
    a hit, as (p, len), p from 1."""
    grams = item_windows(items, n)
    stats = grams.groupBy("len").agg(F.count("*").alias("n"), F.sum(F.length("win") + 64).alias("b")).collect()
    lengths, total = sorted(r.len for r in stats), sum(r.n for r in stats)
    size = 1 << 12
    while size < 32 * total and size < max_table:
        size *= 2
    tables = _tables(grams, size) if total <= max_table // 16 else []
    cut = docs.select("doc_id", _key().alias("key"), words_of(F.col("text")).alias("w"))
    found = _candidates(lengths or [n], tables, size)
    rows = materialize(cut.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), found.alias("found")), "windows")
    found = rows.select("key", F.explode("found").alias("x")).select("key", "x.*")
    small = sum(r.b for r in stats) <= broadcast_bytes
    found = found.join(F.broadcast(grams) if small else grams, ["win", "len"])
    found = found.groupBy("key", "p", "len", "item_ids").agg(F.lit(1).alias("one"))
    hits = found.groupBy("key").agg(
        F.collect_set(F.struct("p", "len")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"),
    )
    return rows.drop("found"), hits


def _covered() -> Column:
    return F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["p"], h["p"] + h["len"] - 1))))


def _few(hits: DataFrame, broadcast_keys: int) -> DataFrame:
    """``hits`` (_key and one number), written, and marked for broadcast if they are at most broadcast_keys (about 64 bytes each)."""
    hits = materialize(hits, "hits")
    return F.broadcast(hits) if hits.count() <= broadcast_keys else hits


def contamination(docs: DataFrame, items: DataFrame, n: int = N, broadcast_bytes: int = 64 << 20, **search) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, contaminated) of every row of ``docs``; hits are broadcast up to broadcast_bytes, as measured."""
    rows, hits = scan(docs, items, n, broadcast_bytes=broadcast_bytes, **search)
    hits = hits.select("key", F.size(_covered()).cast("long").alias("n_hit"), F.array_sort("item_ids").alias("item_ids"))
    hits = materialize(hits, "hits")
    size = hits.agg(F.sum(F.lit(96) + F.aggregate("item_ids", F.lit(0), lambda t, x: t + F.length(x) + 24))).first()[0] or 0
    joined = rows.join(F.broadcast(hits) if size <= broadcast_bytes else hits, "key", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (hit > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = N, min_fraction: float = 0.0, broadcast_keys: int = 200_000, **search) -> DataFrame:
    """``docs`` without the documents whose words are hit by more than ``min_fraction``."""
    rows, hits = scan(docs, items, n, **search)
    hits = hits.select("key", F.size(_covered()).alias("n_hit"))
    gone = rows.select("key", "n_words").distinct().join(hits, "key").filter(F.col("n_hit") / F.greatest("n_words", F.lit(1)) > min_fraction)
    gone = _few(gone.select(F.col("key").alias("_key")), broadcast_keys)
    return docs.withColumn("_key", _key()).join(gone, "_key", "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, n: int = N, **search) -> DataFrame:
    """``docs`` with every hit word cut out of the text, the white space and marks around it left in place."""
    _, hits = scan(docs, items, n, **search)
    hits = hits.select(F.col("key").alias("_key"), _covered().alias("_cut"))
    keyed = docs.withColumn("_key", _key()).join(hits, "_key", "left")
    # word k stands between gap k and gap k + 1
    raw_word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = F.regexp_extract_all("text", F.lit(raw_word), F.lit(0))
    gaps = F.split("text", raw_word)
    kept = F.transform(words, lambda w, k: F.when(F.array_contains("_cut", k + 1), F.lit("")).otherwise(w))
    pieces = F.zip_with(gaps, F.concat(kept, F.array(F.lit(""))), lambda g, w: F.concat(g, w))
    new = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    return keyed.withColumn("text", new).select(*docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w,
  row_number() OVER () AS r FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS k, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p, w FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM bw),
ks AS (SELECT DISTINCT k FROM g),
dw AS (SELECT r, k, unnest(generate_series(1, len(w) - k + 1)) AS p, w FROM d, ks WHERE len(w) >= k),
h AS (SELECT DISTINCT dw.r, dw.p, dw.k, g.item_id FROM (SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM dw) dw JOIN g ON g.win = dw.win AND g.k = dw.k),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + k - 1)) AS q FROM (SELECT DISTINCT r, p, k FROM h)) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN i ON i.r = d.r
"""
