r"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line is a \n-split part of a text, trimmed; its words stand between single spaces. A non-empty line goes if
an earlier line equals it; a line of ``min_words`` words or more also if an earlier one differs by one word
inserted, deleted or substituted, whatever the edit within the word (at five words that is a similarity of
0.8; of fewer words one is over a fifth of the line). Earlier: a smaller (doc_id, line number); a null doc_id
comes last. Rows that share a doc_id and a line number with equal text count as one line.

Join. The texts are read and split once; the places of their lines are written with a 128-bit hash of each
line, and equal lines are collapsed to their first place with map-side aggregation. The neighbourhood of a
line of n words is the line itself and its n variants with one word deleted; each is keyed by its length and
two sums of position-wise word hashes, which a deletion only shifts. Two lines are within the bound exactly
if they share the variant of the same deleted place, or one's variant is the other line. Per key the first
place is kept, joined back, and the pair is verified word by word. One edit leaves the first or the last half
of a line as it is, so lines that share neither half with another one can have no partner; they leave before
variants are made, which loses nothing and keeps the join near the number of true candidates.

Skew. Tables are broadcast up to ``BROADCAST_BYTES``, as measured on what was written. Beyond it, lines that
occur very often (at most 200,000 of them, by their count) are still broadcast, and all others meet their
places by a shuffle in which no key is hot; the remaining joins rely on AQE to split a hot key's rows.

Rows: null and empty texts have no lines and come out as they are. A doc_id may be of any type that can be
ordered; whole numbers are packed with the line number and aggregate fastest. Other columns pass through,
whatever their names, but for n_lines and n_removed, which ``report`` replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terravane.runtime import materialize

MIN_WORDS = 5
BROADCAST_BYTES = 64 << 20
_BITS = (1 << 40) - 1
KEY = ["l1", "l2"]


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\x0b\f\r"))


def _key(line: Column) -> list[Column]:
    """A line's 128-bit name."""
    return [F.xxhash64(line).alias("l1"), F.xxhash64(F.lit(7), line).alias("l2")]


def _place(docs: DataFrame) -> Column:
    """(doc_id, line number) in order, no doc_id last: one number if doc_id is one, so that the least is kept by hash aggregation."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.IntegralType):
        doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit("1" + "0" * 19).cast("decimal(20,0)"))
        return (doc * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")).cast("decimal(32,0)")
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("line_no").alias("line_no"))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("t", F.xxhash64("text"))


def _half_keys() -> Column:
    """Keys of the halves that a partner of n - 1, n or n + 1 words would share, for a line of n words."""
    keys = []
    for p, q in (("n div 2", "n - n div 2"), ("(n - 1) div 2", "n - 1 - (n - 1) div 2")):
        keys.append(F.expr(f"xxhash64('p', substring_index(line, ' ', cast({p} as int)))"))
        keys.append(F.expr(f"xxhash64('s', substring_index(line, ' ', cast(-({q}) as int)))"))
    return F.array_distinct(F.array(*keys))


def line_places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, line_no, l1, l2, halves) of every non-empty line; t is a hash of the text, halves of lines under min_words are null."""
    rows = _slim(docs).select("doc_id", "t", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", _trimmed(F.col("line"))).filter("line <> ''")
    rows = rows.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    halves = F.when(F.col("n") >= min_words, _half_keys())
    return rows.select("doc_id", "t", "line_no", *_key(F.col("line")), halves.alias("halves"))


def _fit(df: DataFrame, width: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, which is written already, marked for broadcast if its rows of ``width`` bytes fit."""
    size = df.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def _variants(words: DataFrame) -> DataFrame:
    """(first, i, k1, k2, kind, whole): the hashed variants of lines (l1, l2, first, w)."""
    # dealt by line before the words are exploded, so that the sums below need no further shuffle
    each = words.repartition(*KEY).select(*KEY, "first", F.size("w").alias("n"), F.posexplode("w").alias("i", "x"))
    terms = [F.xxhash64(F.lit(s), "x", F.col("i") + d).bitwiseAND(_BITS) for s in (1, 2) for d in (0, -1)]
    each = each.select(*KEY, "first", "n", "i", *(t.alias(f"t{k}") for k, t in enumerate(terms)))
    line = Window.partitionBy(*KEY)
    before = line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    cut = [
        F.coalesce(F.sum(f"t{k}").over(before), F.lit(0)) + F.sum(f"t{k + 1}").over(line) - F.sum(f"t{k + 1}").over(upto)
        for k in (0, 2)
    ]
    whole = [F.sum(f"t{k}").over(line) for k in (0, 2)]
    each = each.select("first", "n", "i", *(c.alias(f"c{k}") for k, c in enumerate(cut)), *(c.alias(f"h{k}") for k, c in enumerate(whole)))

    # kind 0: the same place deleted; kind 1: the line itself or a variant that equals it
    def variant(kind, m, at, sums, whole):
        name = [F.xxhash64(F.lit(kind), m, at, F.col(c)) for c in sums]
        return F.struct(name[0].alias("k1"), name[1].alias("k2"), F.lit(kind).alias("kind"), F.lit(whole).alias("whole"))

    n, no = F.col("n"), F.lit(-1)
    gone, less, self_ = variant(0, n, F.col("i"), ("c0", "c1"), False), variant(1, n - 1, no, ("c0", "c1"), False), variant(1, n, no, ("h0", "h1"), True)
    made = F.when(F.col("i") == 0, F.array(gone, less, self_)).otherwise(F.array(gone, less))
    return each.select("first", "i", F.explode(made).alias("v")).select("first", "i", "v.*")


def duplicate_lines(docs: DataFrame, places: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(l1, l2, first, near, c): distinct lines that occur again or have an earlier line within one edit.

    first is the first place of the line, c how often it occurs; near says that also the first one goes.
    """
    placed = places.withColumn("place", _place(places))
    keyed = placed.select(*KEY, "place", *(F.get("halves", F.lit(k)).alias(f"half{k}") for k in range(4)))
    seen = keyed.groupBy(*KEY).agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("c"), *(F.first(f"half{k}").alias(f"half{k}") for k in range(4))
    )
    seen = materialize(seen, "lines")
    halves = seen.select(*KEY, F.explode(F.array_compact(F.array(*(f"half{k}" for k in range(4))))).alias("half"))
    common = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    able = halves.join(common, "half", "left_semi").select(*KEY).distinct()
    # the first places of able lines, with their words; only their texts are split again
    held = _fit(materialize(seen.select(*KEY, "first").join(able, KEY, "left_semi"), "able"), 40, limit)
    at = placed.join(held, KEY).filter(F.col("place") == F.col("first")).dropDuplicates(KEY)
    at = at.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("line_no", "first")).alias("_at"))
    at = _fit(materialize(at, "at"), F.lit(48) + 40 * F.size("_at"), limit)
    rows = _slim(docs)
    rows = rows.join(at, rows["doc_id"].eqNullSafe(at["_id"]) & (F.col("t") == F.col("_t")))
    parts = F.split("text", "\n")
    line = F.transform("_at", lambda x: F.struct(x["first"].alias("first"), _trimmed(F.element_at(parts, x["line_no"] + 1)).alias("line")))
    words = rows.select(F.explode(line).alias("x")).select(*_key(F.col("x.line")), "x.first", F.split("x.line", " ").alias("w"))
    words = materialize(words.dropDuplicates([*KEY, "first"]), "words")
    # only names found twice are of use; they are counted by 64 bits first, to shuffle little
    variants = _variants(words)
    twice = _fit(materialize(variants.groupBy("k1").agg(F.count("*").alias("n")).filter("n > 1").select("k1"), "twice"), 16, limit)
    variants = materialize(variants.join(twice, "k1", "left_semi"), "variants")
    heads = variants.groupBy("k1", "k2").agg(
        F.min(F.when(~F.col("whole"), F.col("first"))).alias("low_cut"),
        F.min(F.when(F.col("whole"), F.col("first"))).alias("low_whole"),
        F.min("first").alias("low"),
        F.max("first").alias("high"),
    ).filter("low <> high")
    met = variants.join(_fit(materialize(heads, "heads"), 96, limit), ["k1", "k2"])
    earlier = F.when((F.col("kind") == 0) | F.col("whole"), F.col("low_cut")).otherwise(F.col("low_whole"))
    pairs = met.withColumn("earlier", earlier).filter("earlier < first").select("first", "kind", "i", "whole", "earlier").distinct()
    own = _fit(words, F.lit(64) + F.aggregate("w", F.lit(0), lambda s, x: s + F.octet_length(x) + 24), limit)
    pairs = pairs.join(own.select(F.col("first").alias("earlier"), F.col("w").alias("e")), "earlier").join(own.select(*KEY, "first", "w"), "first")
    same = F.expr(
        "CASE WHEN kind = 0 THEN size(w) = size(e) AND slice(w, 1, i) = slice(e, 1, i) AND slice(w, i + 2, size(w)) = slice(e, i + 2, size(e))"
        " WHEN whole THEN size(e) = size(w) + 1 AND exists(sequence(0, size(w)), j -> slice(e, 1, j) = slice(w, 1, j) AND slice(e, j + 2, size(e)) = slice(w, j + 1, size(w)))"
        " ELSE size(w) = size(e) + 1 AND slice(w, 1, i) = slice(e, 1, i) AND slice(w, i + 2, size(w)) = slice(e, i + 1, size(e)) END"
    )
    near = pairs.filter(same).select(*KEY, F.lit(True).alias("near")).distinct()
    out = seen.select(*KEY, "first", "last", "c").join(near, KEY, "left").filter("first <> last OR near")
    return out.select(*KEY, "first", F.coalesce("near", F.lit(False)).alias("near"), "c")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, t, line_no): every line place that goes, with the hash of its text."""
    places = materialize(line_places(docs, min_words), "places")
    dups = materialize(duplicate_lines(docs, places, limit), "dups")
    placed = places.select("doc_id", "t", "line_no", *KEY, _place(places).alias("place"))
    goes = F.col("near") | (F.col("place") != F.col("first"))
    total, size = dups.agg(F.sum("c"), F.count("*") * 56).first()
    if (size or 0) <= limit:
        met = placed.join(F.broadcast(dups), KEY)
    else:
        often = dups.filter(F.col("c") > max(10_000, total // 200_000))  # at most 200,000 lines can be so frequent
        rest = placed.join(F.broadcast(often.select(*KEY)), KEY, "left_anti").join(dups.join(often.select(*KEY), KEY, "left_anti"), KEY)
        met = placed.join(F.broadcast(often), KEY).unionByName(rest)
    return met.filter(goes).select("doc_id", "t", "line_no")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with the removed lines cut out of the text; ``report`` adds n_lines and n_removed.

    With repeated doc_ids a line of a row goes only if its text holds it at a removed place.
    """
    names = [c for c in docs.columns if not (report and c in ("n_lines", "n_removed"))]
    cuts = removed_lines(docs, min_words, limit).groupBy(F.col("doc_id").alias("_cut_id"), F.col("t").alias("_cut_t")).agg(F.collect_set("line_no").alias("_cut"))
    cuts = _fit(materialize(cuts, "cuts"), F.lit(48) + 4 * F.size("_cut"), limit)
    # own names, as docs may have columns of any name
    rows = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names)))
    doc, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    rows = rows.join(cuts, doc.eqNullSafe(F.col("_cut_id")) & (F.xxhash64(text) == F.col("_cut_t")), "left")
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_cut"))
    new = F.when(F.col("_cut").isNull(), text).otherwise(F.array_join(F.transform(left, lambda k: F.element_at(lines, k + 1)), "\n"))
    out = [new.alias(c) if c == "text" else F.col(f"c{k}").alias(c) for k, c in enumerate(names)]
    if report:
        n = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
        out += [F.coalesce(n, F.lit(1)).cast("long").alias("n_lines"), F.coalesce(F.size("_cut"), F.lit(0)).cast("long").alias("n_removed")]
    return rows.select(*out)
