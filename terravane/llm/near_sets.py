r"""Near-duplicates at a stated similarity: SimHash groups first, completed by an exact join of shingle sets.

Two texts link if their sets of word shingles have a Jaccard similarity of 0.8 or more. At 0.8 two 64-bit
fingerprints differ by about 10 bits, and by 16 and more at times, so no radius that vantage points can search
finds all such pairs. So the stage works in two steps, and its result is that of all pairs.

SimHash. Fingerprints are linked by the vantage-point trees of ``simhash`` at ``radius`` bits; texts of one
fingerprint link to its first. Each link is verified on the sets. This groups the close copies, however many.

Completion. Shingles are 64-bit hashes, put in one order for all texts, common ones last. A set of n shingles that is
0.8 similar to another shares one of its first n - ceil(0.8 n) + 1 with the first ones of the other. A shingle is
common if more than ``often`` texts have it among their first ones, as counted; the order is made anew with these
until none is left or ``passes`` are over (at most ``most_common`` are held; beyond that ``often`` is doubled). So a
passage of many texts brings them together only if they are little else, and a text meets a bounded number of
others. The order never changes the result. Per shared shingle the nodes of different groups are
compared with one head of it (``rounds`` times), and then all remaining pairs of different groups; pairs within a
group need no link. So a large group of near copies costs rows near its size.

Before sets meet, a pair's histograms do: counts of the shingles by their low bits, about an eighth of a long set's
bytes. The sum of the lesser counts bounds the overlap from above (a count that is full lets the pair through), so
pairs that fall short of it are out without a loss, and only the few others are compared set by set. Equal sets are
one node.

Rows: null and blank texts have the empty set and form one group. A null doc_id keeps its row if all ids of the
group are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import simhash
from terravane.operators.components import connected_components
from terravane.runtime import lean, materialize, scratch, ship

SHINGLE, SEED = 5, 42


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text of fewer words is one shingle."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 4/5 or more, in whole numbers."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


LEAST_BUCKETS = 256


def histogram(items: np.ndarray) -> bytes:
    """Counts of the shingles by their low bits, one byte each, in as many buckets (a power of two) as half the shingles or more;
    255 stands for that many or more."""
    size = LEAST_BUCKETS
    while 2 * size < len(items):
        size *= 2
    return np.minimum(np.bincount((items & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def may_be_similar(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Whether sets of n and m shingles with these histograms can have a Jaccard similarity of 4/5 or more."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    if (a == 255).any() or (b == 255).any():
        return True
    size = min(len(a), len(b))  # the finer one is folded
    return 9 * int(np.minimum(a.reshape(-1, size).sum(0), b.reshape(-1, size).sum(0)).sum()) >= 4 * (n + m)


def prefix(items: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles: those that are not common first, then by hash. Both arrays are sorted."""
    if len(common) and len(items):
        at = np.minimum(np.searchsorted(common, items), len(common) - 1)
        held = common[at] == items
        items = np.concatenate([items[~held], items[held]])
    return items[: len(items) - -(-4 * len(items) // 5) + 1]


def _name(items: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(items.tobytes(), SEED)


def _with_node(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` with _own, the name of the text's shingle set."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            raw = b.column(at).cast(pa.large_binary()).to_pylist()
            own = np.fromiter((_name(shingle_set(t or b"", shingle)) for t in raw), np.uint64, len(raw)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], [*b.schema.names, "_own"])

    return docs.mapInArrow(lean(run), docs.select("*", F.lit(0).cast("long").alias("_own")).schema)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, node, fp, n, hist, items) of each text."""

    def run(batches):
        for b in batches:
            hashes = [simhash.shingle_hashes(t or b"", shingle) for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            sets = [np.unique(h) for h in hashes]
            fp = np.fromiter(map(simhash.majority, hashes), np.uint64, len(hashes)).view(np.int64)
            node = np.fromiter(map(_name, sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(node), pa.array(fp), pa.array([len(s) for s in sets], pa.int64()), pa.array([histogram(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc_id", "node", "fp", "n", "hist", "items"],
            )

    schema = docs.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("node", "fp", "n")), F.lit(b"").alias("hist"), F.lit(b"").alias("items")).schema
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def _entries(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """(node, n, key) for each of a set's first shingles."""
    shared = sets.sparkSession.sparkContext.broadcast(common)  # most_common numbers at most

    def run(batches):
        common = shared.value
        for b in batches:
            first = [prefix(np.frombuffer(x, np.uint64), common) for x in b.column(2).to_pylist()]
            size = [len(f) for f in first]
            at = np.repeat(np.arange(len(first)), size)
            keys = np.concatenate([*first, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(keys)], ["node", "n", "key"])

    return sets.select("node", "n", "items").mapInArrow(lean(run), "node long, n long, key long")


def _ordered(sets: DataFrame, often: int, passes: int, most_common: int) -> tuple[DataFrame, DataFrame]:
    """(entries, keys that several entries have) in an order in which few keys are common."""
    common = np.zeros(0, np.uint64)
    for k in range(passes):
        entries = _entries(sets, common)
        # copies of a text count here, too; their keys leave with the first round
        shared = materialize(entries.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
        hot = shared.filter(F.col("c") > often)
        while hot.count() + len(common) > most_common:
            often *= 2
            hot = shared.filter(F.col("c") > often)
        found = np.unique(hot.select("key").toArrow()["key"].to_numpy().view(np.uint64))
        fresh = np.setdiff1d(found, common)
        if k == passes - 1 or not len(fresh):
            break
        common = np.union1d(common, fresh)
    return entries, shared.select("key")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which is written already, marked for broadcast if it has at most ``rows`` rows of a few numbers."""
    return F.broadcast(df) if df.count() <= rows else df


def _compared(pairs: DataFrame, own: DataFrame, test) -> DataFrame:
    """The pairs (a, b) that pass ``test`` on two lists of bytes of ``own`` (node, bytes) and on their sets' sizes."""
    x, y = (own.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bytes").alias(f"bytes{k}")) for k in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "bytesa", "bytesb", "na", "nb")

    def run(batches):
        for b in batches:
            ok = test(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(lean(run), "a long, b long")


def _may_be(xs: list, ys: list, n: np.ndarray, m: np.ndarray) -> list[bool]:
    return [may_be_similar(*pair) for pair in zip(xs, ys, n.tolist(), m.tolist())]


def _are(xs: list, ys: list, n: np.ndarray, m: np.ndarray) -> list[bool]:
    return [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(xs, ys)]


def _verified(pairs: DataFrame, hists: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar; sets are read only for the pairs that their histograms let through."""
    able = materialize(_compared(pairs, hists, _may_be), "able")
    nodes = _few(materialize(able.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes"), rows)
    items = sets.select("node", "n", F.col("items").alias("bytes")).join(nodes, "node", "left_semi").dropDuplicates(["node"])
    return _compared(able, items, _are)


def _simhash_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """(a, b) of nodes that one fingerprint names or whose fingerprints link."""
    own = materialize(sets.select("node", "fp").distinct(), "fps")
    heads = own.groupBy("fp").agg(F.min("node").alias("head"))
    stars = own.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = simhash.fingerprint_links(materialize(heads, "heads"), radius).toDF("fa", "fb")
    far = links.join(heads.toDF("fa", "a"), "fa").join(heads.toDF("fb", "b"), "fb").filter("a <> b").select("a", "b")
    both = stars.unionByName(far)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(
    sets: DataFrame, rounds: int = 1, radius: int = simhash.RADIUS, broadcast_rows: int = 1_000_000, often: int = 64, passes: int = 3, most_common: int = 1_000_000
) -> DataFrame:
    """(node, component) of the nodes that link to another."""
    entries, shared = _ordered(sets, often, passes, most_common)
    held = materialize(entries.join(_few(shared, broadcast_rows), "key", "left_semi").distinct(), "held")
    nodes = _few(materialize(held.select("node").distinct(), "nodes"), broadcast_rows)
    hists = sets.select("node", "n", F.col("hist").alias("bytes")).join(nodes, "node", "left_semi").dropDuplicates(["node"])
    hists = materialize(hists, "hists")
    # similar sets share a shingle of their prefixes, so a SimHash pair without histograms is not similar
    links = materialize(_verified(_simhash_pairs(sets, radius), hists, sets, broadcast_rows), "links")
    near = F.expr("5 * least(n, n2) >= 4 * greatest(n, n2)")
    for k in range(rounds + 1):
        comp = _few(materialize(connected_components(links), "components"), broadcast_rows)
        tagged = held.join(comp, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
        head = F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("o"), F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("c").alias("c2")))
        live = tagged.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), head.alias("head")).filter("lo <> hi")
        live = _few(materialize(live.select("key", "head.*"), "live"), broadcast_rows)
        # a key within one group is of no more use
        tagged = materialize(tagged.join(live.select("key"), "key", "left_semi"), "tagged")
        held = tagged.drop("c")
        if k < rounds:
            met = tagged.join(live, "key").filter((F.col("c") != F.col("c2")) & near)
        else:
            other = tagged.select("key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("c").alias("c2"))
            met = tagged.join(other, "key").filter((F.col("c") < F.col("c2")) & near)
        pairs = met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
        links = links.unionByName(materialize(_verified(pairs, hists, sets, broadcast_rows), "links"))
    return materialize(connected_components(links), "components")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, broadcast_rows: int = 1_000_000, **search) -> DataFrame:
    """One row of each group of similar texts: that of the smallest doc_id. Columns as in ``docs``."""
    ship(docs.sparkSession)
    with scratch(docs.sparkSession) as kept_tables:  # what follows reads docs and this table only
        sets = materialize(_sets(docs, shingle), "sets")
        comp = _few(components(sets, broadcast_rows=broadcast_rows, **search), broadcast_rows)
        table = sets.select("doc_id", "node").join(comp, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
        lows = table.groupBy("component").agg(F.min("doc_id").alias("low"))
        keep = table.join(lows, "component").filter(F.col("doc_id").eqNullSafe(F.col("low")))
        # rows that share id and group: one of their sets stays
        keep = keep.groupBy(F.col("doc_id").alias("_id"), "component").agg(F.min("node").alias("_node"), F.count("*").alias("_rows")).drop("component")
        keep = materialize(keep, "keep")
        kept_tables.append(keep)
    repeated = not keep.filter("_rows > 1").isEmpty()
    # own names, as docs may have columns of any name
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    out = _with_node(plain, text, shingle)
    hit = out[doc].eqNullSafe(keep["_id"]) & (out["_own"] == keep["_node"])
    kept = out.join(_few(keep.select("_id", "_node"), broadcast_rows), hit, "left_semi")
    if repeated:  # and one of the rows that share id and set
        kept = kept.dropDuplicates([doc, "_own"])
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
