"""SimHash near-duplicates by sharded vantage-point trees.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two
fingerprints link if they differ in at most ``radius`` bits.

Search. Distances between 64-bit fingerprints of unrelated texts crowd around 32, where a vantage point
prunes little. So the bits are cut into blocks and each block gets a tree of its own: a pair within
``radius`` bits differs by at most ``radius // blocks`` bits in one block, and that tree, searched at
this small radius, must find it. The upper levels of each tree are built on the driver from a sample of
fingerprints, whose size and the trees' depth follow the counted fingerprints (16 for each wanted shard, from
``sample`` to ``max_sample`` rows of 8 bytes; it only shapes the shards), and route every fingerprint: as data
to the shard of its path, as a query also to each shard whose boundary its ball overlaps (triangle
bound). Each shard continues the tree over its own rows and compares leaves on all 64 bits, so no pair
is missed. A shard over ``shard_rows`` is dealt as a grid of data chunks by query chunks. A shard gives
back spanning links rather than all pairs; components are joined over all shards afterwards.

Rows: null or blank texts have no words and fingerprint zero, linked like any other. Equal fingerprints
are collapsed before the search. A null doc_id keeps its row; component_id is null only if all ids of
the component are null. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.operators.components import connected_components
from terravane.runtime import lean, materialize, ship

SHINGLE, RADIUS, SEED = 4, 4, 42


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text, repeats included; a text of fewer words is one shingle."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 18):
        ones += np.unpackbits(hashes[at : at + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    return majority(shingle_hashes(text, shingle))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint as a signed long; every other column is passed through."""
    ship(docs.sparkSession)
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for b in batches:
            raw = b.column(at).cast(pa.large_binary()).to_pylist()
            fp = np.fromiter((fingerprint(t or b"", shingle) for t in raw), np.uint64, len(raw)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], [*b.schema.names, out])

    return docs.mapInArrow(lean(run), docs.select("*", F.lit(0).cast("long").alias(out)).schema)


def _blocks(n: int) -> list[tuple[int, int]]:
    """(shift, mask) of n blocks that cover 64 bits."""
    cuts = [round(64 * k / n) for k in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _part(fps: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    return (fps >> np.uint64(block[0])) & np.uint64(block[1])


def _vantage(sub: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage value and threshold that split ``sub`` best among a few candidates; None if nothing splits."""
    best = None
    for k in np.linspace(0, len(sub) - 1, 5).astype(int):
        d = np.bitwise_count(sub ^ sub[k]).astype(np.int64)
        for t in {int(np.median(d)), int(np.median(d)) - 1}:
            inside = int((d <= t).sum())
            if 0 < inside < len(sub):
                near = int(((d == t) | (d == t + 1)).sum())
                cost = max(inside, len(sub) - inside) + near
                if best is None or cost < best[0]:
                    best = (cost, sub[k], t)
    return best and best[1:]


def build_router(sample: np.ndarray, blocks: int, depth: int) -> list:
    """One tree per block: nested (vantage, threshold, inside, outside), leaves are shard numbers."""
    count = iter(range(1 << 30))

    def grow(sub, left):
        cut = _vantage(sub) if left and len(sub) >= 8 else None
        if cut is None:
            return next(count)
        d = np.bitwise_count(sub ^ cut[0])
        return (*cut, grow(sub[d <= cut[1]], left - 1), grow(sub[d > cut[1]], left - 1))

    return [grow(_part(sample, b), depth) for b in _blocks(blocks)]


def route(fps: np.ndarray, trees: list, radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, row numbers visiting it, whether it is the row's home)."""
    out = []
    for block, tree in zip(_blocks(len(trees)), trees):
        sub, r = _part(fps, block), radius // len(trees)
        stack = [(tree, np.arange(len(fps)), np.ones(len(fps), bool))]
        while stack:
            node, rows, home = stack.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                out.append((node, rows, home))
                continue
            v, t, inside, outside = node
            d = np.bitwise_count(sub[rows] ^ np.uint64(v)).astype(np.int64)
            keep = d - r <= t
            stack.append((inside, rows[keep], (home & (d <= t))[keep]))
            keep = d + r > t
            stack.append((outside, rows[keep], (home & (d > t))[keep]))
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable, for nodes 0..n-1."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, lab[a], low)
        np.minimum.at(lab, lab[b], low)
        while (lab[lab] != lab).any():
            lab = lab[lab]
        differ = lab[a] != lab[b]
        a, b = a[differ], b[differ]
    return lab


def shard_links(data: np.ndarray, queries: np.ndarray, block: tuple[int, int], r: int, radius: int, leaf: int = 48):
    """Spanning links (indices into the union of both sides, fps of that union) of one shard."""
    fps, inv = np.unique(np.concatenate([data, queries]), return_inverse=True)
    d0, q0 = np.unique(inv[: len(data)]), np.unique(inv[len(data) :])
    sub, links, held = _part(fps, block), [], 0

    def flush():
        nonlocal links, held
        if links:
            a, b = (np.concatenate(x) for x in zip(*links))
            lab = _roots(len(fps), a, b)
            own = np.flatnonzero(lab != np.arange(len(fps)))
            links, held = [(own, lab[own])], len(own)

    stack = [(d0, q0)]
    while stack:
        d, q = stack.pop()
        if not len(d) or not len(q):
            continue
        cut = _vantage(sub[d]) if len(d) > leaf else None
        if cut is not None:
            v, t = cut
            dd, qd = (np.bitwise_count(sub[x] ^ v).astype(np.int64) for x in (d, q))
            stack += [(d[dd <= t], q[qd - r <= t]), (d[dd > t], q[qd + r > t])]
            continue
        for i in range(0, len(d), 256):
            p = d[i : i + 256]
            step = max(1, (1 << 21) // len(p))
            for j in range(0, len(q), step):
                x = q[j : j + step]
                near = np.bitwise_count(fps[x][:, None] ^ fps[p][None, :]) <= radius
                x, near = x[hit := near.any(1)], near[hit]
                if not len(x):
                    continue
                first = near.argmax(1)
                links.append((x, p[first]))
                together = np.zeros((len(p), len(p)), bool)
                for k in np.unique(first):
                    together[k] = near[first == k].any(0)
                a, b = np.nonzero(together)
                links.append((p[a], p[b]))
                held += len(x) + len(a)
                if held > 1 << 20:
                    flush()
    flush()
    return (links[0] if links else (np.zeros(0, int), np.zeros(0, int))), fps


def fingerprint_links(
    fps: DataFrame, radius: int = RADIUS, blocks: int = 3, sample: int = 4096, shard_rows: int = 20_000, max_sample: int = 1 << 18
) -> DataFrame:
    """Spanning links (a, b) between the distinct non-null longs ``fps.fp`` within ``radius`` bits."""
    ship(fps.sparkSession)
    total = fps.count()
    depth = max(1, int(np.ceil(np.log2(max(2, total / shard_rows)))))
    rows = fps.select("fp", F.xxhash64("fp").alias("o")).orderBy("o").limit(min(max(sample, 16 << depth), max_sample)).collect()
    trees = build_router(np.array([r.fp for r in rows], np.int64).view(np.uint64), blocks, depth)
    owner: dict[int, int] = {}

    def own(node, tree):
        if isinstance(node, int):
            owner[node] = tree
        else:
            own(node[2], tree)
            own(node[3], tree)

    for k, tree in enumerate(trees):
        own(tree, k)

    def counts(batches):
        seen: dict[int, list[int]] = {}
        for b in batches:
            for shard, r, home in route(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), trees, radius):
                x = seen.setdefault(shard, [0, 0])
                x[0] += int(home.sum())
                x[1] += len(r)
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array(list(seen), pa.int32()), "home": pa.array([x[0] for x in seen.values()], pa.int64()), "all": pa.array([x[1] for x in seen.values()], pa.int64())}
        )

    sizes = fps.select("fp").mapInArrow(lean(counts), "shard int, home long, all long").groupBy("shard")
    grid = {
        r.shard: max(1, -(-max(r.home, r.all // 4) // (2 * shard_rows)))
        for r in sizes.agg(F.sum("home").alias("home"), F.sum("all").alias("all")).collect()
    }

    def deal(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            salt = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for shard, r, home in route(fp.view(np.uint64), trees, radius):
                s = grid.get(shard, 1)
                mine = (salt[r] % np.uint64(s)).astype(np.int32)
                for k in range(s):
                    for rows, i, j, is_data in (
                        (r[home], mine[home], np.full(int(home.sum()), k, np.int32), True),
                        (r, np.full(len(r), k, np.int32), mine, False),
                    ):
                        if len(rows):
                            yield pa.RecordBatch.from_pydict(
                                {"shard": pa.array(np.full(len(rows), shard, np.int32)), "i": pa.array(i), "j": pa.array(j), "fp": pa.array(fp[rows]), "is_data": pa.array(np.full(len(rows), is_data))}
                            )

    bits = _blocks(blocks)

    def links(key, table):
        fp = table.column("fp").to_numpy().view(np.uint64)
        is_data = table.column("is_data").to_numpy(zero_copy_only=False).astype(bool)
        (a, b), all_fps = shard_links(fp[is_data], fp[~is_data], bits[owner[key[0].as_py()]], radius // blocks, radius)
        back = all_fps.view(np.int64)
        return pa.table({"a": pa.array(back[a]), "b": pa.array(back[b])})

    dealt = fps.select("fp").mapInArrow(lean(deal), "shard int, i int, j int, fp long, is_data boolean")
    return dealt.groupBy("shard", "i", "j").applyInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, **search) -> DataFrame:
    """(doc_id, fp, component_id, group_fp, n_docs) of every row of ``docs`` (doc_id, text).

    group_fp names the component (its smallest fingerprint); n_docs counts the rows of the own fingerprint.
    """
    table = materialize(with_fingerprint(docs.select("doc_id", "text"), shingle=shingle).select("doc_id", "fp"), "fps")
    fps = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_docs")), "fp")
    comp = connected_components(materialize(fingerprint_links(fps, radius, **search), "links"))
    grouped = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    lows = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    named = grouped.join(lows, "component").select("fp", F.col("component").alias("group_fp"), "component_id", "n_docs")
    return table.join(named, "fp").select("doc_id", "fp", "component_id", "group_fp", "n_docs")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, **search) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest doc_id. Columns as in ``docs``."""
    found = near_duplicates(docs, shingle=shingle, **search)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), "group_fp"
    )
    # rows that share id and group: one of their fingerprints stays
    keep = keep.groupBy("_id", "group_fp").agg(F.min("_fp").alias("_fp")).drop("group_fp")
    out = with_fingerprint(docs, out="_own", shingle=shingle)
    hit = out["doc_id"].eqNullSafe(keep["_id"]) & (out["_own"] == keep["_fp"])
    kept = out.join(keep, hit, "left_semi")
    return kept.dropDuplicates(["doc_id", "_own"]).select(*docs.columns)
