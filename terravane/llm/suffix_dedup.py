"""Exact substring dedup over whole texts as bytes, by external induced sorting of shards.

A byte goes if it lies in a ``length``-byte string that starts at another place too, in any document.

Shards. No order of all suffixes of a corpus is needed, only that of suffixes that may share ``length`` bytes, so
these are dealt first. Every ``length``-byte window is named by its least k-gram hash (leftmost on ties), the
anchor; equal windows have equal anchors at equal offsets. Consecutive windows share their anchor, so a text becomes
about one segment per length / 2 bytes: the bytes of all windows of one anchor. Equal segments are counted by a
128-bit hash; where a segment repeats, all its windows do. Where one anchor has several different segments, one copy
of each goes to the anchor's shard. There ``induced`` sorts all suffixes, shard after shard of about ``shard_bytes``,
by external induced sorting with common-prefix values: a window repeats if its suffix has ``length`` bytes in common
with a neighbour. Nothing is sampled: the anchors only say which suffixes must meet. Shards
are dealt to as many tasks as their counted bytes need, ``task_bytes`` each, so tasks do not grow with the corpus.

Hot anchors. An anchor whose segments exceed ``hot_bytes`` would fill a task. Its windows are named by their 128-bit
hash instead and dealt by it to as many groups as the anchor's counted bytes need; a segment's windows of one group
travel as one row, and equal windows meet in their group.

Sides. A window has at least half of its bytes beside the anchor on one side, so segments that share a window have
equal bytes on that side, too. A segment whose left and right sides are both its own shares no window with another
and does not go to a shard. Sides are compared by hash; equal hashes only let more through.

Texts are collapsed by a 128-bit hash, on the map side first, and kept in a table bucketed by it, so later joins move
ranges, not texts. ``runtime.release`` drops the tables when the result has been used.

Rows: null texts are empty. Repeated rows are copies and repeat each other. Texts under ``length`` bytes
have no window. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.induced import repeated_places
from terravane.runtime import bucketed, materialize, shared_dir, ship

LENGTH, GRAM = 400, 16


def _words(raw: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes from each offset as one integer."""
    n = len(raw) - 7
    return np.ndarray((n,), dtype=f"{order}u8", buffer=raw.data, strides=(1,))


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, last window start, anchor place, anchor hash) of the segments of one text."""
    if len(raw) < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    w = _words(raw, "<").astype(np.uint64)
    n = len(raw) - gram + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (w[gram - 8 : gram - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(7)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h &= np.uint64(0xFFFFFFFFFF000000)
    span = length - gram + 1  # k-grams in a window
    best, place = np.empty(n - span + 1, np.uint64), np.empty(n - span + 1, np.int64)
    # blocks under 2**24 places: the low bits hold the place, so the least is leftmost
    step = (1 << 23) - span
    for at in range(0, len(best), step):
        part = h[at : at + step + span - 1]
        v = part | np.arange(len(part), dtype=np.uint64)
        pad = -len(v) % span
        full = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
        ahead = np.minimum.accumulate(full, 1).ravel()
        back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
        m = len(part) - span + 1
        low = np.minimum(back[:m], ahead[span - 1 : span - 1 + m])
        best[at : at + m] = low >> np.uint64(24)
        place[at : at + m] = (low & np.uint64(0xFFFFFF)).astype(np.int64) + at
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:], len(place)) - 1
    return first, last, place[first], best[first].astype(np.int64)


def repeated_windows(segments: list[bytes], length: int = LENGTH, **sort) -> list[np.ndarray]:
    """Window starts of each segment whose ``length`` bytes are found elsewhere in the list, too."""
    sizes = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    found = repeated_places(np.frombuffer(b"\xff".join([*segments, b""]), np.uint8), length, **sort)
    # only places whose window ends inside its segment are windows
    out = []
    for a, n in zip(starts.tolist(), sizes.tolist()):
        out.append(np.flatnonzero(found[a : a + max(0, n - length + 1)]))
    return out


def _runs(starts: np.ndarray) -> list[int]:
    """Alternating first and last of the runs of consecutive numbers."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) != 1)
    firsts, lasts = starts[np.append(0, new + 1)], starts[np.append(new, len(starts) - 1)]
    return np.stack([firsts, lasts], 1).ravel().tolist()


_SEGMENT = "t1 long, t2 long, lo int, hi int, h long, g1 long, g2 long, left long, right long"


def sides(text: memoryview, first: list[int], last: list[int], place: list[int], length: int = LENGTH, gram: int = GRAM) -> tuple[list, list]:
    """Hashes of the bytes left and right of each segment's anchor, the anchor included; null where no window reaches so far."""
    half = (length - gram) // 2
    left, right = [], []
    for a, z, p in zip(first, last, place):
        for found, x, y in ((left, p - half, p + gram), (right, p, p + gram + half)):
            inside = a <= x and y <= z + length
            found.append(int.from_bytes(hashlib.md5(text[x:y], usedforsecurity=False).digest()[:8], "little", signed=True) if inside else None)
    return left, right


def _segments(length: int):
    def run(batches):
        for b in batches:
            t1, t2 = b.column(0).to_pylist(), b.column(1).to_pylist()
            out, beside = [[] for _ in range(7)], ([], [])
            for x, y, text in zip(t1, t2, b.column(2).cast(pa.large_binary()).to_pylist()):
                first, last, place, h = anchors(np.frombuffer(text, np.uint8), length)
                if not len(first):
                    continue
                view = memoryview(text)
                names = b"".join(
                    hashlib.md5(view[a : z + length], usedforsecurity=False).digest() for a, z in zip(first.tolist(), last.tolist())
                )
                g = np.frombuffer(names, np.int64).reshape(-1, 2)
                for k, v in enumerate((np.full(len(h), x), np.full(len(h), y), first.astype(np.int32), last.astype(np.int32), h, g[:, 0], g[:, 1])):
                    out[k].append(v)
                for found, v in zip(beside, sides(view, first.tolist(), last.tolist(), place.tolist(), length)):
                    found.extend(v)
            if out[0]:
                names = ["t1", "t2", "lo", "hi", "h", "g1", "g2", "left", "right"]
                columns = [pa.array(np.ascontiguousarray(np.concatenate(v))) for v in out]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, pa.int64()) for v in beside)], names)

    return run


def _shard(length: int, shard_bytes: int, spill: str):
    """Rows sorted by anchor; whole anchors are sorted together, some shard_bytes at a time."""
    schema = pa.schema([("h", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("runs", pa.list_(pa.int32()))])

    def flush(held):
        runs = [_runs(f) for f in repeated_windows([x[3] for x in held], length, spill=spill)]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in held], pa.int64()) for k in range(3)] + [pa.array(runs, pa.list_(pa.int32()))], schema=schema
        )

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                if held and row[0] != held[-1][0] and size >= shard_bytes:
                    yield flush(held)
                    held, size = [], 0
                elif held and row[:3] == held[-1][:3]:
                    continue
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(held)

    return run


def _wanted(texts: DataFrame, wanted: DataFrame, rows, schema: str) -> DataFrame:
    """What ``rows(segment)`` gives for each wanted segment (t1, t2, lo, hi, h, ...); texts are read once."""
    own = [c for c in wanted.columns if c not in ("t1", "t2")]
    want = wanted.groupBy("t1", "t2").agg(F.collect_set(F.struct(*own)).alias("want"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        held: list = []
        for b in batches:
            for raw, own in zip(b.column(0).cast(pa.large_binary()).to_pylist(), b.column(1).to_pylist()):
                for x in own:
                    held += rows(raw, x)
                    if len(held) >= 5000:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*held))), names)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*held))), names)

    return texts.join(want, ["t1", "t2"]).select("text", "want").mapInArrow(run, schema)


_WINDOW = np.dtype([("d1", np.int64), ("d2", np.int64)])


def _hot_rows(length: int):
    """(h, b, g1, g2, places, names) of a segment: its windows whose name is of group b, places and names packed."""
    def rows(raw, x):
        own = memoryview(raw)[x["lo"] : x["hi"] + length]
        g = _name(own)
        names = b"".join(hashlib.md5(own[k : k + length], usedforsecurity=False).digest() for k in range(x["hi"] - x["lo"] + 1))
        names = np.frombuffer(names, _WINDOW)
        group = (names["d1"].view(np.uint64) % np.uint64(x["pieces"])).astype(np.int64)
        out = []
        for b in np.unique(group).tolist():
            at = np.flatnonzero(group == b)
            out.append((x["h"], b, *g, at.astype(np.int32).tobytes(), names[at].tobytes()))
        return out

    return rows


def _hot_groups(batches):
    """Rows sorted by (h, b): per segment the places of windows that its group holds elsewhere, too."""
    schema = pa.schema([("h", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("runs", pa.list_(pa.int32()))])

    def flush(held):
        places = [np.frombuffer(r[4], np.int32) for r in held]
        names = np.frombuffer(b"".join(r[5] for r in held), _WINDOW)
        _, own, count = np.unique(names, return_inverse=True, return_counts=True)
        hit, cut = count[own] > 1, np.cumsum([len(p) for p in places])[:-1]
        runs = [np.repeat(p[h], 2) for p, h in zip(places, np.split(hit, cut))]
        return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in held], pa.int64()) for k in (0, 2, 3)), pa.array(runs, pa.list_(pa.int32()))], schema=schema)

    held = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and row[:2] != held[-1][:2]:
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


def _name(segment) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.md5(segment, usedforsecurity=False).digest(), np.int64).tolist())


def _cut(length: int):
    def run(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())
            for t1, t2, text, copies, ranges in rows:
                n = len(text)
                if n < length or (copies == 1 and not ranges):
                    spans = []
                elif copies > 1:
                    spans = [(0, n)]
                else:
                    r = np.array(ranges, np.int64).reshape(-1, 2)
                    r = r[np.argsort(r[:, 0], kind="stable")]
                    stop = np.maximum.accumulate(r[:, 1] + length)
                    new = np.flatnonzero(r[1:, 0] > stop[:-1])
                    spans = list(zip(r[np.append(0, new + 1), 0].tolist(), stop[np.append(new, len(r) - 1)].tolist()))
                kept, at = hashlib.sha256(), 0
                view = memoryview(text)
                for a, z in spans:
                    kept.update(view[at:a])
                    at = z
                kept.update(view[at:])
                for k, v in enumerate((t1, t2, n, sum(z - a for a, z in spans), [x for s in spans for x in s], kept.hexdigest())):
                    out[k].append(v)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["t1", "t2", "n_bytes", "n_removed", "spans", "kept_sha256"])

    return run


def _names(text):
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def duplicate_spans(
    docs: DataFrame, length: int = LENGTH, shard_bytes: int = 1 << 20, hot_bytes: int = 1 << 19, task_bytes: int = 8 << 20, broadcast_rows: int = 200_000
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256) of every row; spans are flat (from, to) byte offsets."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce("text", F.lit(""))
    named = docs.select(*_names(text), text.alias("text"))
    distinct = named.groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = bucketed(distinct, "texts", int(spark.conf.get("spark.sql.shuffle.partitions")), "t1", "t2")

    segments = materialize(texts.select("t1", "t2", "text").mapInArrow(_segments(length), _SEGMENT), "segments")
    kinds = materialize(
        segments.groupBy("h", "g1", "g2").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("t1", "t2", "lo", "hi", "left", "right"))), "kinds"
    )
    # each segment under both its sides; hashes of the two kinds of side may meet, which lets more through
    beside = [kinds.filter(F.col(c).isNotNull()).select(F.col(c).alias("side"), "t1", "t2", "lo", "hi", "h") for c in ("left", "right")]
    beside = beside[0].unionByName(beside[1])
    several = beside.groupBy("side").agg(F.count("*").alias("c")).filter("c > 1").select("side")
    wanted = materialize(beside.join(several, "side", "left_semi").drop("side").distinct(), "wanted")
    hot = wanted.groupBy("h").agg(F.sum(F.col("hi") - F.col("lo") + length).alias("b")).filter(F.col("b") > hot_bytes)
    hot = hot.select("h", F.ceil(F.col("b") / max(1, hot_bytes)).cast("long").alias("pieces"))
    hot = materialize(hot, "hot")
    n_hot = hot.count()
    total = wanted.agg(F.sum(F.col("hi") - F.col("lo") + length)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))
    if n_hot:
        few = F.broadcast(hot) if n_hot <= broadcast_rows else hot
        cold, often = wanted.join(few, "h", "left_anti"), wanted.join(few, "h")
    else:
        cold, often = wanted, None

    def segment(raw, x):
        own = raw[x["lo"] : x["hi"] + length]
        return [(x["h"], *_name(own), own)]

    sorted_ = _wanted(texts, cold, segment, "h long, g1 long, g2 long, bytes binary").repartition(tasks, "h").sortWithinPartitions("h", "g1", "g2")
    runs = sorted_.mapInArrow(_shard(length, shard_bytes, shared_dir(spark)), "h long, g1 long, g2 long, runs array<int>").filter(F.size("runs") > 0)
    if often is not None:
        each = _wanted(texts, often, _hot_rows(length), "h long, b long, g1 long, g2 long, places binary, names binary")
        met = each.repartition(tasks, "h", "b").sortWithinPartitions("h", "b").mapInArrow(_hot_groups, "h long, g1 long, g2 long, runs array<int>")
        runs = runs.unionByName(met.filter(F.size("runs") > 0))
    whole = kinds.filter("n > 1").select("h", "g1", "g2", F.array(F.lit(0), F.col("hi") - F.col("lo")).alias("runs"))
    part = runs.join(kinds.filter("n > 1").select("h", "g1", "g2"), ["h", "g1", "g2"], "left_anti")
    hits = whole.unionByName(part).select("h", "g1", "g2", "runs")
    ranges = segments.join(hits, ["h", "g1", "g2"]).select("t1", "t2", F.transform("runs", lambda x: x + F.col("lo")).alias("r"))
    ranges = ranges.groupBy("t1", "t2").agg(F.flatten(F.collect_list("r")).alias("ranges"))
    cut = texts.join(ranges, ["t1", "t2"], "left").select("t1", "t2", "text", "copies", "ranges")
    done = cut.mapInArrow(_cut(length), "t1 long, t2 long, n_bytes long, n_removed long, spans array<long>, kept_sha256 string")
    return docs.select("doc_id", *_names(text)).join(done, ["t1", "t2"]).drop("t1", "t2")
