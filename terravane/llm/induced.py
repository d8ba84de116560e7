"""External induced sorting of a shard's suffixes with common-prefix values.

After Bingmann, Fischer and Osipov, "Inducing Suffix and LCP Arrays in External Memory", 2013. Suffixes that start
smaller than their successor are S, others L; an S after an L is a seed. Seeds are sorted first: their substrings up
to the next seed are named, and where names repeat, the string of names is sorted by recursion (by prefix doubling
once it has at most ``base`` names). Two passes induce all others: going up, each suffix puts the L suffix before it
into the queue of that suffix's first byte; going down, each puts the S suffix before it. A queue's tuples (place,
common prefix with the one before) arrive in order, so its head is always the least; a whole queue is taken at
once and handled as arrays: tuples of the same first byte follow from run lengths, and common-prefix values are one
more than the range minimum between the two sources, cut at ``cap``. Queues share ``queue_bytes`` of memory and
write the rest to ``spill``, a folder of any file system that Arrow can open. In memory are the text (with 8 bytes a
place for runs) and one queue at a time.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow.fs as pafs

from terravane.llm.suffixes import first_ranks, refine

_PLACE, _LCP = np.dtype(np.int64), np.dtype(np.int16)


class Folder:
    """A folder of its own under ``spill`` (a path or a URI), made when it is first used."""

    def __init__(self, spill: str | None):
        self.spill, self.fs, self.root = spill, None, ""

    def write(self, *arrays: np.ndarray) -> str:
        if self.fs is None:
            self.fs, self.root = pafs.FileSystem.from_uri(self.spill) if ":" in self.spill else (pafs.LocalFileSystem(), self.spill)
            self.root = f"{self.root.rstrip('/')}/queues-{uuid.uuid4().hex}"
            self.fs.create_dir(self.root)
        path = f"{self.root}/{uuid.uuid4().hex}"
        with self.fs.open_output_stream(path) as out:
            for x in arrays:
                out.write(x.tobytes())
        return path

    def close(self) -> None:
        if self.fs is not None:
            self.fs.delete_dir(self.root)


class Store:
    """Queues of tuples in arrival order; those that hold most are written out when all hold more than ``limit`` bytes."""

    def __init__(self, folder: Folder, limit: int):
        self.blocks: dict = {}
        self.held: dict = {}
        self.files: dict = {}
        self.limit, self.total, self.folder = limit, 0, folder

    def push(self, queue, place: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks.setdefault(queue, []).append((place, lcp))
        size = place.nbytes + lcp.nbytes
        self.held[queue] = self.held.get(queue, 0) + size
        self.total += size
        while self.folder.spill and self.total > self.limit:
            most = max(self.held, key=self.held.get)
            place, lcp = (np.concatenate(x) for x in zip(*self.blocks.pop(most)))
            self.files.setdefault(most, []).append((self.folder.write(place, lcp), len(place)))
            self.total -= self.held.pop(most)

    def pop(self, queue) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a queue in arrival order; the queue is empty then."""
        places, lcps = [np.zeros(0, _PLACE)], [np.zeros(0, _LCP)]
        for path, n in self.files.pop(queue, []):
            with self.folder.fs.open_input_stream(path) as f:
                raw = f.read()
            places.append(np.frombuffer(raw, _PLACE, n))
            lcps.append(np.frombuffer(raw, _LCP, n, n * _PLACE.itemsize))
            self.folder.fs.delete_file(path)
        for place, lcp in self.blocks.pop(queue, []):
            places.append(place)
            lcps.append(lcp)
        self.total -= self.held.pop(queue, 0)
        return np.concatenate(places), np.concatenate(lcps)

    def __contains__(self, queue) -> bool:
        return queue in self.blocks or queue in self.files


def _minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] of each pair, both included."""
    size = last - first + 1
    if not len(size):
        return np.zeros(0, values.dtype)
    level = np.frexp(size.astype(np.float64))[1] - 1
    out, row = np.empty(len(size), values.dtype), values
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(row[first[own]], row[last[own] - (1 << k) + 1])
        if len(row) > (1 << k):
            row = np.minimum(row[: -(1 << k)], row[1 << k :])
    return out


def _grown(lcp: np.ndarray, by, cap: int) -> np.ndarray:
    return np.minimum(lcp.astype(np.int64) + by, cap).astype(_LCP)


class Heap:
    """A priority queue of number tuples that keeps ``limit`` of them in memory and the rest in sorted runs on disk.

    Runs are read ``block`` tuples at a time; their heads stand in the heap beside the tuples in memory.
    """

    def __init__(self, folder: Folder, limit: int, width: int, block: int = 4096):
        self.items, self.limit, self.width, self.block, self.runs, self.folder = [], max(4, limit), width, block, [], folder
        self.heads: list = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.items, item)
        if self.folder.spill and len(self.items) > self.limit:
            self.items.sort()
            keep = self.limit // 2
            path = self.folder.write(np.array(self.items[keep:], np.int64))
            self.runs.append([self.folder.fs.open_input_stream(path), []])
            del self.items[keep:]
            self._advance(len(self.runs) - 1)

    def _advance(self, k: int) -> None:
        file, held = self.runs[k]
        if not held:
            raw = np.frombuffer(file.read(8 * self.width * self.block), np.int64).reshape(-1, self.width)
            held.extend(map(tuple, raw[::-1].tolist()))
        if held:
            heapq.heappush(self.heads, (held.pop(), k))

    def pop(self) -> tuple | None:
        if self.heads and (not self.items or self.heads[0][0] < self.items[0]):
            item, k = heapq.heappop(self.heads)
            self._advance(k)
            return item
        return heapq.heappop(self.items) if self.items else None


def sort_names(names: np.ndarray, base: int, enough: int, folder: Folder, limit: int = 1 << 20) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rank of each suffix of ``names``, ranks by the first 1, 2, 4... names while they were told apart by doubling).

    A suffix that is over comes before any that goes on. Doubling stops after ``enough`` names; equal ranks are then
    left as they are. Recursion orders all suffixes in full and gives no levels.
    """
    n = len(names)
    if n <= base:
        rank, active = first_ranks(names)
        levels, h = [rank], 1
        while len(active) and h < enough:
            rank, active = refine(rank, active, h, None)
            h *= 2
            levels.append(rank)
        return rank, levels
    small = np.zeros(n, bool)  # S suffixes; the end is the least
    at = np.arange(n)
    edge = np.append(names[:-1] != names[1:], True)
    ahead = np.minimum.accumulate(np.where(edge, at, n)[::-1])[::-1]
    up = np.append(names[:-1] < names[1:], False)
    small = up[ahead]
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = seeds
    if len(seeds) > 1:
        ends = np.append(seeds[1:], n - 1)
        parts = [names[a : z + 1].tolist() for a, z in zip(seeds.tolist(), ends.tolist())]
        # with the types: a part that ends is greater than one that goes on with an L
        keys = [tuple(x * 2 + int(small[a + i]) for i, x in enumerate(p)) for a, p in zip(seeds.tolist(), parts)]
        keys[-1] = (*keys[-1], -1)
        place = {k: i for i, k in enumerate(sorted(set(keys)))}
        own = np.array([place[k] for k in keys], np.int64)
        rank = own if len(place) == len(keys) else sort_names(own, base, n, folder, limit)[0]
        order = seeds[np.argsort(rank, kind="stable")]
    text, is_small = names.tolist(), small.tolist()
    # going up: L suffixes, keyed by (name, arrival); the end of the string comes first
    heap, count, rising = Heap(folder, limit, 4), 0, []
    if n:
        heap.push((text[-1], 0, count, n - 1))
    for i, s in enumerate(order.tolist()):
        heap.push((text[s], 1, i, s))
    while (item := heap.pop()) is not None:
        _, kind, _, s = item
        if kind == 0:
            rising.append(s)
        if s and not is_small[s - 1]:
            count += 1
            heap.push((text[s - 1], 0, count, s - 1))
    # going down: S suffixes, keyed by (-name, arrival), before the L suffixes of their name
    heap, count, falling = Heap(folder, limit, 4), 0, []
    for i, s in enumerate(reversed(rising)):
        heap.push((-text[s], 1, i, s))
    while (item := heap.pop()) is not None:
        s = item[3]
        falling.append(s)
        if s and is_small[s - 1]:
            count += 1
            heap.push((-text[s - 1], 0, count, s - 1))
    rank = np.empty(n, np.int64)
    rank[np.array(falling[::-1], np.int64)] = np.arange(n)
    return rank, []


class Shard:
    """The text with its types, runs and 8-byte words; byte 255, which UTF-8 never has, ends each part."""

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        self.text = text
        raw = np.concatenate([text, np.zeros(16, np.uint8)])
        self.words = np.ndarray((n + 9,), dtype=">u8", buffer=raw.data, strides=(1,))
        at = np.arange(n, dtype=np.int32)
        edge = np.append(text[:-1] != text[1:], True)
        self.run_end = np.minimum.accumulate(np.where(edge, at, np.int32(n))[::-1])[::-1]
        self.run_start = np.maximum.accumulate(np.where(np.append(True, edge[:-1]), at, np.int32(0)))
        small = np.append(text[:-1] < text[1:], False)[self.run_end]
        self.seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1

    def ahead(self, place: int) -> int:
        """How often the byte at a place stands from there on."""
        return int(self.run_end[place]) - int(place) + 1


_PAD = np.array([(1 << (8 * (8 - v))) - 1 if v else (1 << 64) - 1 for v in range(9)], np.uint64)


def _seed_names(s: Shard) -> np.ndarray:
    """Ranks of the substrings from each seed to the next, both included; one that ends is greater than one that goes on."""
    size = np.append(s.seeds[1:], s.n) - s.seeds + 1

    def key(own, j):
        left = np.clip(size[own] - 8 * j, 0, 8)
        word = s.words[np.minimum(s.seeds[own] + 8 * j, s.n)].astype(np.uint64)
        return np.where(left == 8, word, word | _PAD[left])

    rank, active = first_ranks(key(np.arange(len(size)), 0))
    j = 1
    while len(active):
        # groups in which a substring goes on
        order = np.argsort(rank[active], kind="stable")
        active = active[order]
        new = np.append(True, rank[active][1:] != rank[active][:-1])
        longest = np.maximum.reduceat(size[active], np.flatnonzero(new))
        active = active[(longest > 8 * j)[np.cumsum(new) - 1]]
        if not len(active):
            break
        k = key(active, j)
        order = np.lexsort((k, rank[active]))
        a, r, k = active[order], rank[active][order], k[order]
        group = np.append(True, r[1:] != r[:-1])
        fresh = group | np.append(True, k[1:] != k[:-1])
        place = np.arange(len(a))
        rank[a] = r + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        starts = np.flatnonzero(fresh)
        count = np.diff(np.append(starts, len(a)))
        active = a[np.repeat(count, count) > 1]
        j += 1
    return rank


def _seed_order(s: Shard, cap: int, base: int, folder: Folder, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(seeds in order, common prefix of each with the one before, at most cap)."""
    if not len(s.seeds):
        return np.zeros(0, _PLACE), np.zeros(0, _LCP)
    # every seed is two bytes or more after the one before, so cap / 2 names hold cap bytes
    rank, levels = sort_names(_seed_names(s), base, cap // 2 + 1, folder, limit)
    order = np.argsort(rank, kind="stable")
    # names in common by the doubling's levels, then bytes
    x, y = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k]
        inside = (x < len(own)) & (y < len(own))
        same = np.zeros(len(x), bool)
        same[inside] = own[x[inside]] == own[y[inside]]
        x[same] += 1 << k
        y[same] += 1 << k
    ends = np.append(s.seeds, s.n)
    a0, b0 = s.seeds[order[:-1]], s.seeds[order[1:]]
    a, b = ends[np.minimum(x, len(s.seeds))], ends[np.minimum(y, len(s.seeds))]
    lcp = a - a0
    live = np.flatnonzero(lcp < cap)
    while len(live):
        p, q = a[live], b[live]
        u = s.words[np.minimum(p, s.n)].astype(np.uint64) ^ s.words[np.minimum(q, s.n)].astype(np.uint64)
        # a place past the end shares nothing
        room = np.maximum(np.minimum(s.n - p, s.n - q), 0)
        head = np.where(u == 0, 8, (64 - np.frexp(u.astype(np.float64))[1]) // 8)
        # a float rounds up near a power of two: the byte found may be one too early, never too late
        exact = np.minimum(head, 7)
        again = (u != 0) & (((u >> (np.uint64(56) - np.uint64(8) * exact.astype(np.uint64))) & np.uint64(255)) == 0)
        head = np.where(again, head + 1, head)
        step = np.minimum(head, room)
        lcp[live] += step
        a[live] += 8
        b[live] += 8
        live = live[(step == 8) & (lcp[live] < cap)]
    return s.seeds[order].astype(_PLACE), np.append(0, np.minimum(lcp, cap)).astype(_LCP)


def _same_byte(s: Shard, place: np.ndarray, lcp: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """A queue with the suffixes that its own ones induce into it: those before them in a run of its byte."""
    run = place - s.run_start[place]
    if not len(place) or not run.any():
        return place, lcp
    own = np.repeat(np.arange(len(place)), run + 1)
    back = np.arange(len(own)) - np.repeat(np.concatenate(([0], np.cumsum(run + 1)[:-1])), run + 1)
    order = np.argsort(back, kind="stable")
    own, back = own[order], back[order]
    new = np.append(True, back[1:] != back[:-1])
    out = np.empty(len(own), _LCP)
    follow = np.flatnonzero(~new)
    out[follow] = _grown(_minima(lcp, own[follow - 1] + 1, own[follow]), back[follow], cap)
    # the first with one byte more shares the whole run of the last with one less
    out[new] = np.minimum(back[new], cap).astype(_LCP)
    out[0] = lcp[0]
    return place[own] - back, out


def _induce(s: Shard, store: Store, kind: str, byte: int, place: np.ndarray, lcp: np.ndarray, cap: int) -> None:
    """Push what the scanned suffixes induce into the queues of other bytes."""
    own = np.flatnonzero(place > 0)
    before = s.text[place[own] - 1]
    hit = before > byte if kind == "L" else before < byte
    own, before = own[hit], before[hit]
    if not len(own):
        return
    order = np.argsort(before, kind="stable")
    own, before = own[order], before[order]
    new = np.append(True, before[1:] != before[:-1])
    value = np.empty(len(own), _LCP)
    follow = np.flatnonzero(~new)
    value[follow] = _grown(_minima(lcp, own[follow - 1] + 1, own[follow]), 1, cap)
    starts = np.flatnonzero(new)
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(own)]):
        queue = (kind, int(before[a]))
        value[a] = 1 if queue in store else 0
        store.push(queue, place[own[a:z]] - 1, value[a:z])


def repeated_places(text: np.ndarray, cap: int, base: int = 1 << 24, queue_bytes: int = 256 << 20, spill: str | None = None) -> np.ndarray:
    """Whether each suffix of ``text`` has a neighbour in the order with cap bytes in common. The text ends with byte 255."""
    s, found = Shard(text), np.zeros(len(text), bool)
    folder = Folder(spill)
    seeds, seed_lcp = _seed_order(s, cap, base, folder, queue_bytes // 64)
    cut = np.searchsorted(s.text[seeds].astype(np.int64), np.arange(257))
    store = Store(folder, queue_bytes)

    def seam(low: np.ndarray, high: np.ndarray) -> int:
        """Bytes in common of the greatest L and the least S suffix of a byte."""
        return min(cap, s.ahead(low[-1]), s.ahead(high[0])) if len(low) and len(high) else 0

    def mark(place: np.ndarray, lcp: np.ndarray) -> None:
        hit = np.flatnonzero(lcp >= cap)
        found[place[hit]] = True
        found[place[hit - 1]] = True

    store.push(("L", int(text[-1])), np.array([s.n - 1], _PLACE), np.zeros(1, _LCP))
    for byte in range(256):
        place, lcp = _same_byte(s, *store.pop(("L", byte)), cap)
        mark(place, lcp)
        own, own_lcp = seeds[cut[byte] : cut[byte + 1]], seed_lcp[cut[byte] : cut[byte + 1]].copy()
        if len(own):
            own_lcp[0] = seam(place, own)
        _induce(s, store, "L", byte, np.concatenate([place, own]), np.concatenate([lcp, own_lcp]), cap)
        if len(place):
            store.push(("up", byte), place, lcp)
    for byte in range(255, -1, -1):
        place, lcp = _same_byte(s, *store.pop(("S", byte)), cap)
        mark(place, lcp)
        low, low_lcp = store.pop(("up", byte))
        both = seam(low, place[::-1])
        if both >= cap:
            found[[low[-1], place[-1]]] = True
        down = np.append(both, low_lcp[:0:-1]).astype(_LCP)[: len(low)]
        _induce(s, store, "S", byte, np.concatenate([place, low[::-1]]), np.concatenate([lcp, down]), cap)
    folder.close()
    return found
