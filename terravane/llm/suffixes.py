"""Suffix ranks of integer or byte sequences by prefix doubling, in numpy.

Ranks are group starts (Larsson and Sadakane), so that a round sorts only the suffixes whose prefix still
repeats.
"""

from __future__ import annotations

import numpy as np


def first_ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each suffix by its key, the suffixes whose key repeats)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    start = np.repeat(at, np.diff(np.append(at, len(k))))
    rank = np.empty(len(k), np.int64)
    rank[order] = start
    size = np.repeat(np.diff(np.append(at, len(k))), np.diff(np.append(at, len(k))))
    return rank, order[size > 1]


def refine(rank: np.ndarray, active: np.ndarray, step: int, end: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by a prefix ``step`` longer, from ranks that hold for ``step`` or more; active suffixes only.

    ``end`` is the end of each suffix's own sequence; a suffix that is over ranks below any that goes on.
    """
    nxt = active + step
    inside = nxt < (len(rank) if end is None else end[active])
    second = np.where(inside, rank[np.minimum(nxt, len(rank) - 1)], -1)
    order = np.lexsort((second, rank[active]))
    a, r, s = active[order], rank[active][order], second[order]
    new_group = np.ones(len(a), bool)
    new_group[1:] = r[1:] != r[:-1]
    new = new_group.copy()
    new[1:] |= s[1:] != s[:-1]
    at = np.arange(len(a))
    base = np.maximum.accumulate(np.where(new_group, at, 0))
    start = np.maximum.accumulate(np.where(new, at, 0))
    out = rank.copy()
    out[a] = r + (start - base)
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(a)))
    return out, a[np.repeat(size, size) > 1]
