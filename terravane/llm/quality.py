r"""Quality rules with a suffix-array repetition rule.

Base rules fail a text of fewer than ``min_words`` words, or one in which the words of 3-word windows found
twice or more make up over half. The repetition rule sorts the word suffixes of each text; neighbours in
that order give the longest-common-prefix intervals, that is, the maximal repeated word sequences. Those of
``min_repeat`` words or more are united as spans; a text goes if they cover more than ``max_covered`` of its
words or if one of them has more than ``max_longest`` words. Texts of a batch are sorted together under
keys that hold the text's number, so that no repeat crosses texts.

Thresholds. The base rule catches most repetition. Of the 8,884 texts of the sf0.1 tables that pass it, 12 have over 5
percent of their words covered, 6 over 10, one over 20 and none a repeat of more than 13 words; texts that the labels
call good reach 18 percent. So a fifth of the words, or a paragraph of 100 words said twice, is too much.

Rows: null and empty texts have no words and fail the base rules. Other columns are not read; repeated
rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terravane.llm.suffixes import first_ranks, refine
from terravane.runtime import ship

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "covered_words long, longest_repeat long, kept boolean"
)


def repeated_words(docs: list[np.ndarray], min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words in repeated 3-word windows, words covered by repeats of min_repeat words, longest repeat."""
    lens = np.array([len(d) for d in docs], np.int64)
    n, zero = int(lens.sum()), np.zeros(len(docs), np.int64)
    if not n:
        return zero, zero.copy(), zero.copy()
    doc = np.repeat(np.arange(len(docs)), lens)
    end = np.repeat(np.cumsum(lens), lens)
    words = np.concatenate(docs).astype(np.int64)
    rank, active = first_ranks(doc * (int(words.max()) + 1) + words)
    levels, h = [rank], 1
    three = np.zeros(n + 1, np.int64)
    while len(active):
        rank, active = refine(rank, active, h, end)
        # suffixes at the text's end have no full window; their ranks are single by now
        levels.append(rank)
        h *= 2
        if h == 2 and len(active):
            full = active[active + 3 <= end[active]]
            keys = np.stack([rank[full], levels[0][full + 2]], 1)
            if len(full):
                order = np.lexsort((keys[:, 1], keys[:, 0]))
                k = keys[order]
                same = np.zeros(len(k), bool)
                eq = (k[1:] == k[:-1]).all(1)
                same[1:] |= eq
                same[:-1] |= eq
                hit = full[order][same]
                np.add.at(three, hit, 1)
                np.add.at(three, hit + 3, -1)
    in_three = np.cumsum(three)[:n] > 0
    # neighbours: suffixes in final order; only those whose first two words repeat can share min_repeat words
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    near = doc[a] == doc[b]
    a, b = a[near], b[near]
    lcp, left = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[left] + lcp[left], b[left] + lcp[left]
        ok = (x < end[a[left]]) & (y < end[b[left]])
        eq = ok & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        lcp[left[eq]] += 1 << k
    best = np.zeros(n, np.int64)
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    longest = np.zeros(len(docs), np.int64)
    np.maximum.at(longest, doc, best)
    start = np.flatnonzero(best >= min_repeat)
    span = np.zeros(n + 1, np.int64)
    np.add.at(span, start, 1)
    np.add.at(span, start + best[start], -1)
    covered = np.cumsum(span)[:n] > 0
    count = lambda x: np.bincount(doc[x], minlength=len(docs)).astype(np.int64)
    return count(in_three), count(covered), longest


def _judge(texts: list[str | None], min_words: int, min_repeat: int, max_covered: float, max_longest: int) -> dict:
    numbers: dict[bytes, int] = {}
    ids, chars, symbols, dup_lines = [], [], [], []
    for t in texts:
        raw = (t or "").encode()
        w = raw.split()
        ids.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in w), np.int64, len(w)))
        spaces = len(raw) - len(raw.translate(None, _SPACE))
        chars.append(len(t or "") - spaces)
        symbols.append(len(raw) - len(raw.translate(None, _SYMBOLS)))
        lines = [x for x in raw.split(b"\n") if x.split()]
        dup_lines.append(len(lines) - len(set(lines)))
    n = np.array([len(x) for x in ids], np.int64)
    three, covered, longest = repeated_words(ids, min_repeat)
    failed = (n < min_words) | (100 * three > 50 * n)
    kept = ~failed & (covered <= max_covered * n) & (longest <= max_longest)
    return {
        "n_words": n,
        "word_chars": np.array(chars, np.int64),
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": three,
        "base_failed": failed,
        "covered_words": covered,
        "longest_repeat": longest,
        "kept": kept,
    }


def judge(
    docs: DataFrame, min_words: int = 50, min_repeat: int = 10, max_covered: float = 0.2, max_longest: int = 100, batch_bytes: int = 2 << 20
) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (doc_id, text). batch_bytes bounds the texts sorted at once."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts, at = b.column(1).to_pylist(), 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to] or "") <= batch_bytes):
                    held += len(texts[to] or "")
                    to += 1
                found = _judge(texts[at:to], min_words, min_repeat, max_covered, max_longest)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *map(pa.array, found.values())], ["doc_id", *found])
                at = to

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
