"""Toxicity scores from the nearest labelled texts by exact TF-IDF cosine.

Fit. At most ``max_pos`` toxic and ``max_neg`` other labelled rows, those with the smallest hashes of the
doc_id, form the labelled set; every word of theirs is a term. A term's weight is its inverse document
frequency, counted over all documents, times its relevance z^2 / (z^2 + 100) + 0.01, where z compares how
often toxic and other labelled rows have it (zero if it leans to the others): so words that tell the
classes apart make the distance, and no term is left out. What the driver holds is bounded by the two row
numbers; nothing else grows with the corpus.

Search. The index keeps, per term, postings in blocks of consecutive rows with each block's largest weight.
A text's blocks with the greatest upper bounds are scored first; then every block whose bound reaches the
k-th best cosine found. So the k nearest are exact. Rows that tie for the last places share them evenly:
neither order nor doc_id decides.

Score. The share of toxic votes, each weighted by its cosine and by how many labelled rows its class member
stands for, with one prior vote of the base rate; a text without terms has that rate. The share is mapped to
a probability by a logistic curve (Platt), fitted on the labelled rows, each scored without itself.

Rows: null and empty texts have no terms. Repeated rows are scored alike. A label other than 0 or 1 and a
null doc_id teach nothing; conflicting labels of a doc_id count as toxic. A doc_id may be of any type.
``with_scores`` replaces input columns of its own output names; ``drop_toxic`` keeps them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.runtime import lean, ship

THRESHOLD = 0.3
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one range after the other."""
    size = ends - starts
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - np.concatenate(([0], np.cumsum(size)[:-1]))
    return np.repeat(shift, size) + np.arange(total)


class Index:
    """Block-max inverted index over unit vectors, given as flat postings; row r is in block r // block.

    The postings of the ``max_dense`` most frequent terms (if a fiftieth of the rows has them) are held as a dense
    matrix, which a batch of texts multiplies at once; all others as runs per term and block with their maxima.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int, n_terms: int, block: int = 32, max_dense: int = 512):
        self.n_rows, self.block, self.blocks = n_rows, block, max(1, -(-n_rows // block))
        order = np.lexsort((row, term))
        row, term, weight = row[order], term[order], weight[order]
        held = np.bincount(term, minlength=n_terms)
        often = np.argsort(-held, kind="stable")[:max_dense]
        often = often[held[often] * 50 > n_rows]
        self.slot = np.full(n_terms, -1, np.int32)
        self.slot[often] = np.arange(len(often))
        own = self.slot[term]
        self.dense = np.zeros((len(often), self.blocks * block))
        self.dense[own[own >= 0], row[own >= 0]] = weight[own >= 0]
        row, term, weight = row[own < 0], term[own < 0], weight[own < 0]
        self.row, self.weight = row.astype(np.int32), weight
        own = row // block
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        self.first = np.append(at, len(term))
        self.entry_block = own[at].astype(np.int32)
        self.top = np.maximum.reduceat(weight, at) if len(at) else np.zeros(0)
        self.of_term = np.searchsorted(term[at], np.arange(n_terms + 1))

    def _add(self, cos: np.ndarray, entries: np.ndarray, q: np.ndarray) -> None:
        a, z = self.first[entries], self.first[entries + 1]
        at = _ranges(a, z)
        cos += np.bincount(self.row[at], np.repeat(q, z - a) * self.weight[at], len(cos))

    def _bar(self, cos: np.ndarray, k: int) -> float:
        return float(np.partition(cos, len(cos) - k)[len(cos) - k]) if k < len(cos) else 0.0

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None):
        """For each vector (terms, weights): rows and cosines of the k nearest with a cosine over zero, best first, all that tie
        for the last place included; ``skip`` names a row of each that is left out."""
        often = np.zeros((len(vectors), len(self.dense)))
        for i, (terms, q) in enumerate(vectors):
            slot = self.slot[terms]
            often[i, slot[slot >= 0]] = q[slot >= 0]
        often = often @ self.dense
        for i, (terms, q) in enumerate(vectors):
            cos, rare = often[i], self.slot[terms] < 0
            a, z = self.of_term[terms[rare]], self.of_term[terms[rare] + 1]
            entries, q = _ranges(a, z), np.repeat(q[rare], z - a)
            if skip is not None:
                cos[skip[i]] = -2.0
            if len(entries):
                own = self.entry_block[entries]
                upper = np.bincount(own, q * self.top[entries], self.blocks)
                bound = cos.reshape(self.blocks, self.block).max(1) + upper
                lead = np.zeros(self.blocks, bool)
                lead[np.argsort(-bound, kind="stable")[: -(-2 * k // self.block) + 1]] = True
                hit = lead[own]
                self._add(cos, entries[hit], q[hit])
                # cosines without their rare terms are too low, so this bar is safe
                rest = ~lead & (upper > 0) & (bound >= self._bar(cos, k) - 1e-9)
                if rest.any():
                    hit = rest[own]
                    self._add(cos, entries[hit], q[hit])
            bar = max(self._bar(cos, k), 1e-9)
            found = np.flatnonzero(cos >= bar - 1e-9)
            near = np.round(cos[found], 9)
            keep = near >= np.round(bar, 9)
            found, near = found[keep], near[keep]
            order = np.argsort(-near, kind="stable")
            yield found[order], near[order]


@dataclass
class Model:
    terms: dict[str, int]
    idf: np.ndarray  # weight of each term: idf times relevance
    index: Index | None
    labels: np.ndarray
    weights: np.ndarray
    doc_ids: list
    prior: float
    k: int = 15
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        norm = math.sqrt(float(w @ w))
        return terms, w / norm if norm else w

    def vector_of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        known = self.terms
        found = [(known[w], n) for w, n in Counter(words(text)).items() if w in known]
        found.sort()
        both = np.array(found, np.int64).reshape(-1, 2)
        return self.vector(both[:, 0], both[:, 1])

    def votes(self, vectors: list, skip: list[int] | None = None):
        """(share of toxic votes, rows and cosines of the nearest) of each vector."""
        for ids, cos in self.index.nearest(vectors, self.k, skip):
            part = np.ones(len(ids))
            if len(ids) > self.k:
                tied = cos == cos[-1]
                part[tied] = (self.k - (~tied).sum()) / tied.sum()
            w = part * cos * self.weights[ids]
            yield float((math.fsum(w * self.labels[ids]) + self.prior) / (math.fsum(w) + 1.0)), ids, cos

    def calibrated(self, share: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * _logit(share) + self.shift))))

    def score(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        out = []
        for at in range(0, len(texts), 128):
            found = self.votes([self.vector_of(t) for t in texts[at : at + 128]])
            out += [(self.calibrated(share), ids, cos) for share, ids, cos in found]
        return out


def _logit(p: float) -> float:
    p = min(1 - 1e-4, max(1e-4, p))
    return math.log(p / (1 - p))


def platt(shares: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through weighted labels, by Newton's method; the slope is positive."""
    x, y, w = np.array([_logit(s) for s in shares]), labels, weights / weights.sum()
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d, h = w * (p - y), w * p * (1 - p) + 1e-9
        g = np.array([(d * x).sum() + 1e-3 * (a - 1), d.sum()])
        m = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum()]])
        step = np.linalg.solve(m, g)
        a, b = max(1e-3, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_set(labels: DataFrame, max_pos: int, max_neg: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, toxic) of the rows to learn from, and how many labelled rows one of each class stands for."""
    own = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [own.filter(F.col("toxic") == c).orderBy(*order).limit(n) for c, n in ((1, max_pos), (0, max_neg))]
    caps = {1: max_pos, 0: max_neg}
    return picked[0].unionByName(picked[1]), {c: max(1.0, total.get(c, 0) / caps[c]) for c in (0, 1)}


def relevance(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """z^2 / (z^2 + 100) + 0.01 of each term, z from the shares of toxic and of other rows that have it; z is 0 where it is negative."""
    if not n0 or not n1:
        return np.full(len(pos), 0.01)
    both = (pos + neg) / (n0 + n1)
    z = (pos / n1 - neg / n0) / np.sqrt(both * (1 - both) * (1 / n0 + 1 / n1) + 1e-12)
    z2 = np.maximum(z, 0.0) ** 2
    return z2 / (z2 + 100) + 0.01


def fit(docs: DataFrame, labels: DataFrame, max_pos: int = 800, max_neg: int = 1600, k: int = 15) -> Model:
    """Learn from the labelled rows that are not held out; count document frequencies over all of ``docs``."""
    ship(docs.sparkSession)
    picked, stands_for = labelled_set(labels, max_pos, max_neg)
    picked = picked.select(F.col("doc_id").alias("_id"), "toxic")  # max_pos + max_neg rows at most
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))

    def counted(batches):
        for b in batches:
            found = [sorted(Counter(words(t)).items()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([[w for w, _ in f] for f in found], pa.list_(pa.string())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32()))],
                ["doc_id", "toxic", "w", "n"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "toxic").mapInArrow(lean(counted), f"doc_id {kind}, toxic int, w array<string>, n array<int>").toArrow().combine_chunks()
    toxic = np.array(rows["toxic"].to_pylist(), np.int64)
    size = np.array([len(x) for x in rows["n"].to_pylist()], np.int64)
    flat = [x.flatten() for c in ("w", "n") for x in [rows[c].combine_chunks()]]
    coded = flat[0].dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    terms: dict[str, int] = {names[i]: k_ for k_, i in enumerate(order)}
    term, count = place[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64), flat[1].to_numpy(zero_copy_only=False).astype(np.int64)

    shared = docs.sparkSession.sparkContext.broadcast(terms)  # the words of max_pos + max_neg rows; workers hold it once

    def frequency(batches):
        terms, df, n = shared.value, Counter(), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                df.update(terms.keys() & set(words(text)))
                n += 1
        yield pa.RecordBatch.from_pydict({"t": pa.array([-1, *(terms[w] for w in df)], pa.int32()), "n": pa.array([n, *df.values()], pa.int64())})

    seen = docs.select("text").mapInArrow(lean(frequency), "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1)
    df[seen["t"].to_numpy()] = seen["n"].to_numpy()  # -1, the last place, is the number of documents
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    row = np.repeat(np.arange(len(size)), size)
    by_class = [np.bincount(term[toxic[row] == c], minlength=len(terms)) for c in (0, 1)]
    weight = idf * relevance(by_class[1], by_class[0], int(toxic.sum()), int((toxic == 0).sum()))
    model = Model(terms, weight, None, np.zeros(0), np.zeros(0), [], 0.0, k)
    ends = np.concatenate(([0], np.cumsum(size)))
    vectors = [model.vector(term[a:z], count[a:z]) for a, z in zip(ends[:-1], ends[1:])]
    # rows with a like strongest term side by side make tight block maxima
    lead = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
    ids = rows["doc_id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (toxic[i], lead[i], str(ids[i]), vectors[i][0].tobytes()))
    vectors = [vectors[i] for i in order]
    join = lambda j, kind: np.concatenate([v[j] for v in vectors]) if vectors else np.zeros(0, kind)
    model.index = Index(np.repeat(np.arange(len(order)), size[order] if order else size), join(0, np.int64), join(1, float), len(order), len(terms))
    model.labels = toxic[order].astype(float) if order else np.zeros(0)
    model.weights = np.array([stands_for[int(c)] for c in model.labels], float)
    model.doc_ids = [ids[i] for i in order]
    if order:
        model.prior = float((model.weights * model.labels).sum() / model.weights.sum())
        if 0 < model.labels.sum() < len(order):
            shares = [x[0] for at in range(0, len(order), 128) for x in model.votes(vectors[at : at + 128], list(range(at, min(at + 128, len(order)))))]
            model.slope, model.shift = platt(np.array(shares), model.labels, model.weights)
    return model


def with_scores(docs: DataFrame, model: Model, text: str = "text", evidence: int = 3) -> DataFrame:
    """``docs`` with score, evidence_ids (as text) and evidence_cosines (the nearest labelled rows)."""
    ship(docs.sparkSession)
    docs = docs.drop(*({"score", "evidence_ids", "evidence_cosines"} - {text}))
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled rows; workers hold it once

    def run(batches):
        model = shared.value
        for b in batches:
            found = model.score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array([x[0] for x in found], pa.float64()),
                    pa.array([[str(model.doc_ids[i]) for i in x[1][:evidence]] for x in found], pa.list_(pa.string())),
                    pa.array([x[2][:evidence].tolist() for x in found], pa.list_(pa.float64())),
                ],
                [*b.schema.names, "score", "evidence_ids", "evidence_cosines"],
            )

    out = docs.select("*", F.lit(0.0).alias("score"), F.array(F.lit("")).alias("evidence_ids"), F.array(F.lit(0.0)).alias("evidence_cosines"))
    return docs.mapInArrow(lean(run), out.schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    names = docs.columns
    taken = {"score", "evidence_ids", "evidence_cosines"} & set(names)
    slim = docs.select(*(F.col(c).alias(f"_own_{c}") if c in taken else F.col(c) for c in names))
    kept = with_scores(slim, model).filter(F.col("score") < threshold)
    return kept.select(*(F.col(f"_own_{c}").alias(c) if c in taken else F.col(c) for c in names))
