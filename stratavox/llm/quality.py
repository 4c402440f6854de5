"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are counted in bulk over a batch's bytes. Trees are grown on binned statistics
of a bounded labelled sample and flattened into arrays, which numpy walks for all rows of
a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.labelled import fold, label_sample, sigmoid
from stratavox.llm.store import batchwise, give_back, table
from stratavox.llm.words import SLICE_BYTES, SPACED, Words, ngram_hashes, slices

PARTS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Labelled rows that may be fitted on.
MAX_TRAIN = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 80, 4, 64, 0.15, 20, 1.0

_LOWER, _UPPER, _DIGIT, _SPACE, _NEWLINE, _BEYOND, _STOP, _COMMA, _BAR, _BANG, _MARK, _QUOTE, _OTHER = range(13)
_KINDS = 13


def _kinds() -> np.ndarray:
    out = np.full(256, _OTHER, dtype=np.int64)
    out[ord("a") : ord("z") + 1] = _LOWER
    out[ord("A") : ord("Z") + 1] = _UPPER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[[32, 9, 11, 12, 13]] = _SPACE
    out[10] = _NEWLINE
    out[128:] = _BEYOND
    for chars, kind in ((".", _STOP), (",;:", _COMMA), ("|", _BAR), ("!?", _BANG), ("#$%&*@^~", _MARK), ("\"'`()[]{}<>", _QUOTE)):
        out[[ord(c) for c in chars]] = kind
    return out


_KIND = _kinds()
STATISTICS = _KINDS + 11


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the count of the commonest key, by document."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    if n == 1:
        ordered = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        return np.array([len(at) - 1.0]), np.array([np.diff(at).max()], dtype=float)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(k))))
    return np.bincount(d[at], minlength=n).astype(float), most


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics per document of a slice; an empty text has zeros."""
    n = len(off) - 1
    size = np.diff(off)
    counts = np.zeros(n * _KINDS, dtype=np.int64)
    for a in range(0, len(raw), SLICE_BYTES):
        b = min(a + SLICE_BYTES, len(raw))
        low, high = np.searchsorted(off, a, side="right") - 1, np.searchsorted(off, b)
        doc_of_byte = np.repeat(np.arange(low, high), np.diff(np.clip(off[low : high + 1], a, b)))
        counts += np.bincount(doc_of_byte * _KINDS + _KIND[raw[a:b]], minlength=n * _KINDS)
    counts = counts.reshape(n, _KINDS)
    w = Words(raw, off, SPACED)
    c = w.counts()
    doc = np.repeat(np.arange(n), c)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(doc, length, n) / np.maximum(c, 1)
    spread = np.sqrt(np.maximum(0, np.bincount(doc, length**2, n) / np.maximum(c, 1) - mean**2))
    distinct, commonest = _distinct(w.hash, doc, n)
    grams = ngram_hashes(w.hash, 3)
    inside = doc[: len(grams)] == doc[len(doc) - len(grams) :]
    in_grams = np.bincount(doc[: len(grams)][inside], minlength=n)
    gram_distinct, gram_commonest = _distinct(grams[inside], doc[: len(grams)][inside], n)
    first, last = raw[w.start], raw[w.end - 1]
    capital = np.bincount(doc[(first >= 65) & (first <= 90)], minlength=n)
    no_letter_end = np.bincount(doc[_KIND[last] >= _STOP], minlength=n)
    lines = counts[:, _NEWLINE] + 1.0
    out = np.column_stack(
        [
            counts / np.maximum(size, 1)[:, None],
            np.log1p(size),
            np.log1p(c),
            mean,
            spread,
            distinct / np.maximum(c, 1),
            commonest / np.maximum(c, 1),
            gram_distinct / np.maximum(in_grams, 1),
            gram_commonest / np.maximum(in_grams, 1),
            capital / np.maximum(c, 1),
            no_letter_end / np.maximum(c, 1),
            np.log1p(size / lines),
        ]
    )
    out[size == 0] = 0
    return out


@dataclass
class Forest:
    """Nodes of all trees in shared arrays; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[row, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node]
        return sigmoid(total)


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost ``TREES`` trees under logistic loss, level by level over histograms.

    With one label only, or no rows, the forest is a constant: the smoothed mean label.
    """
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
        total = np.full(len(y), base)
        for _ in range(TREES):
            p = sigmoid(total)
            gradient, weight = p - y, p * (1 - p)
            root = len(feature)
            roots.append(root)
            where = np.full(len(y), root)
            level = [root]
            for new in (feature, cut, left, right, value):
                new.append(0.0)
            left[root] = right[root] = root
            for depth in range(DEPTH + 1):
                below = []
                for node in level:
                    rows = np.flatnonzero(where == node)
                    g, h = gradient[rows].sum(), weight[rows].sum()
                    value[node] = -RATE * g / (h + RIDGE)
                    if depth == DEPTH or len(rows) < 2 * LEAST_ROWS:
                        continue
                    best = (1e-6, 0, 0)
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[rows, f]
                        gl = np.cumsum(np.bincount(b, gradient[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, weight[rows], len(e) + 1))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                        gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                        gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = 0
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (gain[k], f, k)
                    if best[0] <= 1e-6:
                        continue
                    _, f, k = best
                    feature[node], cut[node] = f, edges[f][k]
                    for side in (left, right):
                        side[node] = len(feature)
                        below.append(len(feature))
                        for new in (feature, cut, left, right, value):
                            new.append(0.0)
                        left[-1] = right[-1] = side[node]
                    goes_left = binned[rows, f] <= k
                    where[rows] = np.where(goes_left, left[node], right[node])
                level = below
            total += np.array(value)[where]
    return Forest(np.array(feature, int), np.array(cut, float), np.array(left, int), np.array(right, int), np.array(value, float), np.array(roots, int), base)


def _of(texts: pa.Array) -> np.ndarray:
    parts = [statistics(raw, off) for _, _, raw, off in slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, STATISTICS))


def fit(docs: DataFrame, labels: DataFrame) -> Forest:
    """Train on at most about MAX_TRAIN labelled rows outside the held-out fold, chosen by a hash.

    Only the sample's statistics, a bounded number of short rows, reach the driver.
    """
    sample = label_sample(labels, "quality", PARTS, HELD_OUT, MAX_TRAIN)

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _of(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    n = rows.count()
    if n > 2 * MAX_TRAIN:  # ids that many rows repeat
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(MAX_TRAIN / n * (1 << 30)))
    t = rows.select("text", "y").mapInArrow(batchwise(measure), "x array<double>, y int").toArrow()
    x, y = t.column("x").combine_chunks().flatten().to_numpy().reshape(len(t), STATISTICS), t.column("y").to_numpy().astype(float)
    order = np.lexsort((y, *x.T[::-1]))
    forest = grow(x[order], y[order])
    del t, x, y
    give_back()
    return forest


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score per row of ``docs``; null and empty texts score as a document of zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_of(batch.column(1))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batchwise(run), f"doc_id {kind}, score double")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score under ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    where = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(shared.value.score(_of(batch.column(where))) >= threshold))

    return docs.mapInArrow(batchwise(run), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id",
        (fold("doc_id", PARTS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
