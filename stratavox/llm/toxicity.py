"""Toxicity by compression distance.

Two dictionaries are trained by zstandard's trainer: one on ordinary text, one on toxic
text. Every window of a few words is compressed with the ordinary dictionary alone and with
both; the bytes that the toxic one saves speak for toxicity. A document's best windows go
through a logistic calibration fitted on rows that trained no dictionary.

The trainer knows no contrast, and toxic documents are mostly ordinary text: trained on
whole documents the two dictionaries hardly differ (see the README for figures). So the
toxic samples are those passages of toxic documents whose byte runs ordinary ones lack.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.labelled import fit_logistic, fold, label_sample, sigmoid
from stratavox.llm.store import batchwise, give_back, table
from stratavox.llm.words import SPACED, U64, Words, ngram_hashes, slices

PARTS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Labelled rows that may be fitted on, and bytes of their texts in all, about.
MAX_TRAIN, MAX_TRAIN_BYTES = 16_000, 24 << 20
#: Words in a window and words from one window to the next.
WINDOW, STRIDE = 6, 3
LEVEL = 3
#: Windows compressed at once.
_AT_ONCE = 1 << 16
#: Sizes of the dictionaries, the trainer's segments for them, and bytes of an ordinary sample.
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_SEGMENT, TOXIC_SEGMENT, SAMPLE = 64 << 10, 4 << 10, 64, 24, 160
#: Times that a run of bytes must be as common in toxic documents as in ordinary ones to be a sample.
CONTRAST = 40.0
#: Toxic rows are few: how far scores suppose their share, by odds, from the sample's (0) to an even one (1).
PRIOR_SHIFT = 0.65
#: Parts that the calibration measures in turn.
FOLDS = 3
FEATURES = 5
#: Runs by which copies among the training rows are known.
SKETCH = 32
_GRAM, _GRAM_BITS = 5, 22

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[[9, 10, 11, 12, 13]] = 32


@dataclass
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None
    prior: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.ordinary, self.ordinary + self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))
        return out


def _lengths(compressor: zstandard.ZstdCompressor, data: bytes, segments: bytes) -> np.ndarray:
    packed = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments), threads=1)
    return np.fromiter((len(packed[i]) for i in range(len(packed))), dtype=np.int64, count=len(packed))


def _windows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and length of every window, and windows per document; all words are covered."""
    w = Words(raw, off, SPACED, hashed=False)
    c = w.counts()
    n = np.where(c > 0, 1 + np.maximum(0, -(-(c - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    a = w.first[doc] + nth * STRIDE
    b = np.minimum(a + WINDOW, w.first[doc + 1]) - 1
    start = np.maximum(w.start[a] - 1, off[doc]) if len(doc) else np.zeros(0, int)
    return start, (w.end[b] - start if len(doc) else start), n


def _gains(folded: np.ndarray, start: np.ndarray, size: np.ndarray, pair: list[zstandard.ZstdCompressor]) -> Iterator[tuple[int, np.ndarray]]:
    """Bytes that the toxic dictionary saves, for some windows at a time: (first window, gains)."""
    for i in range(0, len(start), _AT_ONCE):
        first, sizes = start[i : i + _AT_ONCE].astype(np.int64), size[i : i + _AT_ONCE]
        low, high = int(first[0]), int((first + sizes).max())
        segments = np.column_stack([first - low, sizes]).astype("<u8").tobytes()
        data = folded[low:high].tobytes()
        yield i, _lengths(pair[0], data, segments) - _lengths(pair[1], data, segments)


def features(raw: np.ndarray, off: np.ndarray, pair: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Per document: the best three windows, strong windows, and the logarithm of all."""
    folded = _FOLDED[raw]
    start, size, n = _windows(folded, off)
    out = np.zeros((len(n), FEATURES))
    ends = np.cumsum(n)
    for i, gain in _gains(folded, start, size, pair):
        doc = np.searchsorted(ends, np.arange(i, i + len(gain)), side="right")
        order = np.lexsort((-gain, doc))
        here, first, many = np.unique(doc, return_index=True, return_counts=True)
        best = np.zeros((len(here), 6))
        best[:, :3] = out[here, :3]
        for k in range(3):
            has = many > k
            best[has, 3 + k] = gain[order[first[has] + k]]
        out[here, :3] = -np.sort(-np.maximum(best, 0), axis=1)[:, :3]
        out[:, 3] += np.bincount(doc[gain >= 5], minlength=len(n))
    out[:, 3:] = np.log1p(np.column_stack([out[:, 3], n]))
    return out


def _grams(b: np.ndarray) -> np.ndarray:
    h = np.zeros(max(0, len(b) - _GRAM + 1), dtype=U64)
    for j in range(_GRAM):
        h = h * U64(0x100000001B3) + b[j : j + len(h)]
    return ((h * U64(0x9E3779B97F4A7C15)) >> U64(64 - _GRAM_BITS)).astype(np.uint32)


def _folded(text: str) -> np.ndarray:
    return _FOLDED[np.frombuffer(f" {text} ".encode(), dtype=np.uint8)]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary by zstandard's trainer; of too few samples for it, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or b" " * 16)[-size:]


def _passages(toxic: list[np.ndarray], ordinary_df: np.ndarray, toxic_df: np.ndarray, n_ordinary: int) -> list[bytes]:
    """Runs of byte 5-grams in toxic documents that are common in them and rare in ordinary ones, each as often as it is there.

    Zeros after each keep the trainer's segments from running on into the next.
    """
    common = np.flatnonzero(toxic_df >= max(4, 0.008 * len(toxic)))
    strong = np.zeros(len(toxic_df), dtype=bool)
    strong[common] = (toxic_df[common] + 0.5) / (len(toxic) + 1) > CONTRAST * (ordinary_df[common] + 0.5) / (n_ordinary + 1)
    out = []
    for b in toxic:
        edge = np.diff(np.concatenate([[0], strong[_grams(b)].astype(np.int8), [0]]))
        out += [b[i : j + _GRAM - 1].tobytes() + bytes(4) for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    times = Counter(out)
    return [p for p in out if times[p] >= 3]


@dataclass
class _Row:
    """A training row: its folded bytes, distinct byte runs, and label."""

    folded: np.ndarray
    grams: np.ndarray
    y: int


def _document_counts(rows: list[_Row]) -> np.ndarray:
    out = np.zeros(1 << _GRAM_BITS, dtype=np.int32)
    for r in rows:
        out[r.grams] += 1
    return out


def _dictionaries(rows: list[_Row], prior: float) -> ToxicModel:
    ordinary, toxic = ([r for r in rows if r.y == label] for label in (0, 1))
    pieces = [r.folded[i : i + SAMPLE].tobytes() for r in ordinary for i in range(0, len(r.folded), SAMPLE)]
    passages = _passages([r.folded for r in toxic], _document_counts(ordinary), _document_counts(toxic), len(ordinary))
    return ToxicModel(_trained([p for p in pieces if len(p) >= 16], ORDINARY_BYTES, ORDINARY_SEGMENT), _trained(passages, TOXIC_BYTES, TOXIC_SEGMENT) if passages else b"", None, prior)


def _without_copies(rows: list[tuple[str, int, object]]) -> list[tuple[str, int, object]]:
    """Rows without near copies of earlier ones, which would make any of their text look common.

    A copy is known by its least hashed 5-word runs, half of which an earlier row has.
    """
    seen: set[int] = set()
    out = []
    for row in rows:
        raw = np.frombuffer(row[0].encode(), dtype=np.uint8)
        least = set(np.unique(ngram_hashes(Words(raw, np.array([0, len(raw)]), SPACED).hash, 5))[:SKETCH].tolist())
        if 2 * len(least & seen) <= len(least):
            out.append(row)
        seen |= least
    return out


def train(rows: list[tuple[object, str, int]]) -> ToxicModel:
    """Fit on (doc_id, text, label) rows without copies.

    For the calibration the rows are split in FOLDS: each part is measured with dictionaries
    trained on the others. The final dictionaries are trained on all. PRIOR_SHIFT
    then moves the scores. Without both labels the score is the labels' mean, or 0.5 without labels.
    """
    rows = sorted(((t, y, i) for i, t, y in rows if t is not None), key=lambda r: (str(r[2]), r[0]))
    prior = float(np.mean([y for _, y, _ in rows])) if rows else 0.5
    known = [_Row(b := _folded(t), np.unique(_grams(b)), y) for t, y, _ in _without_copies(rows)]
    del rows
    y = np.array([r.y for r in known])
    model = _dictionaries(known, prior)
    if min((y == 1).sum(), (y == 0).sum()) >= FOLDS:
        x = np.zeros((len(known), FEATURES))
        for k in range(FOLDS):
            pair = _dictionaries([r for j, r in enumerate(known) if j % FOLDS != k], prior).compressors()
            for j in range(k, len(known), FOLDS):
                own = known[j].folded[1:-1]
                x[j] = features(own, np.array([0, len(own)]), pair)[0]
        model.weights = fit_logistic(x, y)
        model.weights[-1] += PRIOR_SHIFT * np.log((y == 0).sum() / (y == 1).sum())
    return model


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Train on labelled rows outside the held-out fold, whatever their length.

    At most about MAX_TRAIN rows and MAX_TRAIN_BYTES bytes of text take part: if there are
    more, a hash of the id chooses among all of them, so that what the driver holds is
    bounded whatever the tables' size.
    """
    sample = label_sample(labels, "toxic", PARTS, HELD_OUT, MAX_TRAIN)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, MAX_TRAIN / max(n, 1), MAX_TRAIN_BYTES / max(size, 1))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    t = rows.select("doc_id", "text", "y").toArrow()
    model = train([(i.as_py(), text.as_py(), y.as_py()) for i, text, y in zip(*(t.column(c) for c in ("doc_id", "text", "y")), strict=True)])
    del t
    give_back()
    return model


def scorer(shared):
    """column of texts -> scores in 0..1, for use in a worker, which makes its compressors once; ``shared.value`` is the model."""
    state: dict[str, list] = {}

    def score(texts: pa.Array) -> np.ndarray:
        model = shared.value
        if model.weights is None:
            return np.full(len(texts), model.prior)
        if "pair" not in state:
            state["pair"] = model.compressors()
        parts = [features(raw, off, state["pair"]) for _, _, raw, off in slices(texts)]
        x = np.concatenate(parts) if parts else np.zeros((0, len(model.weights) - 1))
        return sigmoid(x @ model.weights[:-1] + model.weights[-1])

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score per row of ``docs``. Null and empty texts have no windows and get the calibrated base score."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    of = scorer(shared)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(batch.column(1)))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batchwise(run), f"doc_id {kind}, score double")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    where = docs.columns.index("text")

    of = scorer(shared)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(of(batch.column(where)) < threshold))

    return docs.mapInArrow(batchwise(run), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id",
        (fold("doc_id", PARTS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
