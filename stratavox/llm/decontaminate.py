"""Benchmark decontamination: broadcast hash sets of item windows scanned over every document.

The windows of a benchmark are arrays: sorted hashes, the word each window begins at, and
the items' normalised words as one buffer, together less than ten times the items' text. A
benchmark of more than PART_BYTES of text is dealt into parts; a worker holds one part at a
time, so memory is bounded whatever the benchmark's size, and every part is scanned for.
Each document's words are hashed in bulk; positions whose window hash is known are verified
word by word, so a hash collision never marks anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.store import batchwise, give_back, table
from stratavox.llm.words import LETTERED, U64, Words, ngram_hashes, slices

WINDOW = 10
#: Bytes of benchmark text in a part, about: what a worker holds the windows of at a time.
PART_BYTES = 16 << 20
#: Places of a bitmap for each window, and at least; word positions looked at in one go.
_PLACES, _LEAST_PLACES, _CHUNK = 8, 1 << 20, 1 << 20

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


@dataclass
class Table:
    """Windows of one length: sorted hashes, the word that each begins at, and a bitmap to rule out most hashes."""

    hashes: np.ndarray
    word: np.ndarray

    def __post_init__(self):
        self.bits = max(_LEAST_PLACES, _PLACES * len(self.hashes) - 1).bit_length()
        self.places = np.zeros(1 << self.bits, dtype=bool)
        self.places[(self.hashes >> U64(64 - self.bits)).astype(np.int64)] = True

    def __reduce__(self):
        return Table, (self.hashes, self.word)

    def at(self, h: np.ndarray) -> np.ndarray:
        """Where in ``h`` known hashes are."""
        at = np.flatnonzero(self.places[(h >> U64(64 - self.bits)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        return at[self.hashes[place] == h[at]]


@dataclass
class WindowSet:
    """Windows of items by length, over the items' words joined by spaces.

    Word ``j`` begins at byte ``start[j]`` of ``text``, item ``k`` at word ``first[k]``.
    """

    ids: pa.Array
    text: bytes
    start: np.ndarray
    first: np.ndarray
    tables: dict[int, Table]

    def items_with(self, n: int, h: int, joined: bytes) -> set[str]:
        """Items that have the window ``joined`` of ``n`` words and hash ``h``."""
        t = self.tables[n]
        lo, hi = (int(np.searchsorted(t.hashes, U64(h), side)) for side in ("left", "right"))
        same = [w for w in t.word[lo:hi].tolist() if self.text[self.start[w] : self.start[w + n] - 1] == joined]
        return {self.ids[int(k)].as_py() for k in np.searchsorted(self.first, same, side="right") - 1} if same else set()


def window_set(ids: pa.Array, texts: pa.Array, window: int = WINDOW) -> WindowSet:
    """Windows of items by id (text) and text. Rows that repeat an id are one item; an item without words has none."""
    blobs, sizes, hashes, counts = [], [np.zeros(0, int)], [np.zeros(0, U64)], [np.zeros(0, int)]
    for _, _, raw, off in slices(texts):
        w = Words(raw, off, LETTERED)
        size = w.end - w.start
        kept = raw[LETTERED[raw]]
        joined = np.full(len(kept) + len(w), 32, dtype=np.uint8)
        joined[np.arange(len(kept)) + np.repeat(np.arange(len(w)), size)] = _LOWERED[kept]
        blobs.append(joined.tobytes())
        sizes.append(size + 1)
        hashes.append(w.hash)
        counts.append(w.counts())
    start = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    start = start.astype(np.int32 if start[-1] < 1 << 31 else np.int64)
    count = np.concatenate(counts)
    first = np.concatenate([[0], np.cumsum(count)])
    tables, h = {}, np.concatenate(hashes)
    length = np.minimum(count, window)
    for n in np.unique(length[length > 0]).tolist():
        items = np.flatnonzero(length == n)
        many = count[items] - n + 1
        word = np.repeat(first[items], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own = ngram_hashes(h, n)[word]
        order = np.argsort(own, kind="stable")
        tables[n] = Table(own[order], word[order].astype(np.int32 if len(h) < 1 << 31 else np.int64))
    return WindowSet(ids.cast(pa.string()), b"".join(blobs), start, first, tables)


def _scan(raw: np.ndarray, off: np.ndarray, known: WindowSet) -> tuple[Words, np.ndarray, dict[int, set[str]]]:
    """Words of a slice, which of them are hit, and the items found by document."""
    w = Words(raw, off, LETTERED)
    hit = np.zeros(len(w), dtype=bool)
    found: dict[int, set[str]] = {}
    seen: dict[tuple[int, bytes], set[str]] = {}
    for n, t in known.tables.items():
        for a in range(0, max(len(w) - n + 1, 0), _CHUNK):
            h = ngram_hashes(w.hash[a : a + _CHUNK + n - 1], n)
            at = t.at(h)
            docs = np.searchsorted(w.first, at + a, side="right") - 1
            inside = at + a + n <= w.first[docs + 1]
            for i, d, own in zip((at[inside] + a).tolist(), docs[inside].tolist(), h[at[inside]].tolist(), strict=True):
                joined = b" ".join(_LOWERED[raw[w.start[j] : w.end[j]]].tobytes() for j in range(i, i + n))
                if (n, joined) not in seen:
                    seen[n, joined] = known.items_with(n, own, joined)
                if ids := seen[n, joined]:
                    hit[i : i + n] = True
                    found.setdefault(d, set()).update(ids)
    return w, hit, found


class KnownWindows:
    """The benchmark's windows in parts, each broadcast; with several, a worker lets go of one before it loads the next."""

    def __init__(self, parts: list[Broadcast]):
        self.parts = parts

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
        """For every text of a batch: how many words, which are hit, and the items found."""
        words, hits, items = [], [], [set() for _ in range(len(texts))]
        for turn, part in enumerate(self.parts):
            for nth, (i, _, raw, off) in enumerate(slices(texts)):
                w, hit, found = _scan(raw, off, part.value)
                for d, ids in found.items():
                    items[i + d] |= ids
                if turn:
                    hits[nth][1][:] |= hit
                else:
                    words.append(w.counts())
                    hits.append((w.first, hit))
            if len(self.parts) > 1:
                part.__dict__.pop("_value", None)
        if not self.parts:
            words = [Words(raw, off, LETTERED, hashed=False).counts() for _, _, raw, off in slices(texts)]
        counts = np.concatenate(words) if words else np.zeros(0, int)
        if not self.parts:
            return counts, [np.zeros(n, bool) for n in counts.tolist()], items
        return counts, [hit[a:b] for first, hit in hits for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], items


def known_windows(benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> KnownWindows:
    """The benchmark's windows for every worker. A row without an item_id is no item.

    The driver holds one part at a time; an item is never cut, so a part is larger than
    ``part_bytes`` only by chance or for one long item.
    """
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-size // part_bytes)
    out = []
    for k in range(parts):
        t = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toArrow()
        ids, texts = (t.column(c).combine_chunks() for c in ("item_id", "text"))
        out.append(benchmark.sparkSession.sparkContext.broadcast(window_set(ids, texts, window)))
        del t, ids, texts
        give_back()
    return KnownWindows(out)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted), contaminated.

    Null and empty texts have no words. An empty benchmark hits nothing, and its rows
    without an item_id are no items. Repeated rows are reported each.
    """
    known = known_windows(benchmark, window, part_bytes)

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, hits, found = known.scan(batch.column(1))
        n_hit = np.array([h.sum() for h in hits], dtype=np.int64)
        items = [sorted(x) for x in found]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(n_hit > 0),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        batchwise(scan), f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean"
    )


Scan = Callable[[pa.Array], tuple[np.ndarray, list[np.ndarray], list[set[str]]]]


def _without(blob: bytes, hit: np.ndarray) -> bytes:
    """``blob`` without the spans from the first to the last byte of consecutive hit words."""
    raw = np.frombuffer(blob, dtype=np.uint8)
    w = Words(raw, np.array([0, len(raw)]), LETTERED, hashed=False)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    keep, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        keep.append(blob[at : w.start[a]])
        at = int(w.end[b - 1])
    return b"".join([*keep, blob[at:]])


def remove_spans(texts: pa.Array, scan: Scan) -> tuple[dict[int, str], np.ndarray, np.ndarray]:
    """New texts by row where words are hit, the words of all texts, and words removed.

    A span runs from the first to the last byte of consecutive hit words, so separators
    between them go too; all other bytes stay as they are. What remains is scanned again,
    since words on both sides of a span have become neighbours.
    """
    new: dict[int, str] = {}
    words = removed = None
    rows = np.arange(len(texts))
    while len(rows):
        now = texts if words is None else pa.array([new[i] for i in rows.tolist()], texts.type)
        counts, hits, _ = scan(now)
        if words is None:
            words, removed = counts, np.zeros(len(texts), dtype=np.int64)
        some = [k for k, h in enumerate(hits) if h.any()]
        for k in some:
            i = int(rows[k])
            removed[i] += hits[k].sum()
            new[i] = _without(now[k].as_py().encode(), hits[k]).decode()
        rows = rows[some]
    none = np.zeros(0, dtype=np.int64)
    return new, none if words is None else words, none if removed is None else removed


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_from: float = 0.5, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with hit spans removed; a document of which ``drop_from`` or more words are hit is dropped.

    All columns stay; ``n_chars``, if there, follows the text.
    """
    known = known_windows(benchmark, window, part_bytes)
    where = docs.columns.index("text")

    def scrub(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(where)
        new, words, removed = remove_spans(texts, known.scan)
        if new:
            keep = np.ones(len(texts), dtype=bool)
            values = texts.to_pylist()
            for i, text in new.items():
                values[i], keep[i] = text, removed[i] < drop_from * words[i]
            columns = batch.columns
            columns[where] = pa.array(values, texts.type)
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))
        yield batch

    out = docs.mapInArrow(batchwise(scrub), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold benchmark windows; the digest is that of the sorted item ids."""
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8_SQL = f"""
WITH items AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT DISTINCT n, array_to_string(w[i:i + n - 1], ' ') AS win, CAST(item_id AS VARCHAR) AS item
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
spots AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))),
hits AS MATERIALIZED (SELECT r, s.n, i, item FROM spots s JOIN windows x ON x.n = s.n AND x.win = s.win),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN found ON found.r = d.r"""
