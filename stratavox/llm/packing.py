"""Conflict-constrained best-fit packing of documents into fixed-length bins.

Documents are dealt at random to groups of bounded size, which are packed apart. Within a
group open bins stand in order of the room they have left. The longest document goes first;
the search begins at the tightest bin that holds it and goes on to its successors until one
fits without conflict: no bin has two documents of one duplicate cluster, nor more than a
few of one source. Bins carry bitmaps for that, so a bin is tested with bit operations, and
successive bins that all have the bit in question are passed over at once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.store import batchwise, groupwise, materialize, table
from stratavox.llm.words import SPACED, Words, slices

#: Words in a bin.
CAPACITY = 2048
#: Documents of one source in a bin, at most.
PER_SOURCE = 4
#: Pieces in a group on average.
GROUP_ROWS = 8192
#: Successive bins whose common bits are kept; twice as many are cut in two.
STRETCH = 64


class Bins:
    """Open bins in order of the room left, each with its bitmaps.

    Clusters and sources are numbered within the group; a bin's source bitmaps say which
    sources it holds once, twice, and so on. Documents that share neither a cluster nor a
    full source with a bin conflict with none, and take the tightest bin at once. The order
    is kept in stretches, each with the bits that all of its bins have.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.stretches: list[list[tuple[int, int]]] = []
        self.common: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.room: list[int] = []

    def _bits(self, k: int) -> None:
        bins = [b for _, b in self.stretches[k]]
        self.common[k] = reduce(and_, (self.clusters[b] for b in bins)), reduce(and_, (self.sources[b][-1] for b in bins))

    def _take(self, size: int, full: int, same: int) -> int | None:
        """The tightest bin that holds ``size`` and has neither bit, taken out of the order."""
        first = bisect_left(self.stretches, (size, -1), key=lambda s: s[-1])
        for k in range(first, len(self.stretches)):
            if self.common[k][0] & same or self.common[k][1] & full:
                continue
            stretch = self.stretches[k]
            for at in range(bisect_left(stretch, (size, -1)) if k == first else 0, len(stretch)):
                b = stretch[at][1]
                if not self.clusters[b] & same and not self.sources[b][-1] & full:
                    del stretch[at]
                    if stretch:
                        self._bits(k)
                    else:
                        del self.stretches[k], self.common[k]
                    return b
        return None

    def _stand(self, b: int) -> None:
        """Put a bin into the order."""
        place = self.room[b], b
        k = min(bisect_left(self.stretches, place, key=lambda s: s[-1]), len(self.stretches) - 1)
        if k < 0:
            self.stretches.append([place])
            self.common.append((self.clusters[b], self.sources[b][-1]))
            return
        insort(self.stretches[k], place)
        self.common[k] = self.common[k][0] & self.clusters[b], self.common[k][1] & self.sources[b][-1]
        if len(self.stretches[k]) >= 2 * STRETCH:
            self.stretches[k : k + 1] = self.stretches[k][:STRETCH], self.stretches[k][STRETCH:]
            self.common.insert(k, (0, 0))
            self._bits(k)
            self._bits(k + 1)

    def put(self, size: int, source: int, cluster: int) -> int:
        """The bin that a document of ``size`` goes into; a new one where none fits."""
        full, same = 1 << source, 1 << cluster
        b = self._take(size, full, same)
        if b is None:
            b = len(self.room)
            self.room.append(self.capacity)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
        self.clusters[b] |= same
        planes = self.sources[b]
        planes[next(k for k, p in enumerate(planes) if not p & full)] |= full
        self.room[b] -= size
        if self.room[b]:
            self._stand(b)
        return b


def _numbered(values: list) -> list[int]:
    numbers: dict = {}
    return [numbers.setdefault(v, len(numbers)) for v in values]


def _pack_group(capacity: int, per_source: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), *((c, "ascending") for c in ("doc_id", "cluster", "source", "copy", "piece"))])
        bins = Bins(capacity, per_source)
        sources, clusters = _numbered(t.column("source").to_pylist()), _numbered(t.column("cluster").to_pylist())
        placed = [bins.put(n, s, c) for n, s, c in zip(t.column("size").to_pylist(), sources, clusters, strict=True)]
        room = np.array(bins.room, dtype=np.int64)
        which = np.array(placed, dtype=np.int64)
        out = t.select(["doc_id", "piece", "first_word", "size", "group"])
        return out.append_column("bin", pa.array(which)).append_column("room", pa.array(room[which] if len(which) else which))

    return run


def _measured(docs: DataFrame, cluster: str | None) -> DataFrame:
    """doc_id, source, cluster, words of every row of ``docs``; no list of words is ever made."""

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, marks = [], []
        for _, _, raw, off in slices(batch.column(0)):
            words.append(Words(raw, off, SPACED, hashed=False).counts())
            blob = raw.tobytes().lower()
            marks += [int.from_bytes(hashlib.blake2b(blob[a:b], digest_size=8).digest(), "big", signed=True) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        own = [pa.array(np.concatenate(words) if words else [], pa.int64()), pa.array(marks, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], names=["doc_id", "source", "given", "words", "mark"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = F.lit(None).cast("long") if cluster is None else F.when(F.col(cluster).isNotNull(), F.xxhash64(cluster))
    rows = docs.select("text", "doc_id", F.col("source").cast("string").alias("source"), given.alias("given"))
    rows = rows.mapInArrow(batchwise(measure), f"doc_id {kind}, source string, given long, words long, mark long")
    return rows.select("doc_id", "source", F.coalesce("given", "mark").alias("cluster"), "words", "mark")


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, first_word, size, bin_id, room per piece of ``docs(doc_id, text, source)``.

    Sizes are words ``[^\\x20\\x09-\\x0D]+``. A longer document than a bin is cut into full
    pieces and a rest; full pieces have bins of their own. Null, empty and wordless texts
    take no room and are in no bin: size 0, bin_id and room null. Documents with one value
    of the column ``cluster`` form a duplicate cluster and never share a bin; without that
    column, or where it is null, those of equal text after lower-casing A-Z do. A null source
    is a source like any other. Rows that repeat a doc_id are packed each, as copies: equal
    rows are counted first and numbered, so however many there are, they spread over groups.
    doc_id may be of any type. ``bin_id`` is text: the group and the bin within it, or the
    document, copy and piece for a full piece. All of it follows from the rows alone, not
    from the files or partitions that they come in.
    """
    sized = _measured(docs, cluster).groupBy("doc_id", "source", "cluster", "words", "mark").agg(F.count("*").alias("copies"))
    sized = materialize(sized, "sized")
    each = sized.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    key = ["doc_id", "source", "cluster", "mark", "copy"]
    cut = F.posexplode(F.expr(f"sequence(0, words - 1, {capacity})")).alias("piece", "first_word")
    pieces = each.where("words > 0").select(*key, "words", cut)
    pieces = pieces.withColumn("size", F.least(F.lit(capacity), F.col("words") - F.col("first_word"))).drop("words")
    whole = F.col("size") == capacity
    n = sized.where(f"words % {capacity} > 0").agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    groups = max(1, -(-n // group_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = pieces.where(~whole).withColumn("group", F.pmod(F.xxhash64(F.lit(17), *key), F.lit(groups)).cast("long")).drop("mark")
    packed = rest.groupBy("group").applyInArrow(
        groupwise(_pack_group(capacity, per_source)), f"doc_id {kind}, piece int, first_word long, size long, group long, bin long, room long"
    )
    packed = packed.select("doc_id", "piece", "first_word", "size", F.concat_ws("-", F.lit("group"), "group", "bin").alias("bin_id"), "room")
    shown = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    own = F.concat_ws("-", F.lit("row"), shown, F.hex("mark"), F.hex(F.xxhash64("source", "cluster")), "copy", "piece")
    full = pieces.where(whole).select("doc_id", "piece", "first_word", "size", own.alias("bin_id"), F.lit(0).cast("long").alias("room"))
    zero, none = F.lit(0).cast("long"), F.lit(None)
    empty = each.where("words = 0").select("doc_id", F.lit(0).alias("piece"), zero, zero, none.cast("string"), none.cast("long"))
    return packed.union(full).union(empty)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into bins of 2048 words."""
    return pack(table(spark, sf_dir, "documents"))
