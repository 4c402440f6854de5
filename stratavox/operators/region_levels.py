"""Levels of the pyramid in bulk, three at a time.

The pyramid of ``stratavox.operators.tiles`` states what a level is; here the same levels
are computed on arrays. A region has at most 1024 chunks, and its tiles up to level 3 need
no other region; likewise 8 x 8 tiles of one level are all that three levels above one of
theirs need. So groups are bounded, each step is one small shuffle, and tiles leave their
group as finished blobs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.operators.tiles import REGION_LEVELS, SAMPLES
from stratavox.sources.blobs import checksum, raw_blob

STEP = REGION_LEVELS
TILES = (
    "level int, pos_x int, pos_z int, min_y int, max_y int, checksum int, data binary, raw_bytes long, "
    "runs array<struct<gx:int,gz:int,y_min:int,y_max:int,color:bigint,flags:int>>"
)


@dataclass
class Runs:
    """Runs of columns; those of a column are next to each other, from below."""

    gx: np.ndarray
    gz: np.ndarray
    y_min: np.ndarray
    y_max: np.ndarray
    color: np.ndarray
    flags: np.ndarray

    def __len__(self) -> int:
        return len(self.gx)

    def take(self, at: np.ndarray) -> Runs:
        return Runs(*(getattr(self, f)[at] for f in ("gx", "gz", "y_min", "y_max", "color", "flags")))


def _groups(*keys: np.ndarray) -> np.ndarray:
    """First index of each stretch of equal keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def in_order(r: Runs, bits: int) -> Runs:
    """Sorted by column within squares of 2**bits columns, x first; a column keeps its order."""
    low = (1 << bits) - 1
    x, z = r.gx.astype(np.int64), r.gz.astype(np.int64)
    square = ((x >> bits) - (x.min() >> bits)) * (1 + (z.max() >> bits) - (z.min() >> bits)) + (z >> bits) - (z.min() >> bits)
    return r.take(np.argsort(square << 2 * bits | (x & low) << bits | z & low, kind="stable"))


def topmost(r: Runs) -> Runs:
    """The last run of each column."""
    ordered = in_order(r, 6)
    first = _groups(ordered.gx, ordered.gz)
    return ordered.take(np.append(first[1:], len(ordered)) - 1)


def next_level(r: Runs, top_only: bool = False) -> Runs:
    """One run for each 2 x 2 columns that have any."""
    if not len(r):
        return r
    r = in_order(topmost(r) if top_only else r, 1)
    x, z = r.gx >> 1, r.gz >> 1
    first = _groups(x, z)
    nth = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    shown = (nth < SAMPLES) & (r.color >> 24 & 255 > 0)
    n = np.add.reduceat(shown.astype(np.int64), first)
    color = np.zeros(len(first), dtype=np.int64)
    for shift in (24, 16, 8, 0):
        total = np.add.reduceat(np.where(shown, r.color >> shift & 255, 0), first)
        color |= total // np.maximum(n, 1) << shift
    flagged = np.minimum.reduceat(np.where(r.flags != 0, np.arange(len(r)), len(r)), first)
    flags = np.append(r.flags, 0)[np.where(flagged < np.append(first[1:], len(r)), flagged, len(r))]
    out = Runs(x[first], z[first], np.minimum.reduceat(r.y_min, first), np.maximum.reduceat(r.y_max, first), color, flags)
    return out.take(np.flatnonzero(color)) if top_only else out


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the lists of structs, and the fields of all items."""
    lists = column.combine_chunks()
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return n, [a.to_numpy(zero_copy_only=False) for a in lists.flatten().flatten()]


def _of_chunks(t: pa.Table) -> Runs:
    n, (cell, y_min, y_max, color, flags) = _lists(t.column("runs"))
    x, z = (np.repeat(t.column(c).to_numpy().astype(np.int64) * 16, n) for c in ("chunk_x", "chunk_z"))
    return Runs(x + (cell & 15), z + (cell >> 4), y_min, y_max, color, flags)


def _folded(rows: list[tuple]) -> dict[tuple[int, int], tuple[int, int]]:
    """Bounds by tile from (pos_x, pos_z, min_y, max_y) rows in order; a minimum of 0 counts as not set."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for x, z, low, high in rows:
        s, top = out.get((x, z), (0, 0))
        out[x, z] = low if low < s or s == 0 else s, max(top, high)
    return out


_RUN = pa.struct([("gx", pa.int32()), ("gz", pa.int32()), ("y_min", pa.int32()), ("y_max", pa.int32()), ("color", pa.int64()), ("flags", pa.int32())])
_INTS = ("level", "pos_x", "pos_z", "min_y", "max_y", "checksum")
_SCHEMA = pa.schema([*((c, pa.int32()) for c in _INTS), ("data", pa.binary()), ("raw_bytes", pa.int64()), ("runs", pa.list_(_RUN))])


def _encoded(level: int, bounds: dict, r: Runs, press: zstandard.ZstdCompressor, with_runs: bool) -> pa.Table:
    """Rows of TILES of one level; a tile without runs is an empty blob."""
    r = in_order(r, 6) if len(r) else r
    first = _groups(r.gx >> 6, r.gz >> 6) if len(r) else np.zeros(0, int)
    spans = {(int(r.gx[a]) >> 6, int(r.gz[a]) >> 6): (int(a), int(b)) for a, b in zip(first, np.append(first[1:], len(r)), strict=True)}
    rows, order = [], []
    for (x, z), (low, high) in sorted(bounds.items()):
        a, b = spans.get((x, z), (0, 0))
        cell = (r.gx[a:b] & 63) * 64 + (r.gz[a:b] & 63)
        raw = raw_blob(cell.astype(np.int64), r.y_min[a:b], r.y_max[a:b], r.color[a:b], r.flags[a:b])
        rows.append((level, x, z, low, high, checksum(raw), press.compress(raw), len(raw)))
        order.append(np.arange(a, b))
    columns = [pa.array([row[k] for row in rows], f.type) for k, f in enumerate(_SCHEMA) if k < 8]
    if not with_runs:
        return pa.Table.from_arrays([*columns, pa.nulls(len(rows), pa.list_(_RUN))], schema=_SCHEMA)
    flat = r.take(np.concatenate(order)) if order else r
    items = pa.StructArray.from_arrays([pa.array(getattr(flat, f.name), f.type) for f in _RUN], fields=list(_RUN))
    ends = pa.array(np.cumsum([0, *map(len, order)]), pa.int32())
    return pa.Table.from_arrays([*columns, pa.ListArray.from_arrays(ends, items)], schema=_SCHEMA)


def _climb(r: Runs, bounds: dict, level: int, last: int, levels: int, top_only: bool, zstd_level: int) -> list[pa.Table]:
    """Tiles of the levels above ``level`` up to ``last``; the uppermost keep their runs if there are more to come."""
    press, out = zstandard.ZstdCompressor(level=zstd_level), []
    while level < last:
        level += 1
        r = next_level(r, top_only)
        bounds = _folded([(x >> 1, z >> 1, *bounds[x, z]) for x, z in sorted(bounds)])
        out.append(_encoded(level, bounds, r, press, level == last < levels))
    return out


def region_tiles(chunks: DataFrame, levels: int, top_only: bool = False, zstd_level: int = 3) -> DataFrame:
    """Tiles (TILES) of levels 0 to ``levels``, or 3, from ``chunks`` as decoded.

    Of several chunks for one place that with the last path counts. Tiles of level 3 carry
    their runs, at most 4096, if higher levels are to follow.
    """
    last = min(levels, STEP)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("path", "ascending")])
        place = {xz: k for k, xz in enumerate(zip(t.column("chunk_x").to_pylist(), t.column("chunk_z").to_pylist(), strict=True))}
        t = t.take(pa.array(sorted(place.values()))).sort_by([("slot", "ascending")])
        rows = zip(*(t.column(c).to_pylist() for c in ("chunk_x", "chunk_z", "min_y", "max_y")), strict=True)
        bounds = _folded([(x >> 2, z >> 2, low, high) for x, z, low, high in rows])
        r = _of_chunks(t)
        base = _encoded(0, bounds, r, zstandard.ZstdCompressor(level=zstd_level), last == 0 < levels)
        return pa.concat_tables([base, *_climb(r, bounds, 0, last, levels, top_only, zstd_level)])

    keyed = chunks.where("error IS NULL").select(
        "path", "slot", "chunk_x", "chunk_z", "min_y", "max_y", "runs", F.shiftright("chunk_x", 5).alias("rx"), F.shiftright("chunk_z", 5).alias("rz")
    )
    return keyed.groupBy("rx", "rz").applyInArrow(run, TILES)


def tiles_above(tiles: DataFrame, level: int, levels: int, top_only: bool = False, zstd_level: int = 3) -> DataFrame:
    """Tiles of the next three levels, or up to ``levels``, from those of ``level`` with their runs."""
    last = min(levels, level + STEP)

    def run(t: pa.Table) -> pa.Table:
        rows = zip(*(t.column(c).to_pylist() for c in ("pos_x", "pos_z", "min_y", "max_y")), strict=True)
        bounds = {(x, z): (low, high) for x, z, low, high in rows}
        _, fields = _lists(t.column("runs"))
        return pa.concat_tables(_climb(Runs(*fields), bounds, level, last, levels, top_only, zstd_level))

    keyed = tiles.where(F.col("level") == level).select(
        "pos_x", "pos_z", "min_y", "max_y", "runs", F.shiftright("pos_x", STEP).alias("px"), F.shiftright("pos_z", STEP).alias("pz")
    )
    return keyed.groupBy("px", "pz").applyInArrow(run, TILES)
