"""Tiles as compressed blobs.

A blob holds 4096 varint run counts and then every run in ten big-endian bytes, columns in
order. Its checksum is the polynomial hash of the uncompressed bytes, taken as signed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from stratavox.sources.regions import poly_hash

COLUMNS = 4096
DEFAULT_LEVEL = 3
RECORD = np.dtype([("y_min", ">i2"), ("y_max", ">i2"), ("color", ">u4"), ("flags", ">u2")])


def varints(values: np.ndarray) -> bytes:
    """LEB128 bytes of non-negative numbers."""
    out = np.zeros((len(values), 5), dtype=np.uint8)
    used = np.zeros((len(values), 5), dtype=bool)
    rest = values.astype(np.int64)
    live = np.ones(len(values), dtype=bool)
    for k in range(5):
        more = rest >= 128
        out[:, k] = rest & 127 | np.where(more, 128, 0)
        used[:, k] = live
        live = live & more
        rest = rest >> 7
    return out[used].tobytes()


def raw_blob(cell: np.ndarray, y_min: np.ndarray, y_max: np.ndarray, color: np.ndarray, flags: np.ndarray) -> bytes:
    """Uncompressed bytes of a tile's runs, which are in order of their cells."""
    record = np.empty(len(cell), dtype=RECORD)
    record["y_min"], record["y_max"], record["color"], record["flags"] = y_min, y_max, color, flags
    return varints(np.bincount(cell, minlength=COLUMNS)) + record.tobytes()


def checksum(raw: bytes) -> int:
    return poly_hash(np.frombuffer(raw, dtype=np.int8))


def checksums(rows: DataFrame, key: str, data: str) -> DataFrame:
    """(key, checksum) of whole binary values, in bulk; a null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [checksum(v.as_buffer()) if v.is_valid else None for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int32())], [key, "checksum"])

    return rows.select(key, data).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, checksum int")


def read_blob(data: bytes) -> list[np.ndarray]:
    """Runs of each of the 4096 columns of a compressed blob, as records."""
    raw = zstandard.decompress(data)
    counts, at = [], 0
    for _ in range(COLUMNS):
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        counts.append(value)
    records = np.frombuffer(raw[at:], dtype=RECORD)
    return np.split(records, np.cumsum(counts)[:-1])


def encode(tiles: DataFrame, level: int = DEFAULT_LEVEL) -> DataFrame:
    """(level, pos_x, pos_z, min_y, checksum, data, raw_bytes) of nested ``tiles``; no runs make an empty tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            sums, blobs, sizes = [], [], []
            for runs in batch.column(4):
                values = runs.values
                if values is None:
                    columns = [np.zeros(0, np.int64)] * 5
                else:
                    columns = [values.field(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4, 5)]
                raw = raw_blob(*columns)
                sums.append(checksum(raw))
                blobs.append(press.compress(raw))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sums, pa.int32()), pa.array(blobs, pa.binary()), pa.array(sizes, pa.int64())],
                ["level", "pos_x", "pos_z", "min_y", "checksum", "data", "raw_bytes"],
            )

    return tiles.select("level", "pos_x", "pos_z", "min_y", "runs").mapInArrow(run, "level int, pos_x int, pos_z int, min_y int, checksum int, data binary, raw_bytes long")
