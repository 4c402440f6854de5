"""Region files: discovery, headers, payloads, and their decoding into chunks and runs.

A region file opens with 1024 locations (three bytes of sector, one of length) and 1024
timestamps; each location points to a payload with its length and codec. Files are read by
Spark's binary reader, and decoded in Arrow batches: per chunk one row with its bounds,
its hash and its runs, never one row per block.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratavox.functions.columns import CHUNK_BITS
from stratavox.functions.materials import material_of
from stratavox.operators.relations import region_files
from stratavox.operators.voxels import CEILING, FLOOR
from stratavox.sources.nbt import Chunk, NbtError, Section, parse_chunk
from stratavox.sources.tables import fresh_path

SECTOR, HEADER = 4096, 8192
RUN = "struct<cell:int,y_min:int,y_max:int,color:bigint,flags:int>"
CHUNKS = (
    "path string, slot int, chunk_x int, chunk_z int, doc_x int, doc_z int, timestamp long, min_y int, max_y int, hash int, error string, runs array<" + RUN + ">"
)
_NAME = re.compile(r"^r\.([+-]?\d+)\.([+-]?\d+)(\..*)?\.mca$")
_INT32 = range(-(1 << 31), 1 << 31)


class RegionError(ValueError):
    """A region file or payload that can't be read."""


@dataclass(frozen=True)
class Location:
    """A chunk's place in a region file."""

    local_x: int
    local_z: int
    sector_offset: int
    sector_count: int
    timestamp: int

    @property
    def slot(self) -> int:
        return self.local_x + self.local_z * 32


def coords_of(path: str) -> tuple[int, int] | None:
    """Region coordinates in a file name."""
    m = _NAME.match(path.rsplit("/", 1)[-1])
    found = (int(m[1]), int(m[2])) if m else None
    return found if found and all(v in _INT32 for v in found) else None


def locations(content: bytes) -> list[Location]:
    """Chunks that are there, in order of their slots."""
    if len(content) < HEADER:
        raise RegionError("the file is shorter than its header")
    words = np.frombuffer(content[:HEADER], dtype=">u4").astype(np.int64)
    offset, count = words[:1024] >> 8, words[:1024] & 255
    return [Location(int(s) & 31, int(s) >> 5, int(offset[s]), int(count[s]), int(words[1024 + s])) for s in np.flatnonzero((offset > 0) & (count > 0))]


def payload(content: bytes, place: Location) -> tuple[bytes, int]:
    """Compressed bytes and codec of a chunk; its stated length counts, not its sectors."""
    at = place.sector_offset * SECTOR
    if at + 5 > len(content):
        raise RegionError("a payload begins beyond the end")
    (length,) = struct.unpack(">I", content[at : at + 4])
    if not length:
        raise RegionError("a payload is empty")
    if at + 4 + length > len(content):
        raise RegionError("a payload is cut short")
    return content[at + 5 : at + 4 + length], content[at + 4]


def decompress(data: bytes, codec: int) -> bytes:
    """1 gzip, 2 zlib, 3 none, 4 an LZ4 block after its size (four bytes, the lowest first)."""
    try:
        if codec == 1:
            return gzip.decompress(data)
        if codec == 2:
            return zlib.decompress(data)
        if codec == 3:
            return bytes(data)
        if codec == 4:
            (size,) = struct.unpack("<I", data[:4])
            return pa.Codec("lz4_raw").decompress(data[4:], size, asbytes=True)
    except (OSError, EOFError, zlib.error, struct.error, pa.ArrowException) as e:
        raise RegionError(f"codec {codec}: {e}") from None
    raise RegionError(f"unknown codec {codec}")


_POWERS = np.ones(1, dtype=np.uint32)


def powers(n: int) -> np.ndarray:
    """31**(n-1) .. 31**0 modulo 2**32."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(n, 31, dtype=np.uint32)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p, dtype=np.uint32)
    return _POWERS[:n][::-1]


def poly_hash(values: np.ndarray, piece: int = 1 << 20) -> int:
    """h = 31 * h + x from 1, wrapped to signed 32 bits; long arrays go piece by piece."""
    h = 1
    for a in range(0, len(values), piece):
        part = values[a : a + piece].astype(np.int64).astype(np.uint32)
        h = (int((part * powers(len(part))).sum(dtype=np.uint32)) + h * pow(31, len(part), 1 << 32)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def chunk_hash(sections: list[Section]) -> int:
    """Hash of all cells' palette codes, in the document's order, air included."""
    return poly_hash(np.concatenate([s.indices for s in sections])) if sections else 1


@dataclass
class Voxels:
    """Runs of a chunk by column ``x + z * 16``, from below, and its bounds."""

    min_y: int
    max_y: int
    cell: np.ndarray
    y_min: np.ndarray
    y_max: np.ndarray
    color: np.ndarray
    flags: np.ndarray


def voxelise(chunk: Chunk) -> Voxels:
    """Vertical runs of equal material over all sections from the lowest up.

    Sections at one height keep their order and may overlap. Runs are cut within sections
    and then joined where one ends right below the next of the same material.
    """
    parts = []
    for s in sorted((s for s in chunk.sections if not s.empty), key=lambda s: s.y):
        if not s.palette:
            continue
        mats = [material_of(n) for n in s.palette]
        key = np.array([m.color << 16 | m.flags if m.solid else 0 for m in mats], dtype=np.int64)
        codes = np.where(s.indices < len(mats), s.indices, 0)
        grid = key[codes].reshape(16, 256).T
        edge = np.ones((256, 1), dtype=bool)
        changed = grid[:, 1:] != grid[:, :-1]
        solid = grid != 0
        cell, low = np.nonzero(solid & np.hstack([edge, changed]))
        _, high = np.nonzero(solid & np.hstack([changed, edge]))
        parts.append((cell, low + s.y * 16, high + s.y * 16, grid[cell, low]))
    cell, low, high, key = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4))
    if not len(cell):
        return Voxels(0, 0, cell, low, high, key, key)
    bounds = min(CEILING, int(low.min())), max(FLOOR, int(high.max()))
    if bounds[0] > bounds[1]:
        bounds = 0, 0
    order = np.argsort(cell, kind="stable")
    cell, low, high, key = cell[order], low[order], high[order], key[order]
    joins = (cell[1:] == cell[:-1]) & (key[1:] == key[:-1]) & (high[:-1] + 1 == low[1:])
    first = np.flatnonzero(np.concatenate([[True], ~joins]))
    last = np.append(first[1:], len(cell)) - 1
    return Voxels(*bounds, cell[first], low[first], high[last], key[first] >> 16, key[first] & 0xFFFF)


@dataclass(frozen=True)
class Box:
    """Chunks of interest, inclusive."""

    min_x: int = -(1 << 26)
    max_x: int = 1 << 26
    min_z: int = -(1 << 26)
    max_z: int = 1 << 26

    @staticmethod
    def around(block_x: int, block_z: int, radius: int) -> Box:
        """Chunks up to ``radius`` chunks away from the one of a block."""
        x, z = block_x >> CHUNK_BITS, block_z >> CHUNK_BITS
        return Box(x - radius, x + radius, z - radius, z + radius)

    def has_chunk(self, x: int, z: int) -> bool:
        return self.min_x <= x <= self.max_x and self.min_z <= z <= self.max_z

    def has_region(self, x: int, z: int) -> bool:
        return self.min_x >> 5 <= x <= self.max_x >> 5 and self.min_z >> 5 <= z <= self.max_z >> 5


def decode(path: str, content: bytes, box: Box) -> Iterator[tuple]:
    """Rows of CHUNKS of one region file; the box is tested before a payload is read.

    What can't be read gives a row with ``error`` and no runs.
    """
    rx, rz = coords_of(path) or (0, 0)
    try:
        places = locations(content)
    except RegionError as e:
        yield path, None, None, None, None, None, None, None, None, None, str(e), None
        return
    for p in places:
        x, z = rx * 32 + p.local_x, rz * 32 + p.local_z
        if not box.has_chunk(x, z):
            continue
        try:
            chunk = parse_chunk(decompress(*payload(content, p)), x, z)
        except (RegionError, NbtError) as e:
            yield path, p.slot, x, z, None, None, p.timestamp, None, None, None, str(e), None
            continue
        yield path, p.slot, x, z, chunk.x, chunk.z, p.timestamp, *_measured(chunk)


def _measured(chunk: Chunk) -> tuple:
    v = voxelise(chunk)
    return v.min_y, v.max_y, chunk_hash(chunk.sections), None, v


_KINDS = [pa.string(), *[pa.int32()] * 5, pa.int64(), *[pa.int32()] * 3, pa.string()]
_NAMES = ["path", "slot", "chunk_x", "chunk_z", "doc_x", "doc_z", "timestamp", "min_y", "max_y", "hash", "error", "runs"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)]
    voxels = [r[11] for r in rows]
    sizes = [0 if v is None else len(v.cell) for v in voxels]
    flat = [np.concatenate([getattr(v, f) for v in voxels if v is not None] or [np.zeros(0, np.int64)]) for f in ("cell", "y_min", "y_max", "color", "flags")]
    run = pa.StructArray.from_arrays(
        [pa.array(a, t) for a, t in zip(flat, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["cell", "y_min", "y_max", "color", "flags"]
    )
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    offsets = pa.array(ends, pa.int32(), mask=np.array([v is None for v in voxels] + [False]))
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, run)], _NAMES)


def _status(spark: SparkSession, path: str):
    """A path's Hadoop form, its file system, and whether it is a file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return p, fs, bool(fs.getFileStatus(p).isFile())


def _unzipped(spark: SparkSession, path: str, box: Box) -> str:
    """A folder in the shared one with the region files of a zip archive.

    The driver's JVM streams the archive once, entry by entry, so neither an archive nor an
    entry is ever held whole; decoding is distributed as with any folder.
    """
    jvm = spark._jvm
    source, fs, _ = _status(spark, path)
    folder = fresh_path(spark, "zip")
    fs_out = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs_out.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    stream = jvm.java.util.zip.ZipInputStream(fs.open(source))
    try:
        entry = stream.getNextEntry()
        while entry is not None:
            name = entry.getName()
            where = coords_of(name) if name.endswith(".mca") and "region/r." in name else None
            if where and box.has_region(*where) and ".." not in name.split("/"):
                out = fs_out.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name.lstrip('/')}"))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                finally:
                    out.close()
            entry = stream.getNextEntry()
    finally:
        stream.close()
    return folder


def _axis(low: int, high: int, most: int = 256) -> str:
    """A glob of the numbers of a range as names may write them, with a sign or zeros in front; any if there are many."""
    if high - low >= most:
        return "*"
    forms = [f"{sign}{zeros}{abs(v)}" for v in range(low, high + 1) for sign in (("-",) if v < 0 else ("", "+") if v else ("", "+", "-")) for zeros in ("", "0*")]
    return "{" + ",".join(forms) + "}"


def discover(spark: SparkSession, path: str, box: Box = Box()) -> DataFrame:  # noqa: B008
    """(path, content) of the region files that may hold chunks of the box.

    A folder is searched at any depth for names ``r.<x>.<z>.mca``. The box becomes part of
    the pattern that Spark lists files by, so no other file is opened and no list of names is
    collected; names are then held against the box exactly. A file is opened as a zip
    archive, of whose entries those with ``region/r.`` in their name count.
    """
    if _status(spark, path)[2]:
        path = _unzipped(spark, path, box)
    x, z = _axis(box.min_x >> 5, box.max_x >> 5), _axis(box.min_z >> 5, box.max_z >> 5)
    names = f"r.{x}.{z}*.mca" if "*" not in (x, z) else "r.*.mca"
    files = region_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path))
    near = files.where(F.col("rx").between(box.min_x >> 5, box.max_x >> 5) & F.col("rz").between(box.min_z >> 5, box.max_z >> 5))
    return near.select("path", "content")


def scan(files: DataFrame, box: Box = Box()) -> DataFrame:  # noqa: B008
    """Chunks of ``files(path, content)`` with the columns of CHUNKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for row in decode(path.as_py(), content.as_py(), box):
                    rows.append(row)
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, CHUNKS)


def by_document(chunks: DataFrame) -> DataFrame:
    """``chunks`` that were read, placed where their documents say and not where their files do.

    Of several documents for one place the last one counts, by path and slot.
    """
    placed = chunks.where("error IS NULL").drop("chunk_x", "chunk_z").withColumnsRenamed({"doc_x": "chunk_x", "doc_z": "chunk_z"})
    last = F.max(F.struct("path", "slot")).over(W.partitionBy("chunk_x", "chunk_z"))
    return placed.withColumn("last", last).where("path = last.path AND slot = last.slot").drop("last")


def runs_of(chunks: DataFrame) -> DataFrame:
    """Level-0 runs (gx, gz, run_ord, y_min, y_max, color, flags), placed by the file's coordinates."""
    each = chunks.where("error IS NULL").select("chunk_x", "chunk_z", F.posexplode("runs").alias("ord", "r"))
    gx = F.col("chunk_x") * 16 + F.col("r.cell").bitwiseAND(15)
    gz = F.col("chunk_z") * 16 + F.shiftright("r.cell", 4)
    return each.select(gx.alias("gx"), gz.alias("gz"), F.col("ord").alias("run_ord"), "r.y_min", "r.y_max", "r.color", "r.flags")

