"""Region files made from palettes and indices, for tests, benchmarks and self-contained queries."""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa

SECTOR = 4096


def _name(name: str) -> bytes:
    b = name.encode()
    return struct.pack(">H", len(b)) + b


def tag(kind: int, name: str, body: bytes) -> bytes:
    return bytes([kind]) + _name(name) + body


def number(kind: int, value: int) -> bytes:
    return struct.pack({1: ">b", 2: ">h", 3: ">i", 4: ">q"}[kind], value)


def words(values: np.ndarray) -> bytes:
    """The body of an array of 64-bit words."""
    v = np.asarray(values).astype(np.uint64).astype(">u8")
    return struct.pack(">i", len(v)) + v.tobytes()


def octets(values: np.ndarray) -> bytes:
    """The body of a byte array."""
    v = np.asarray(values).astype(np.uint8)
    return struct.pack(">i", len(v)) + v.tobytes()


def compound(*tags: bytes) -> bytes:
    return b"".join(tags) + b"\0"


def compounds(items: list[bytes]) -> bytes:
    """The body of a list of compounds."""
    return bytes([10 if items else 0]) + struct.pack(">i", len(items)) + b"".join(items)


def texts(items: list[str]) -> bytes:
    return bytes([8 if items else 0]) + struct.pack(">i", len(items)) + b"".join(map(_name, items))


def pack(indices: np.ndarray, bits: int, spanning: bool = False) -> np.ndarray:
    """64-bit words of entries, lowest bits first; with ``spanning`` without gaps."""
    values = np.asarray(indices).astype(np.uint64)
    if spanning:
        each = values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)
        stream = np.packbits(each.ravel().astype(np.uint8), bitorder="little")
        return np.pad(stream, (0, -len(stream) % 8)).view("<u8")
    per = 64 // bits
    rows = np.pad(values, (0, -len(values) % per)).reshape(-1, per)
    return np.bitwise_or.reduce(rows << np.arange(per, dtype=np.uint64) * np.uint64(bits), axis=1)


def _palette(names: list[str]) -> bytes:
    return compounds([compound(tag(8, "Name", _name(n))) for n in names])


def width(size: int) -> int:
    return 0 if size <= 1 else max(4, (size - 1).bit_length())


def modern_section(y: int, names: list[str], indices: np.ndarray | None = None, biomes: list[str] | None = None, biome_indices: np.ndarray | None = None) -> bytes:
    states = [tag(9, "palette", _palette(names))]
    if indices is not None and len(names) > 1:
        states.append(tag(12, "data", words(pack(indices, width(len(names))))))
    tags = [tag(1, "Y", number(1, y)), tag(10, "block_states", compound(*states))]
    if biomes is not None:
        inner = [tag(9, "palette", texts(biomes))]
        if biome_indices is not None:
            inner.append(tag(12, "data", words(pack(biome_indices, max(1, (len(biomes) - 1).bit_length())))))
        tags.append(tag(10, "biomes", compound(*inner)))
    return compound(*tags)


def middle_section(y: int, names: list[str], indices: np.ndarray, spanning: bool) -> bytes:
    data = words(pack(indices, width(len(names)), spanning)) if len(names) > 1 else words(np.zeros(0))
    return compound(tag(1, "Y", number(1, y)), tag(9, "Palette", _palette(names)), tag(12, "BlockStates", data))


def numeric_section(y: int, ids: np.ndarray, data: np.ndarray | None = None, add: np.ndarray | None = None) -> bytes:
    halves = lambda v: v[::2] | v[1::2] << 4
    tags = [tag(1, "Y", number(1, y)), tag(7, "Blocks", octets(ids & 255))]
    if data is not None:
        tags.append(tag(7, "Data", octets(halves(data))))
    if add is not None:
        tags.append(tag(7, "Add", octets(halves(add))))
    return compound(*tags)


def modern_chunk(x: int | None, z: int | None, sections: list[bytes]) -> bytes:
    where = [tag(3, k, number(3, v)) for k, v in (("xPos", x), ("zPos", z)) if v is not None]
    return tag(10, "", compound(tag(3, "DataVersion", number(3, 3465)), *where, tag(9, "sections", compounds(sections))))


def old_chunk(x: int, z: int, sections: list[bytes]) -> bytes:
    level = compound(tag(3, "xPos", number(3, x)), tag(3, "zPos", number(3, z)), tag(9, "Sections", compounds(sections)))
    return tag(10, "", compound(tag(10, "Level", level)))


def compress(data: bytes, codec: int) -> bytes:
    if codec == 1:
        return gzip.compress(data)
    if codec == 2:
        return zlib.compress(data)
    if codec == 4:
        return struct.pack("<I", len(data)) + pa.Codec("lz4_raw").compress(data, asbytes=True)
    return data


def region(chunks: dict[tuple[int, int], tuple[bytes, int]], timestamp: int = 0) -> bytes:
    """A region file of documents and codecs by local coordinates."""
    head, times, body, at = np.zeros(1024, np.uint32), np.zeros(1024, np.uint32), [], 2
    for (x, z), (document, codec) in chunks.items():
        data = compress(document, codec)
        block = struct.pack(">IB", len(data) + 1, codec) + data
        sectors = -(-len(block) // SECTOR)
        head[x + z * 32], times[x + z * 32] = at << 8 | min(sectors, 255), timestamp
        body.append(block.ljust(sectors * SECTOR, b"\0"))
        at += sectors
    return head.astype(">u4").tobytes() + times.astype(">u4").tobytes() + b"".join(body)
