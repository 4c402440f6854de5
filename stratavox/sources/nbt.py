"""Reader of named binary tags, and of the chunk documents written in them."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from stratavox.functions.materials import EMPTY_NAMES, bare_name, legacy_name

CELLS, BIOME_CELLS = 4096, 64


class NbtError(ValueError):
    """A document that is cut short or lacks what a chunk needs."""


_NUMBERS = {1: struct.Struct(">b"), 2: struct.Struct(">h"), 3: struct.Struct(">i"), 4: struct.Struct(">q"), 5: struct.Struct(">f"), 6: struct.Struct(">d")}
_ARRAYS = {7: np.dtype(">i1"), 11: np.dtype(">i4"), 12: np.dtype(">i8")}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise NbtError("the document is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def string(self) -> str:
        (n,) = struct.unpack(">H", self.take(2))
        return self.take(n).decode("utf-8", "replace")

    def count(self) -> int:
        (n,) = struct.unpack(">i", self.take(4))
        if n < 0:
            raise NbtError("a negative length")
        return n

    def value(self, tag: int, depth: int = 0):
        if depth > 512:
            raise NbtError("nested too deeply")
        if tag in _NUMBERS:
            s = _NUMBERS[tag]
            return s.unpack(self.take(s.size))[0]
        if tag == 8:
            return self.string()
        if tag in _ARRAYS:
            kind = _ARRAYS[tag]
            return np.frombuffer(self.take(self.count() * kind.itemsize), dtype=kind)
        if tag == 9:
            inner = self.take(1)[0]
            return [self.value(inner, depth + 1) for _ in range(self.count())]
        if tag == 10:
            out = {}
            while inner := self.take(1)[0]:
                name = self.string()
                out[name] = self.value(inner, depth + 1)
            return out
        raise NbtError(f"unknown tag {tag}")


def read_document(data: bytes) -> dict:
    """The root compound. Lists are lists, arrays are numpy arrays."""
    r = _Reader(data)
    if r.take(1)[0] != 10:
        raise NbtError("the root is no compound")
    r.string()
    return r.value(10)


@dataclass
class Section:
    """16 x 16 x 16 cells as indices into a palette of block names, and 64 biome cells."""

    y: int
    empty: bool = False
    palette: list[str] = field(default_factory=list)
    indices: np.ndarray = field(default_factory=lambda: np.zeros(CELLS, dtype=np.uint16))
    biomes: list[str] = field(default_factory=list)
    biome_indices: np.ndarray = field(default_factory=lambda: np.zeros(BIOME_CELLS, dtype=np.uint16))


@dataclass
class Chunk:
    x: int
    z: int
    sections: list[Section]


def bit_width(size: int, least: int) -> int:
    return 0 if size <= 1 else max(least, (size - 1).bit_length())


def unpack(words: np.ndarray, bits: int, n: int = CELLS) -> np.ndarray:
    """``n`` entries of packed 64-bit words, lowest bits first.

    Enough words for entries that never cross words are read so; fewer hold entries without
    gaps. Missing words count as 0.
    """
    words = np.asarray(words).astype(np.int64).view(np.uint64)
    if not bits or not len(words):
        return np.zeros(n, dtype=np.uint16)
    mask, per = np.uint64((1 << bits) - 1), 64 // bits
    i = np.arange(n)
    if n == BIOME_CELLS or len(words) >= -(-n // per):
        word, off = i // per, (i % per * bits).astype(np.uint64)
        padded = np.concatenate([words, np.zeros(max(0, int(word[-1]) + 1 - len(words)), dtype=np.uint64)])
        return (padded[word] >> off & mask).astype(np.uint16)
    start = i * bits
    word, off = start >> 6, start & 63
    padded = np.concatenate([words, np.zeros(max(0, int(word[-1]) + 2 - len(words)), dtype=np.uint64)])
    value = padded[word] >> off.astype(np.uint64)
    over = off + bits > 64
    value[over] |= padded[word[over] + 1] << (64 - off[over]).astype(np.uint64)
    return (value & mask).astype(np.uint16)


def _typed(parent: dict, key: str, kind, needed: bool = False):
    value = parent.get(key)
    if value is None:
        if needed:
            raise NbtError(f"{key} is missing")
        return None
    if not isinstance(value, kind):
        raise NbtError(f"{key} has another type")
    return value


def _array(parent: dict, key: str, size: int) -> np.ndarray | None:
    value = _typed(parent, key, np.ndarray)
    if value is not None and value.dtype.itemsize != size:
        raise NbtError(f"{key} has another type")
    return value


def _strings(values: list) -> list[str]:
    if not all(isinstance(v, str) for v in values):
        raise NbtError("a name is no text")
    return values


def _names(entries: list) -> list[str]:
    return [_typed(e if isinstance(e, dict) else {}, "Name", str, needed=True) for e in entries]


def is_empty_name(name: str) -> bool:
    return bare_name(name) in EMPTY_NAMES


def _nibbles(packed: np.ndarray | None) -> np.ndarray:
    """4096 half bytes, the low half first; 0 beyond the end."""
    out = np.zeros(CELLS, dtype=np.int64)
    if packed is not None:
        b = packed[: CELLS // 2].view(np.uint8).astype(np.int64)
        out[0 : 2 * len(b) : 2], out[1 : 2 * len(b) : 2] = b & 15, b >> 4
    return out


def _palette_section(s: Section, names: list[str], data: np.ndarray | None) -> None:
    if not names or len(names) == 1 and is_empty_name(names[0]):
        s.empty = True
        return
    s.palette = names
    if data is not None:
        s.indices = unpack(data, bit_width(len(names), 4))


def _numeric_section(s: Section, blocks: np.ndarray, data: np.ndarray | None, add: np.ndarray | None) -> None:
    """Numeric ids to names; a name's code is the order in which it first appears."""
    low = np.zeros(CELLS, dtype=np.int64)
    low[: min(CELLS, len(blocks))] = blocks[:CELLS].view(np.uint8)
    pairs = (_nibbles(add) << 8 | low) << 4 | _nibbles(data)
    kinds, first, which = np.unique(pairs, return_index=True, return_inverse=True)
    codes: dict[str, int] = {}
    by_kind = np.zeros(len(kinds), dtype=np.uint16)
    for k in np.argsort(first):
        by_kind[k] = codes.setdefault(legacy_name(int(kinds[k]) >> 4, int(kinds[k]) & 15), len(codes))
    s.indices, s.palette = by_kind[which], list(codes)
    s.empty = len(codes) == 1 and is_empty_name(s.palette[0])


def _section(raw: dict) -> Section:
    y = _typed(raw, "Y", int, needed=True)
    if not -128 <= y <= 127:
        raise NbtError("Y is out of range")
    s = Section(y)
    states = _typed(raw, "block_states", dict)
    palette = _typed(raw, "Palette", list)
    packed = _array(raw, "BlockStates", 8)
    blocks, data, add = (_array(raw, k, 1) for k in ("Blocks", "Data", "Add"))
    biomes = _typed(raw, "biomes", dict) if isinstance(raw.get("biomes"), dict) else None
    if raw.get("biomes") is not None and biomes is None:
        raise NbtError("biomes has another type")
    if states is not None:
        _palette_section(s, _names(_typed(states, "palette", list, needed=True)), _array(states, "data", 8))
    elif palette is not None:
        _palette_section(s, _names(palette), packed)
    elif blocks is not None:
        _numeric_section(s, blocks, data, add)
    else:
        s.empty = True
    if biomes is not None:
        names, packed = _strings(_typed(biomes, "palette", list, needed=True)), _array(biomes, "data", 8)
        if not s.empty:
            s.biomes = names or ["minecraft:plains"]
            if packed is not None:
                s.biome_indices = unpack(packed, bit_width(len(s.biomes), 1), BIOME_CELLS)
    return s


def parse_chunk(data: bytes, x: int = 0, z: int = 0) -> Chunk:
    """A chunk document of any of the three section layouts; ``x, z`` stand in for missing coordinates."""
    root = read_document(data)
    level = _typed(root, "Level", dict) or {}
    found = [next((v for v in (_typed(d, k, int) for d in (root, level)) if v is not None), other) for k, other in (("xPos", x), ("zPos", z))]
    raw = _typed(root, "sections", list)
    if raw is None:
        raw = _typed(level, "Sections", list) or []
    if not all(isinstance(s, dict) for s in raw):
        raise NbtError("a section is no compound")
    return Chunk(*found, [_section(s) for s in raw])
