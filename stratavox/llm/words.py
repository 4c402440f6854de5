"""Vectorised word scanning over the UTF-8 buffer of an Arrow string column.

A batch is cut into slices of whole documents. All words of a slice are found and
hashed with a few numpy passes over its bytes, so no Python object is made per word.
Bytes 0x80..0xFF belong to words in every alphabet used here, hence no decoding.

A slice of one long document is gone through in pieces of a fixed size, and a word that
crosses pieces is carried over, so besides the text memory is taken per word: 16 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


mix = _splitmix


def _byte_values() -> np.ndarray:
    """A random 64-bit value per byte; A-Z share those of a-z."""
    v = _splitmix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    v[65:91] = v[97:123]
    return v


BYTE_VALUES = _byte_values()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_pow = _powers(_BASE, SLICE_BYTES + 1)
_inv = _powers(_INVERSE, SLICE_BYTES + 1)


def alphabet(pattern_bytes: bytes) -> np.ndarray:
    """True for bytes that belong to a word: all but those given."""
    out = np.ones(256, dtype=bool)
    out[np.frombuffer(pattern_bytes, dtype=np.uint8)] = False
    return out


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = alphabet(bytes([0x20, *range(0x09, 0x0E)]))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: digits, letters, all beyond ASCII.
LETTERED = alphabet(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets within them), whole rows of at most ``most`` bytes or a single row."""
    raw, off = text_buffer(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[1] if len(parts) == 2 else np.concatenate(parts)


def _edges(raw: np.ndarray, a: int, b: int, edges: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of words, and bytes after their last, that lie in bytes a to b, relative to a; documents end at ``edges``."""
    low, high = max(a - 1, 0), min(b + 1, len(raw))
    is_word = member[raw[low:high]]
    inside = slice(a - low, a - low + (b - a))
    begins, ends = is_word[inside].copy(), is_word[inside].copy()
    breaks = edges[np.searchsorted(edges, a) : np.searchsorted(edges, b, side="right")]
    before = np.concatenate([[False], is_word])[inside] if low == a else is_word[: b - a].copy()
    after = np.concatenate([is_word[inside][1:], is_word[a - low + (b - a) :] if high > b else [False]])
    before[breaks[breaks < b] - a] = False
    after[breaks[breaks > a] - a - 1] = False
    begins &= ~before
    ends &= ~after
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _hash_piece(piece: np.ndarray, at: int, start: np.ndarray, end: np.ndarray, begun: int, partial: int) -> tuple[np.ndarray, int, int]:
    """Hashes of the words that end in a piece, and of the word that runs on its first byte and its sum so far."""
    run = np.zeros(len(piece) + 1, dtype=U64)
    np.cumsum(BYTE_VALUES[piece] * _pow[: len(piece)], out=run[1:])
    carried = begun >= 0
    if carried:
        shift = pow(_BASE, at - begun, 1 << 64)
        upto = int(end[0]) if len(end) else len(piece)
        partial = (partial + int(run[upto]) * shift) % (1 << 64)
        if not len(end):
            return np.zeros(0, U64), begun, partial
    own = end[1:] if carried else end
    sums = (run[own] - run[start[: len(own)]]) * _inv[start[: len(own)]]
    if carried:
        sums = np.concatenate([np.array([partial], dtype=U64), sums])
    begun = -1
    if len(start) > len(own):
        last = int(start[-1])
        begun = at + last
        partial = int(((run[-1:] - run[last : last + 1]) * _inv[last])[0])
    return _splitmix(sums), begun, partial


class Words:
    """Words of one slice: start and end bytes, 64-bit hashes, and the first word of every document."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, member: np.ndarray, hashed: bool = True):
        n = len(raw)
        kind = np.int32 if n < 1 << 31 else np.int64
        starts, ends, hashes = [np.zeros(0, kind)], [np.zeros(0, kind)], [np.zeros(0, U64)]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begun, partial = -1, 0
        for a in range(0, n, SLICE_BYTES):
            b = min(a + SLICE_BYTES, n)
            start, end = _edges(raw, a, b, edges, member)
            starts.append((start + a).astype(kind))
            ends.append((end + a).astype(kind))
            if hashed:
                done, begun, partial = _hash_piece(raw[a:b], a, start, end, begun, partial)
                hashes.append(done)
        self.start, self.end = _joined(starts), _joined(ends)
        #: first[i] is the index of the first word of document i; first[-1] is the number of words.
        self.first = np.searchsorted(self.start, offsets.astype(kind))
        if hashed:
            self.hash = _joined(hashes)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


_FACTORS = _splitmix(np.arange(1, 65, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, also of runs that cross documents."""
    if len(words) < n:
        return np.zeros(0, dtype=U64)
    m = len(words) - n + 1
    out = np.zeros(m, dtype=U64)
    for a in range(0, m, SLICE_BYTES):
        part = out[a : a + SLICE_BYTES]
        for j in range(n):
            part += words[a + j : a + j + len(part)] * _FACTORS[j]
        _splitmix(part)
    return out
