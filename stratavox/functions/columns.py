"""Scalar and array functions as expressions: coordinates, colours, hashes, packed words, records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Bits by which coordinates nest: block to chunk, chunk to tile and region, tile to parent.
CHUNK_BITS, TILE_CHUNK_BITS, REGION_CHUNK_BITS, TILE_BITS = 4, 2, 5, 6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_shift(c: Column | str, bits: int) -> Column:
    """Division by 2**bits that rounds down, also for negatives."""
    return F.shiftright(col(c), bits)


def bounding_box(center: int, radius: int) -> tuple[int, int]:
    """Chunks from ``center`` (a block) less to plus ``radius`` (chunks), inclusive."""
    return (center >> CHUNK_BITS) - radius, (center >> CHUNK_BITS) + radius


def region_coord(path: Column | str, axis: int) -> Column:
    """x (axis 0) or z (axis 1) of ``.../r.<x>.<z>[.anything].mca``; null for other names."""
    base = F.substring_index(col(path), "/", -1)
    text = F.regexp_extract(base, r"^r\.([+-]?[0-9]+)\.([+-]?[0-9]+)(\..*)?\.mca$", axis + 1)
    return F.nullif(text, F.lit("")).try_cast("int")


def signed32(c: Column) -> Column:
    """The low 32 bits as a signed number."""
    low = c.bitwiseAND(MASK)
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def poly_hash(values: Column, seed: int = 1) -> Column:
    """h = 31 * h + x over an array, wrapped to 32 bits and signed."""
    fold = F.aggregate(values, F.lit(seed).cast("long"), lambda h, x: (h * 31 + x).bitwiseAND(MASK))
    return signed32(fold)


def signed_bytes(hex_text: Column | str) -> Column:
    """Bytes of a hex string as numbers from -128 to 127."""
    c = col(hex_text)
    byte = lambda i: F.conv(F.substr(c, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    every = F.when(F.length(c) > 1, F.sequence(F.lit(0), F.shiftright(F.length(c), 1) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(every, lambda i: _signed8(byte(i)))


def _signed8(b: Column) -> Column:
    return F.when(b > 127, b - 256).otherwise(b)


def channel(color: Column, shift: int) -> Column:
    return F.shiftrightunsigned(color, shift).bitwiseAND(255)


def argb(a: Column, r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 24).bitwiseOR(F.shiftleft(r.cast("long"), 16)).bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(b.cast("long"))


def blend(color: Column | str, where: Column | None = None) -> Column:
    """Aggregate: truncated mean per channel over colours with alpha; 0 if there are none."""
    c = col(color)
    shown = channel(c, 24) > 0
    if where is not None:
        shown = shown & where
    n = F.sum(F.when(shown, 1).otherwise(0))
    means = [F.floor(F.sum(F.when(shown, channel(c, s)).otherwise(0)) / F.greatest(n, F.lit(1))) for s in (24, 16, 8, 0)]
    return argb(*means)


def blend_array(colors: Column) -> Column:
    """The same over an array."""
    shown = F.filter(colors, lambda c: channel(c, 24) > 0)
    n = F.size(shown)
    total = lambda s: F.aggregate(shown, F.lit(0).cast("long"), lambda t, c: t + channel(c, s))
    return F.when(n > 0, argb(*[F.floor(total(s) / n) for s in (24, 16, 8, 0)])).otherwise(F.lit(0).cast("long"))


def bit_width(size: Column, least: int) -> Column:
    """Bits of an index into ``size`` palette entries: none for one entry, ``least`` or more otherwise."""
    return F.when(size <= 1, 0).otherwise(F.greatest(F.lit(least), F.length(F.bin((size - 1).cast("long"))))).cast("int")


def _word(words: Column, i: Column) -> Column:
    return F.coalesce(F.try_element_at(words, i.cast("int") + 1), F.lit(0).cast("long"))


def unpack_aligned(words: Column, bits: int, n: int) -> Column:
    """``n`` entries of ``bits`` bits from 64-bit words, lowest first, none across two words; missing ones are 0."""
    if not bits:
        return F.array_repeat(F.lit(0).cast("long"), n)
    per, mask = 64 // bits, (1 << bits) - 1
    shift = lambda i: (F.pmod(i, F.lit(per)) * bits).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftrightunsigned", _word(words, F.floor(i / per)), shift(i)).bitwiseAND(mask))


def unpack_spanning(words: Column, bits: int, n: int) -> Column:
    """``n`` entries packed without gaps, so that one may begin in a word and end in the next."""
    if not bits:
        return F.array_repeat(F.lit(0).cast("long"), n)
    mask = (1 << bits) - 1

    def entry(i: Column) -> Column:
        start = i * bits
        at, off = F.shiftright(start, 6), start.bitwiseAND(63)
        low = F.call_function("shiftrightunsigned", _word(words, at), off)
        # 64 - off bits came from the first word; the next one's go above them.
        high = F.when(off + bits > 64, F.call_function("shiftleft", _word(words, at + 1).bitwiseAND(mask), F.lit(64) - off)).otherwise(F.lit(0).cast("long"))
        return low.bitwiseOR(high).bitwiseAND(mask)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), entry)


def unpack(words: Column, bits: int, n: int = 4096) -> Column:
    """Aligned where the words suffice for that, spanning otherwise; no words give zeros."""
    if not bits:
        return F.array_repeat(F.lit(0).cast("long"), n)
    enough = F.size(words) >= -(-n // (64 // bits))
    return F.when(F.size(words) == 0, F.array_repeat(F.lit(0).cast("long"), n)).when(enough, unpack_aligned(words, bits, n)).otherwise(unpack_spanning(words, bits, n))


def nibble(octets: Column, i: Column) -> Column:
    """Half of byte ``i // 2`` of an array: the low one for even ``i``; 0 beyond its end."""
    b = F.coalesce(F.try_element_at(octets, F.shiftright(i, 1) + 1), F.lit(0))
    return F.when(i.bitwiseAND(1) == 0, b.bitwiseAND(15)).otherwise(F.shiftright(b, 4).bitwiseAND(15))


def hex_of(c: Column, digits: int) -> Column:
    """Lowest ``digits`` hex digits, also of negatives."""
    return F.lpad(F.hex(c.cast("long").bitwiseAND((1 << 4 * digits) - 1)), digits, "0")


def varint_hex(c: Column) -> Column:
    """LEB128 bytes of a number below 2**35 as hex."""
    c = c.cast("long")
    groups = [F.shiftright(c, 7 * k).bitwiseAND(127) for k in range(5)]
    forms = [F.concat(*[hex_of(g + 128, 2) for g in groups[:k]], hex_of(groups[k], 2)) for k in range(5)]
    return reduce(lambda chain, k: chain.when(c < 1 << 7 * (k + 1), forms[k]), range(1, 5), F.when(c < 128, forms[0]))


def run_hex(y_min: Column, y_max: Column, color: Column, flags: Column) -> Column:
    """The ten big-endian bytes of a run as hex."""
    return F.concat(hex_of(y_min, 4), hex_of(y_max, 4), hex_of(color, 8), hex_of(flags, 4))
