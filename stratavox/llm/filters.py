"""Bitmaps of keys, sized from their number: what may be in a set, without joining all rows with it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Bits for each key, and the largest bitmap (128 MB): beyond 2**26 keys more and more false hits pass, which cost time only.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 16, 30


def filter_bits(n: int) -> int:
    """The logarithm of the bits of a filter of ``n`` keys."""
    return min(max(LEAST_BITS, (BITS_PER_KEY * max(n, 1) - 1).bit_length()), MOST_BITS)


def bitmap(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """One bit set per key of ``keys`` (hashes, of which the highest bits count); executors aggregate it by 64-bit words."""
    bits = filter_bits(n)
    p = F.shiftrightunsigned(column, 64 - bits)
    words = keys.select(F.shiftright(p, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int")).alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=U64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(U64)
    return out


def key_filter(keys: DataFrame, column: str, n: int) -> Broadcast:
    return keys.sparkSession.sparkContext.broadcast(bitmap(keys, column, n))


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of some 64-bit hashes may be among the keys of a bitmap."""
    p = hashes.view(U64) >> U64(64 - (len(bits) << 6).bit_length() + 1)
    return (bits[(p >> U64(6)).astype(np.int64)] >> (p & U64(63)) & U64(1)).astype(bool)


def may_hold(shared: Broadcast, hashed: Column) -> Column:
    """True for every row whose hash is among the keys, and for few others."""

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        return pa.array(holds(shared.value, h.to_numpy(zero_copy_only=False)))

    return test(hashed)
