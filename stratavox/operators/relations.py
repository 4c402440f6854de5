"""Relational operators that stand by themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratavox.functions.columns import REGION_CHUNK_BITS, bounding_box, region_coord


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by ``order`` of each key: what an upsert in that order leaves.

    A partial aggregate keeps one row per key and task, so hot keys cost no more than others.
    """
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def first_appearance_codes(rows: DataFrame, group: str, pos: str, value: str) -> DataFrame:
    """``rows`` with the dictionary code of ``value`` in its group: its rank by first position."""
    firsts = rows.groupBy(group, value).agg(F.min(pos).alias("first"))
    codes = firsts.withColumn("code", (F.row_number().over(W.partitionBy(group).orderBy("first")) - 1).cast("int")).drop("first")
    return rows.join(codes, [group, value])


def region_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path names a region, with rx and rz."""
    named = paths.withColumns({"rx": region_coord(path, 0), "rz": region_coord(path, 1)})
    return named.where("rx IS NOT NULL AND rz IS NOT NULL")


def in_box(x: Column | str, z: Column | str, center_x: int, center_z: int, radius: int, bits: int = 0) -> Column:
    """Whether chunks (``bits`` 0) or regions (5) lie in the box of chunks around a block."""
    (x0, x1), (z0, z1) = bounding_box(center_x, radius), bounding_box(center_z, radius)
    x, z = (F.col(c) if isinstance(c, str) else c for c in (x, z))
    return x.between(x0 >> bits, x1 >> bits) & z.between(z0 >> bits, z1 >> bits)


def region_prune(regions: DataFrame, center_x: int, center_z: int, radius: int) -> DataFrame:
    """Regions that may hold a chunk of the box."""
    return regions.where(in_box("rx", "rz", center_x, center_z, radius, REGION_CHUNK_BITS))
