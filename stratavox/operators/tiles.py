"""Tiles and the level-of-detail pyramid.

Relations: runs (level, gx, gz, run_ord, y_min, y_max, color, flags) and tiles (level,
pos_x, pos_z, min_y, max_y). A tile is 64 x 64 columns. Tiles stand on their own: one whose
columns are all empty is still a tile. A parent column is found by halving coordinates
downwards, so a level is one grouped aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions.columns import TILE_BITS, TILE_CHUNK_BITS, blend_array, floor_shift

MAX_LEVEL = 10
SAMPLES = 8
#: Levels at which a cell lies within one region of 512 blocks.
REGION_LEVELS = 3


def cell(gx: Column | str = "gx", gz: Column | str = "gz") -> Column:
    """Index of a column within its tile, x first."""
    gx, gz = (F.col(c) if isinstance(c, str) else c for c in (gx, gz))
    return (gx.bitwiseAND(63) * 64 + gz.bitwiseAND(63)).cast("int")


def min_fold(ordered: Column) -> Column:
    """Fold of minima in order in which 0 stands for "not set": a later value replaces a 0."""
    return F.aggregate(ordered, F.lit(0), lambda s, m: F.when((m < s) | (s == 0), m).otherwise(s))


def fold_few(rows: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """``fold_tiles`` for groups that are bounded: the 16 chunks of a tile, the 4 children of a parent."""
    listed = F.sort_array(F.collect_list(F.struct(*order, "min_y")))
    ordered = F.transform(listed, lambda r: r["min_y"])
    return rows.groupBy(*keys).agg(min_fold(ordered).cast("int").alias("min_y"), F.greatest(F.max("max_y"), F.lit(0)).cast("int").alias("max_y"))


def fold_tiles(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(*keys, min_y, max_y) from ``rows`` with min_y and max_y, folded as ``min_fold`` does in ``order``, for groups of any size.

    In closed form, so that all of it aggregates partially: the least value if it is not 0,
    else the least after the last 0, else 0.
    """
    place = F.struct(*order)
    ends = rows.groupBy(*keys).agg(F.min("min_y").alias("low"), F.max(F.when(F.col("min_y") == 0, place)).alias("last"), F.greatest(F.max("max_y"), F.lit(0)).cast("int").alias("max_y"))
    after = rows.join(ends.where("low = 0").select(*keys, "last"), keys).where(place > F.col("last")).groupBy(*keys).agg(F.min("min_y").alias("tail"))
    low = F.when(F.col("low") == 0, F.coalesce("tail", F.lit(0))).otherwise(F.col("low"))
    return ends.join(after, keys, "left").select(*keys, low.cast("int").alias("min_y"), "max_y")


def tiles_of_chunks(bounds: DataFrame, order: list[str]) -> DataFrame:
    """Level-0 tiles of ``bounds(chunk_x, chunk_z, min_y, max_y, *order)``."""
    keys = [floor_shift("chunk_x", TILE_CHUNK_BITS).alias("pos_x"), floor_shift("chunk_z", TILE_CHUNK_BITS).alias("pos_z")]
    return fold_few(bounds, keys, order)


def parent_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles of the next level; children count in order of their position."""
    keys = [(F.col("level") + 1).alias("level"), floor_shift("pos_x", 1).alias("px"), floor_shift("pos_z", 1).alias("pz")]
    return fold_few(tiles, keys, ["pos_x", "pos_z"]).select("level", F.col("px").alias("pos_x"), F.col("pz").alias("pos_z"), "min_y", "max_y")


def samples(runs: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Per 2 x 2 cell its runs in order (column x, column z, then upwards) and bounds.

    Four columns hold few runs each, so the list of a cell is short. ``within`` names columns
    that are equal in all runs of a cell; runs partitioned by them need no shuffle.
    """
    ordered = F.sort_array(
        F.collect_list(
            F.struct(
                F.col("gx").bitwiseAND(1).alias("cx"), F.col("gz").bitwiseAND(1).alias("cz"), "run_ord", F.col("color").alias("color"), F.col("flags").alias("flags")
            )
        )
    )
    return runs.groupBy(*within, floor_shift("gx", 1).alias("px"), floor_shift("gz", 1).alias("pz")).agg(
        ordered.alias("points"), F.min("y_min").cast("int").alias("y_min"), F.max("y_max").cast("int").alias("y_max")
    )


def first_flags(points: Column) -> Column:
    """Flags of the first sample that has any."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(points, lambda p: p["flags"]), lambda f: f != 0), F.lit(1)), F.lit(0)).cast("int")


def downsample(runs: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(gx, gz, run_ord, y_min, y_max, color, flags) of the next level: one run per cell that has any.

    Bounds are over all runs of the four columns, the colour over the first eight.
    """
    colors = F.slice(F.transform("points", lambda p: p["color"]), 1, SAMPLES)
    return samples(runs, within).select(
        *within, F.col("px").alias("gx"), F.col("pz").alias("gz"), F.lit(0).alias("run_ord"), "y_min", "y_max", blend_array(colors).alias("color"), first_flags(F.col("points")).alias("flags")
    )


def top_runs(runs: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """The topmost run of every column."""
    top = F.max_by(F.struct("run_ord", "y_min", "y_max", "color", "flags"), "run_ord").alias("top")
    return runs.groupBy(*within, "gx", "gz").agg(top).select(*within, "gx", "gz", "top.*")


def downsample_top(runs: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Next level from the topmost run of each column; a cell without alpha is empty."""
    return downsample(top_runs(runs, within), within).where(F.col("color") != 0)


def pyramid(runs: DataFrame, levels: int, top_only: bool = False, keep=None) -> DataFrame:
    """Runs of levels 0 to ``levels`` with their ``level``.

    Each level aggregates the truncated output of the one below, so they follow each other.
    Up to level 3 a cell never crosses a region, so these levels share one partitioning by
    region. ``keep`` (a function of a table and a name) may write a level down, which spares
    levels above it from computing it again. Level 1 of ``top_only`` takes topmost runs.
    """
    if not 0 <= levels <= MAX_LEVEL:
        raise ValueError(f"levels must be from 0 to {MAX_LEVEL}")
    columns = ["gx", "gz", "run_ord", "y_min", "y_max", "color", "flags"]
    region = ("rx", "rz")
    now = runs.select(*columns, *[floor_shift(g, 9).alias(r) for g, r in zip(("gx", "gz"), region, strict=True)])
    if levels:
        now = now.repartition(*region)
    out = now.select(F.lit(0).alias("level"), *columns)
    for level in range(1, levels + 1):
        within = region if level <= REGION_LEVELS else ()
        now = (downsample_top if top_only else downsample)(now, within).select(*columns, *within)
        if keep is not None:
            now = keep(now, f"level{level}")
        out = out.union(now.select(F.lit(level).alias("level"), *columns))
    return out


def tile_pyramid(tiles: DataFrame, levels: int, keep=None) -> DataFrame:
    """Tiles of levels 0 to ``levels`` from those of level 0."""
    now = tiles.select(F.lit(0).alias("level"), "pos_x", "pos_z", "min_y", "max_y")
    out = now
    for level in range(1, levels + 1):
        now = parent_tiles(now)
        if keep is not None:
            now = keep(now, f"tiles{level}")
        out = out.union(now)
    return out


def nested_tiles(tiles: DataFrame, runs: DataFrame) -> DataFrame:
    """``tiles`` with their runs as a list of (cell, run_ord, y_min, y_max, color, flags); empty tiles stay."""
    run = F.struct(cell().alias("cell"), "run_ord", "y_min", "y_max", "color", "flags")
    keys = [F.col("level"), floor_shift("gx", TILE_BITS).alias("pos_x"), floor_shift("gz", TILE_BITS).alias("pos_z")]
    lists = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(run)).alias("runs"))
    return tiles.join(lists, ["level", "pos_x", "pos_z"], "left")
