"""From blocks to runs: materials, vertical run lengths, bounds, chunk hashes.

Relations: blocks (gx, gz, y, ...), runs (gx, gz, run_ord, y_min, y_max, color, flags).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratavox.functions.columns import CHUNK_BITS, MASK, floor_shift, signed32
from stratavox.functions.materials import is_solid, with_material

#: Bounds that a chunk starts from before its blocks count.
FLOOR, CEILING = -64, 320
SECTION_CELLS = 4096


def palette_name(index: Column | str, palette: list[str]) -> Column:
    """Palette entry by index; one out of range means the first, and an empty palette none."""
    if not palette:
        return F.lit(None).cast("string")
    i = F.col(index) if isinstance(index, str) else index
    names = F.array(*map(F.lit, palette))
    return F.when((i >= 0) & (i < len(palette)), F.try_element_at(names, i.cast("int") + 1)).otherwise(F.lit(palette[0]))


def cell_of(index: Column) -> dict[str, Column]:
    """x, y, z within a section of an index ``y * 256 + z * 16 + x``."""
    return {"x": index.bitwiseAND(15), "y": F.shiftright(index, 8).bitwiseAND(15), "z": F.shiftright(index, 4).bitwiseAND(15)}


def solid_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with the colour and flags of their name, without air and colourless ones."""
    return with_material(blocks).where(is_solid())


def vertical_runs(solid: DataFrame) -> DataFrame:
    """Maximal vertical runs of equal (color, flags) of ``solid(gx, gz, y, color, flags)``.

    Gaps and islands: within a column and a material, y less its rank is constant along a
    run. One shuffle by column serves ranking, grouping and numbering.
    """
    column = W.partitionBy("gx", "gz")
    ranked = solid.repartition("gx", "gz").withColumn("island", F.col("y") - F.row_number().over(W.partitionBy("gx", "gz", "color", "flags").orderBy("y")))
    runs = ranked.groupBy("gx", "gz", "color", "flags", "island").agg(F.min("y").cast("int").alias("y_min"), F.max("y").cast("int").alias("y_max"))
    numbered = runs.withColumn("run_ord", F.row_number().over(column.orderBy("y_min")) - 1)
    return numbered.select("gx", "gz", "run_ord", "y_min", "y_max", F.col("color").cast("long").alias("color"), F.col("flags").cast("int").alias("flags"))


def chunk_bounds(blocks: DataFrame) -> DataFrame:
    """(chunk_x, chunk_z, min_y, max_y) of ``blocks`` with material columns, clamped; (0, 0) without solid blocks."""
    y = F.when(is_solid(), F.col("y"))
    low, high = F.least(F.min(y), F.lit(CEILING)), F.greatest(F.max(y), F.lit(FLOOR))
    keys = [floor_shift("gx", CHUNK_BITS).alias("chunk_x"), floor_shift("gz", CHUNK_BITS).alias("chunk_z")]
    some = F.max(y).isNotNull()
    return blocks.groupBy(*keys).agg(
        F.when(some, low).otherwise(0).cast("int").alias("min_y"), F.when(some, high).otherwise(0).cast("int").alias("max_y")
    )


def sections(blocks: DataFrame) -> DataFrame:
    """(chunk_x, chunk_z, section_y, ord): a chunk's sections from the lowest up."""
    keys = [floor_shift("gx", CHUNK_BITS).alias("chunk_x"), floor_shift("gz", CHUNK_BITS).alias("chunk_z")]
    found = blocks.select(*keys, floor_shift("y", CHUNK_BITS).alias("section_y")).distinct()
    order = W.partitionBy("chunk_x", "chunk_z").orderBy("section_y")
    return found.withColumn("ord", F.row_number().over(order) - 1)


def powers_of_31(spark: SparkSession, n: int) -> DataFrame:
    """(e, pw) with 31**e modulo 2**32 for e below ``n``."""
    rows, p = [], 1
    for e in range(n):
        rows.append((e, p))
        p = p * 31 & MASK
    return spark.createDataFrame(rows, "e long, pw long")


def chunk_hash(cells: DataFrame, count: int, default: int = 0) -> DataFrame:
    """(chunk_x, chunk_z, hash) over ``count`` palette codes in order, from ``cells(chunk_x, chunk_z, i, code)``.

    h = 31 * h + code from 1 is a sum of powers, so it needs no order: missing codes count as
    ``default``, whose sum is known, and each cell adds its difference. Terms stay below 2**48.
    """
    spark = cells.sparkSession
    pw = powers_of_31(spark, count)
    fixed = pow(31, count, 1 << 32)
    fixed = (fixed + default * sum(pow(31, e, 1 << 32) for e in range(count))) & MASK
    term = ((F.col("code") - default) * F.col("pw")).cast("long")
    summed = cells.withColumn("e", F.lit(count - 1) - F.col("i")).join(F.broadcast(pw), "e").groupBy("chunk_x", "chunk_z").agg(F.sum(F.pmod(term, F.lit(MASK + 1))).alias("s"))
    return summed.select("chunk_x", "chunk_z", signed32(F.col("s") + fixed).alias("hash"))
