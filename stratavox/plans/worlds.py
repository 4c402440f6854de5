"""Queries that make region files from the block adapter and run the binary path over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions.columns import TILE_BITS, floor_shift
from stratavox.operators.tiles import nested_tiles, tiles_of_chunks
from stratavox.plans.adapters import AIR_CODE, PALETTE, adapter
from stratavox.plans.job import assemble, encoded_tiles
from stratavox.sources.blobs import encode
from stratavox.sources.regions import by_document, runs_of, scan
from stratavox.sources.tables import written
from stratavox.sources.writer import middle_section, modern_chunk, modern_section, old_chunk, region

LOW_SECTION, SECTIONS = -1, 3
#: Chunks by which the documents of ``document_tiles`` say they are elsewhere: not a multiple of a tile.
DOCUMENTS_MOVED = (101, -46)


def region_files_of(blocks: DataFrame, palette: list[str], default: int, moved: tuple[int, int] = (0, 0)) -> DataFrame:
    """(path, content): a region file for each 512 x 512 blocks of ``blocks(gx, gz, y, pal)``.

    Chunks take turns among the four codecs, and between documents of today and of the
    middle era, whose entries span words or not. Documents state places ``moved`` by some chunks.
    """

    def build(t: pa.Table) -> pa.Table:
        gx, gz, y, pal = (t.column(c).to_numpy() for c in ("gx", "gz", "y", "pal"))
        rx, rz = int(gx[0]) >> 9, int(gz[0]) >> 9
        cells = np.full((32, 32, SECTIONS, 4096), default, dtype=np.uint8)
        up = y - LOW_SECTION * 16
        cells[gx >> 4 & 31, gz >> 4 & 31, up >> 4, (up & 15) * 256 + (gz & 15) * 16 + (gx & 15)] = pal
        chunks = {}
        for x, z in sorted(set(zip((gx >> 4 & 31).tolist(), (gz >> 4 & 31).tolist(), strict=True)), key=lambda c: (c[1], c[0])):
            at = rx * 32 + x + moved[0], rz * 32 + z + moved[1]
            if z % 3:
                document = modern_chunk(*at, [modern_section(LOW_SECTION + s, palette, cells[x, z, s]) for s in range(SECTIONS)])
            else:
                document = old_chunk(*at, [middle_section(LOW_SECTION + s, palette, cells[x, z, s], z % 2 == 0) for s in range(SECTIONS)])
            chunks[x, z] = document, 1 + (x + z) % 4
        return pa.table({"path": [f"region/r.{rx}.{rz}.mca"], "content": pa.array([region(chunks)], pa.binary())})

    keyed = blocks.select("gx", "gz", "y", "pal", floor_shift("gx", 9).alias("rx"), floor_shift("gz", 9).alias("rz"))
    return keyed.groupBy("rx", "rz").applyInArrow(build, "path string, content binary")


def _chunks(spark: SparkSession, sf_dir: str, moved: tuple[int, int] = (0, 0)) -> DataFrame:
    return scan(region_files_of(adapter(spark, sf_dir, "blocks"), [f"minecraft:{n}" for n in PALETTE], AIR_CODE, moved))


def scan_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region files of the adapter's blocks, decoded: bounds, hashes and runs by chunk."""
    heights = F.aggregate("runs", F.lit(0), lambda s, r: s + r["y_max"] - r["y_min"] + 1)
    return _chunks(spark, sf_dir).select("chunk_x", "chunk_z", "min_y", "max_y", "hash", F.size("runs").alias("n_runs"), heights.alias("height"))


def bake_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files baked to level 4 by definition: every tile with its checksum and size before compression."""
    made = assemble(written(_chunks(spark, sf_dir), "chunks"), 4)
    return encode(nested_tiles(made.tiles, made.runs)).select("level", "pos_x", "pos_z", "min_y", "checksum", "raw_bytes")


def bake_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as the bake job makes it, three levels at a time in bulk."""
    made = encoded_tiles(written(_chunks(spark, sf_dir), "chunks"), 4)
    return made.select("level", "pos_x", "pos_z", "min_y", "checksum", "raw_bytes")


def document_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-0 tiles by the places that documents state, which differ from those of their files."""
    placed = by_document(_chunks(spark, sf_dir, DOCUMENTS_MOVED))
    tiles = tiles_of_chunks(placed.select("chunk_x", "chunk_z", "min_y", "max_y", "path", "slot"), ["path", "slot"])
    counts = runs_of(placed).groupBy(floor_shift("gx", TILE_BITS).alias("pos_x"), floor_shift("gz", TILE_BITS).alias("pos_z")).agg(
        F.count("*").alias("runs"), F.sum((F.col("y_max") - F.col("y_min") + 1).cast("long")).alias("height")
    )
    zero = F.lit(0).cast("long")
    return tiles.join(counts, ["pos_x", "pos_z"], "left").select("pos_x", "pos_z", "min_y", "max_y", F.coalesce("runs", zero).alias("runs"), F.coalesce("height", zero).alias("height"))
