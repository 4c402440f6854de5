"""The bake job: region files to a pyramid of tiles in SQLite."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratavox.operators.region_levels import STEP, region_tiles, tiles_above
from stratavox.operators.relations import last_wins
from stratavox.operators.tiles import MAX_LEVEL, REGION_LEVELS, pyramid, tile_pyramid, tiles_of_chunks
from stratavox.sources.blobs import DEFAULT_LEVEL
from stratavox.sources.regions import Box, discover, runs_of, scan
from stratavox.sources.sqlite import write_tiles
from stratavox.sources.tables import written


@dataclass(frozen=True)
class BakeOptions:
    """Options of a bake; the centre is in blocks, the radius in chunks."""

    map: str
    # Fixed by the format: the file that readers look for.
    output: str = "DistantHorizons.sqlite"
    cx: int = 0
    cz: int = 0
    radius: int = 64
    threads: int | None = None
    detail_levels: int = 4
    zstd_level: int = DEFAULT_LEVEL
    verbose: bool = False
    quiet: bool = False
    top_only: bool = False

    def __post_init__(self):
        if not 0 <= self.detail_levels <= MAX_LEVEL:
            raise ValueError(f"detail levels must be from 0 to {MAX_LEVEL}")
        if not 1 <= self.zstd_level <= 22:
            raise ValueError("the compression level must be from 1 to 22")

    @property
    def box(self) -> Box:
        return Box.around(self.cx, self.cz, self.radius)


@dataclass
class Baked:
    """Relations of a bake."""

    chunks: DataFrame
    tiles: DataFrame
    runs: DataFrame

    @property
    def hashes(self) -> DataFrame:
        return hashes_of(self.chunks)

    @property
    def rejects(self) -> DataFrame:
        return self.chunks.where("error IS NOT NULL").select("path", "slot", "error")


def hashes_of(chunks: DataFrame) -> DataFrame:
    """(chunk_x, chunk_z, hash); of files for one place the last path counts."""
    rows = chunks.where("error IS NULL").select("chunk_x", "chunk_z", "hash", "path")
    return last_wins(rows, ["chunk_x", "chunk_z"], "path").drop("path")


def assemble(chunks: DataFrame, levels: int, top_only: bool = False, keep: Callable[[DataFrame, str], DataFrame] | None = written) -> Baked:
    """Level 0 from decoded chunks, and the levels above.

    Files for one place are rare (several dimensions in one folder): the last path wins.
    Tiles come from chunks, not from runs, so a tile of empty chunks is there as well.
    """
    good = chunks.where("error IS NULL")
    best = F.max("path").over(W.partitionBy("chunk_x", "chunk_z"))
    good = good.withColumn("best", best).where("path = best").drop("best")
    runs = pyramid(runs_of(good), levels, top_only, keep)
    tiles = tile_pyramid(tiles_of_chunks(good.select("chunk_x", "chunk_z", "min_y", "max_y", "slot"), ["slot"]), levels)
    return Baked(chunks, tiles, runs)


def encoded_tiles(chunks: DataFrame, levels: int, top_only: bool = False, zstd_level: int = DEFAULT_LEVEL) -> DataFrame:
    """(level, pos_x, pos_z, min_y, checksum, data, raw_bytes) of all tiles: what ``assemble`` and ``encode`` give."""
    steps = [written(region_tiles(chunks, levels, top_only, zstd_level), "tiles")]
    for level in range(REGION_LEVELS, levels, STEP):
        steps.append(written(tiles_above(steps[-1], level, levels, top_only, zstd_level), "tiles"))
    columns = ["level", "pos_x", "pos_z", "min_y", "checksum", "data", "raw_bytes"]
    return reduce(DataFrame.union, [s.select(*columns) for s in steps])


def bake(spark: SparkSession, options: BakeOptions) -> Baked:
    """The relations of a map. Chunks are decoded once and written: bounds, hashes and runs all read them."""
    chunks = written(scan(discover(spark, options.map, options.box), options.box), "chunks")
    return assemble(chunks, options.detail_levels, options.top_only)


def run(spark: SparkSession, options: BakeOptions) -> dict[str, float]:
    """Bake into SQLite and report counts, seconds and rates. Without region files nothing is written."""
    say = (lambda *_: None) if options.quiet else print
    began = time.time()
    files = discover(spark, options.map, options.box)
    regions = files.select("path").count()
    say(f"regions: {regions} files, {(time.time() - began) * 1000:.0f} ms")
    if not regions:
        return {"regions": 0}
    at = time.time()
    counters = Observation("decoding")
    read = scan(files, options.box).observe(counters, F.count_if(F.col("error").isNull()).alias("found"), F.count("error").alias("bad"))
    chunks = written(read, "chunks")
    found, bad = counters.get["found"], counters.get["bad"]
    took = time.time() - at
    say(f"decoding: {found} chunks, {bad} skipped, {took:.2f} s, {found / max(took, 1e-9):.0f} chunks/s")
    at = time.time()
    encoded = encoded_tiles(chunks, options.detail_levels, options.top_only, options.zstd_level)
    sizes = {r["level"]: (r["n"], r["bytes"]) for r in encoded.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("bytes")).collect()}
    tiles, total = sum(n for n, _ in sizes.values()), sum(b for _, b in sizes.values())
    say(f"pyramid: {tiles} tiles, {(time.time() - at) * 1000:.0f} ms; by level {({k: sizes[k][0] for k in sorted(sizes)})}")
    at = time.time()
    rows = write_tiles(encoded, hashes_of(chunks), options.output)
    say(f"sink: {sum(rows)} rows, {(time.time() - at) * 1000:.0f} ms, {total / 1e6:.2f} MB")
    seconds = time.time() - began
    say(f"total: {seconds:.2f} s, {found / max(seconds, 1e-9):.0f} chunks/s")
    return {"regions": regions, "chunks": found, "skipped": bad, "tiles": tiles, "bytes": total, "seconds": seconds}


def parse(argv: list[str] | None = None) -> BakeOptions:
    p = argparse.ArgumentParser(prog="stratavox", description="Bake region files into a pyramid of tiles.")
    p.add_argument("--map", required=True, help="folder of region files, or a zip archive of one")
    p.add_argument("--output", default=BakeOptions.output)
    p.add_argument("--cx", type=int, default=0, help="centre, in blocks")
    p.add_argument("--cz", type=int, default=0)
    p.add_argument("--radius", type=int, default=64, help="in chunks")
    p.add_argument("-j", "-t", "--threads", type=int, default=None)
    p.add_argument("--detail-levels", type=int, default=4)
    p.add_argument("--zstd-level", type=int, default=DEFAULT_LEVEL)
    p.add_argument("--top-only", action="store_true", help="level 1 from topmost runs only")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--quiet", action="store_true")
    return BakeOptions(**vars(p.parse_args(argv)))


def main(argv: list[str] | None = None) -> int:
    options = parse(argv)
    spark = SparkSession.builder.appName("stratavox").master(f"local[{options.threads or '*'}]").config("spark.ui.enabled", options.verbose)
    spark = spark.config("spark.ui.showConsoleProgress", not options.quiet).getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if options.verbose else "ERROR")
    run(spark, options)
    return 0

