"""Queries by name: every relational operator over the adapters of the generic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions import columns as C
from stratavox.functions import materials as M
from stratavox.operators import relations as R
from stratavox.operators import tiles as T
from stratavox.operators import voxels as V
from stratavox.plans.adapters import AIR_CODE, PALETTE, adapter
from stratavox.plans.oracles import ORACLES  # noqa: F401
from stratavox.plans.worlds import bake_levels, bake_world, document_tiles, scan_world
from stratavox.sources.blobs import checksums
from stratavox.sources.tables import written

CENTER, RADIUS = (8, -40), 40
LOW_SECTION, SECTIONS = -1, 3


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return adapter(spark, d, "blocks").withColumn("name", V.palette_name("pal", PALETTE))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return V.vertical_runs(V.solid_blocks(_blocks(spark, d)))


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return V.chunk_bounds(M.with_material(_blocks(spark, d)))


def region_path_parse(spark: SparkSession, d: str) -> DataFrame:
    paths = adapter(spark, d, "region_paths")
    return paths.select("seq", C.region_coord("path", 0).alias("rx"), C.region_coord("path", 1).alias("rz"))


def region_bbox_prune(spark: SparkSession, d: str) -> DataFrame:
    found = R.region_prune(R.region_files(adapter(spark, d, "region_paths")), *CENTER, RADIUS)
    return found.select("seq", "rx", "rz")


def chunk_bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    chunks = _blocks(spark, d).select(C.floor_shift("gx", 2).alias("chunk_x"), C.floor_shift("gz", 2).alias("chunk_z")).distinct()
    kept = chunks.where(R.in_box("chunk_x", "chunk_z", 0, 0, 2))
    local = [F.col("chunk_x").bitwiseAND(31).alias("local_x"), F.col("chunk_z").bitwiseAND(31).alias("local_z")]
    return kept.select("chunk_x", "chunk_z", *local, C.floor_shift("chunk_x", 2).alias("pos_x"), C.floor_shift("chunk_z", 2).alias("pos_z"))


def unpack_aligned(spark: SparkSession, d: str) -> DataFrame:
    words = adapter(spark, d, "packed_words")
    return words.select("k", F.posexplode(C.unpack_aligned(F.array("w"), 5, 12)).alias("i", "v"))


def unpack_spanning(spark: SparkSession, d: str) -> DataFrame:
    words = adapter(spark, d, "packed_words")
    pair = F.array(F.col("w"), F.lit(-1).cast("long") - F.col("w"))
    return words.select("k", F.posexplode(C.unpack_spanning(pair, 5, 25)).alias("i", "v"))


def palette_bit_width(spark: SparkSession, d: str) -> DataFrame:
    sizes = adapter(spark, d, "block_names").groupBy("grp").agg(F.count_distinct("name").cast("int").alias("size"))
    return sizes.select("grp", "size", C.bit_width(F.col("size"), 4).alias("block_bits"), C.bit_width(F.col("size"), 1).alias("biome_bits"))


def legacy_id_decode(spark: SparkSession, d: str) -> DataFrame:
    ids = adapter(spark, d, "legacy_ids")
    both = F.array(F.col("meta").bitwiseOR(F.shiftleft(F.col("id").bitwiseAND(15), 4)))
    return ids.select(
        "k", M.legacy_name_of(F.col("id"), F.col("meta")).alias("name"), C.nibble(both, F.lit(0)).cast("int").alias("low"), C.nibble(both, F.lit(1)).cast("int").alias("high")
    )


def first_appearance_dict(spark: SparkSession, d: str) -> DataFrame:
    coded = R.first_appearance_codes(adapter(spark, d, "block_names"), "grp", "pos", "name")
    return coded.select("grp", "pos", "name", "code")


def air_filter(spark: SparkSession, d: str) -> DataFrame:
    names = M.with_material(adapter(spark, d, "block_names"))
    return names.select("pos", "name", M.is_empty_name("name").alias("is_empty"), M.is_solid().alias("is_solid"))


def material_lookup(spark: SparkSession, d: str) -> DataFrame:
    return M.with_material(adapter(spark, d, "block_names"), exact_only=True).select("pos", "color", "flags", "light", "opacity")


def material_fallback(spark: SparkSession, d: str) -> DataFrame:
    return M.with_material(adapter(spark, d, "block_names")).select("pos", "color", "flags", "light", "opacity")


def vertical_rle(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)


def chunk_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _bounds(spark, d)


def palette_index_clamp(spark: SparkSession, d: str) -> DataFrame:
    blocks = adapter(spark, d, "blocks")
    return blocks.select("gx", "gz", "y", V.palette_name(F.col("pal") - 1, PALETTE[:5]).alias("name"))


def block_index_unravel(spark: SparkSession, d: str) -> DataFrame:
    words = adapter(spark, d, "packed_words")
    index = F.pmod("k", F.lit(V.SECTION_CELLS)).cast("int")
    c = V.cell_of(index)
    section = F.pmod("k", F.lit(24)).cast("int") - 4
    return words.select("k", *[c[a].alias(a) for a in "xyz"], (section * 16 + c["y"]).alias("abs_y"))


def tile_min_fold(spark: SparkSession, d: str) -> DataFrame:
    return T.fold_tiles(adapter(spark, d, "tile_headers"), ["pos_x", "pos_z"], ["seq"])


def tile_assembly_l0(spark: SparkSession, d: str) -> DataFrame:
    slot = [F.col("chunk_z").bitwiseAND(31).alias("slot_z"), F.col("chunk_x").bitwiseAND(31).alias("slot_x")]
    tiles = T.tiles_of_chunks(_bounds(spark, d).select("*", *slot), ["slot_z", "slot_x"])
    runs = _runs(spark, d).select(
        C.floor_shift("gx", 6).alias("pos_x"), C.floor_shift("gz", 6).alias("pos_z"), T.cell().alias("cell"), "run_ord", "y_min", "y_max", "color", "flags"
    )
    return runs.join(tiles, ["pos_x", "pos_z"])


def argb_blend(spark: SparkSession, d: str) -> DataFrame:
    return V.solid_blocks(_blocks(spark, d)).groupBy("gx", "gz").agg(C.blend("color").alias("color"))


def first8_samples(spark: SparkSession, d: str) -> DataFrame:
    s = T.samples(_runs(spark, d)).withColumn("rep_flags", T.first_flags(F.col("points")))
    return s.select("px", "pz", "rep_flags", F.posexplode(F.slice("points", 1, T.SAMPLES)).alias("ord", "p")).select("px", "pz", "ord", "rep_flags", "p.color", "p.flags")


def lod_downsample_l1(spark: SparkSession, d: str) -> DataFrame:
    return T.downsample(_runs(spark, d)).drop("run_ord")


def lod_pyramid_l4(spark: SparkSession, d: str) -> DataFrame:
    return T.pyramid(_runs(spark, d), 4, keep=written).where("level > 0").drop("run_ord")


def lod_top_run(spark: SparkSession, d: str) -> DataFrame:
    return T.downsample_top(_runs(spark, d)).drop("run_ord")


def chunk_hash(spark: SparkSession, d: str) -> DataFrame:
    up = F.col("y") - LOW_SECTION * 16
    index = up * 256 + F.col("gz").bitwiseAND(15) * 16 + F.col("gx").bitwiseAND(15)
    cells = adapter(spark, d, "blocks").select(
        C.floor_shift("gx", 4).alias("chunk_x"), C.floor_shift("gz", 4).alias("chunk_z"), index.cast("long").alias("i"), F.col("pal").alias("code")
    )
    return V.chunk_hash(cells, SECTIONS * V.SECTION_CELLS, AIR_CODE)


def blob_checksum(spark: SparkSession, d: str) -> DataFrame:
    return checksums(adapter(spark, d, "byte_payloads").select("doc_id", F.unhex("hx").alias("data")), "doc_id", "data")


def varint_encode(spark: SparkSession, d: str) -> DataFrame:
    return adapter(spark, d, "byte_payloads").select("doc_id", C.varint_hex(F.col("n")).alias("varint"))


def run_record_hex(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("gx", "gz", "run_ord", C.run_hex(*map(F.col, ("y_min", "y_max", "color", "flags"))).alias("record"))


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return R.last_wins(adapter(spark, d, "hash_upserts"), ["chunk_x", "chunk_z"], "seq")


def tile_union_counts(spark: SparkSession, d: str) -> DataFrame:
    runs = T.pyramid(written(_runs(spark, d), "runs"), 2, keep=written)
    tile = F.struct(C.floor_shift("gx", 6), C.floor_shift("gz", 6))
    length = (F.col("y_max") - F.col("y_min") + 1).cast("long")
    return runs.groupBy("level").agg(F.count_distinct(tile).alias("tiles"), F.count("*").alias("runs"), F.sum(length).alias("height"))


def empty_tile_outer(spark: SparkSession, d: str) -> DataFrame:
    tiles = T.fold_tiles(adapter(spark, d, "tile_headers"), ["pos_x", "pos_z"], ["seq"]).withColumn("level", F.lit(0))
    runs = _runs(spark, d).withColumn("level", F.lit(0))
    nested = T.nested_tiles(tiles, runs)
    return nested.select("pos_x", "pos_z", "min_y", "max_y", F.coalesce(F.size("runs"), F.lit(0)).cast("int").alias("n_runs"))


def section_sort(spark: SparkSession, d: str) -> DataFrame:
    return V.sections(adapter(spark, d, "blocks"))


def header_location_decode(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("w").bitwiseAND(C.MASK)
    slot = F.pmod("k", F.lit(1024)).cast("int")
    offset, count = F.shiftright(raw, 8), raw.bitwiseAND(255)
    words = adapter(spark, d, "packed_words").where((offset != 0) & (count != 0))
    return words.select(
        "k", slot.bitwiseAND(31).alias("local_x"), F.shiftright(slot, 5).alias("local_z"), offset.alias("sector_offset"), count.cast("int").alias("sector_count"), (offset * 4096).alias("byte_offset")
    )


def biome_decode(spark: SparkSession, d: str) -> DataFrame:
    size = (F.col("k") % 7 + 1).cast("int")
    bits = C.bit_width(size, 1)
    chain = F
    for b in range(4):
        chain = chain.when(bits == b, C.unpack_aligned(F.array("w"), b, 64))
    weighted = F.aggregate(F.zip_with(chain, F.sequence(F.lit(1), F.lit(64)), lambda v, i: v * i), F.lit(0).cast("long"), lambda s, x: s + x)
    return adapter(spark, d, "packed_words").select("k", size.alias("size"), bits.alias("bits"), weighted.alias("weighted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        region_path_parse,
        region_bbox_prune,
        chunk_bbox_filter,
        unpack_aligned,
        unpack_spanning,
        palette_bit_width,
        legacy_id_decode,
        first_appearance_dict,
        air_filter,
        material_lookup,
        material_fallback,
        vertical_rle,
        chunk_bounds,
        palette_index_clamp,
        block_index_unravel,
        tile_min_fold,
        tile_assembly_l0,
        argb_blend,
        first8_samples,
        lod_downsample_l1,
        lod_pyramid_l4,
        lod_top_run,
        chunk_hash,
        blob_checksum,
        varint_encode,
        run_record_hex,
        upsert_last_wins,
        tile_union_counts,
        empty_tile_outer,
        section_sort,
        header_location_decode,
        biome_decode,
        scan_world,
        bake_world,
        bake_levels,
        document_tiles,
    )
}
