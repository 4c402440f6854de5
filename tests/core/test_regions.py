import io
import sqlite3
import struct
import zipfile
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from stratavox.plans.job import BakeOptions, bake, parse, run
from stratavox.sources import writer as w
from stratavox.sources.blobs import checksum, raw_blob, read_blob
from stratavox.sources.datasource import register
from stratavox.sources.nbt import NbtError, Section, parse_chunk
from stratavox.sources.regions import Box, Chunk, RegionError, by_document, chunk_hash, decompress, discover, locations, payload, poly_hash, runs_of, scan, voxelise
from stratavox.sources.sqlite import SCRIPTS, upsert
from stratavox.sources.tables import shared_dir

RNG = np.random.default_rng(0)
STONE, AIR = "minecraft:stone", "minecraft:air"


def test_header_and_payload():
    content = bytearray(12288)
    content[0:4] = bytes([0, 0, 2, 1])
    content[8192:8207] = struct.pack(">IB", 11, 3) + b"0123456789"
    (place,) = locations(bytes(content))
    assert place.sector_offset * 4096 == 8192 and place.slot == 0
    data, codec = payload(bytes(content), place)
    assert codec == 3 and data == b"0123456789" == decompress(data, codec)


def test_broken_containers():
    with pytest.raises(RegionError):
        locations(b"x" * 8191)
    good = w.region({(0, 0): (b"abc", 3)})
    (place,) = locations(good)
    for bad in (good[:8192], good[:8192] + struct.pack(">IB", 0, 3), good[:8192] + struct.pack(">IB", 99, 3) + b"x"):
        with pytest.raises(RegionError):
            payload(bad, place)
    assert locations(bytes(8192)) == []


def test_codecs():
    text = b"some text " * 50
    for codec in (1, 2, 3, 4):
        assert decompress(w.compress(text, codec), codec) == text
    for data, codec in ((text, 5), (text, 0), (b"junk", 2), (b"junk", 1), (b"x", 4), (zlib.compress(text)[:-5], 2)):
        with pytest.raises(RegionError):
            decompress(data, codec)


@pytest.mark.parametrize("size", [1, 2, 16, 17, 33])
def test_section_layouts(size):
    names = [f"minecraft:block_{k}" for k in range(size)]
    indices = RNG.integers(0, size, 4096)
    for section, make in ((w.modern_section(-4, names, indices), w.modern_chunk), (w.middle_section(-4, names, indices, False), w.old_chunk), (w.middle_section(-4, names, indices, True), w.old_chunk)):
        chunk = parse_chunk(make(3, -5, [section]), 0, 0)
        assert (chunk.x, chunk.z) == (3, -5)
        (s,) = chunk.sections
        assert s.y == -4 and s.palette == names and (s.indices == (indices if size > 1 else 0)).all() and not s.empty


def test_numeric_sections():
    ids, data = RNG.integers(0, 60, 4096), RNG.integers(0, 16, 4096)
    s = parse_chunk(w.old_chunk(0, 0, [w.numeric_section(1, ids, data)])).sections[0]
    from stratavox.functions.materials import legacy_name

    names = [legacy_name(int(i), int(m)) for i, m in zip(ids, data)]
    assert [s.palette[k] for k in s.indices] == names and s.palette == list(dict.fromkeys(names))
    high = parse_chunk(w.old_chunk(0, 0, [w.numeric_section(1, np.full(4096, 4), None, np.ones(4096, int))])).sections[0]
    assert high.palette == [STONE]
    assert parse_chunk(w.old_chunk(0, 0, [w.numeric_section(1, np.zeros(4096, int))])).sections[0].empty


def test_empty_sections_and_biomes():
    bare = w.compound(w.tag(1, "Y", w.number(1, 2)))
    chunk = parse_chunk(w.modern_chunk(None, None, [bare, w.modern_section(0, [AIR]), w.modern_section(1, []), w.modern_section(2, ["minecraft:barrier"])]), 7, 8)
    assert [s.empty for s in chunk.sections] == [True, True, True, False] and (chunk.x, chunk.z) == (7, 8)
    biomes = RNG.integers(0, 3, 64)
    s = parse_chunk(w.modern_chunk(0, 0, [w.modern_section(0, [STONE], biomes=["a", "b", "c"], biome_indices=biomes)])).sections[0]
    assert s.biomes == ["a", "b", "c"] and (s.biome_indices == biomes).all()
    assert parse_chunk(w.modern_chunk(0, 0, [w.modern_section(0, [STONE], biomes=[])])).sections[0].biomes == ["minecraft:plains"]
    assert parse_chunk(w.modern_chunk(1, 2, [])).sections == []


def test_documents_that_lack_something():
    no_y = w.compound(w.tag(10, "block_states", w.compound(w.tag(9, "palette", w.compounds([])))))
    no_name = w.compound(w.tag(1, "Y", b"\0"), w.tag(10, "block_states", w.compound(w.tag(9, "palette", w.compounds([w.compound()])))))
    no_palette = w.compound(w.tag(1, "Y", b"\0"), w.tag(10, "block_states", w.compound()))
    mistyped = w.compound(w.tag(1, "Y", b"\0"), w.tag(8, "block_states", b"\0\0"))
    for section in (no_y, no_name, no_palette, mistyped):
        with pytest.raises(NbtError):
            parse_chunk(w.modern_chunk(0, 0, [section]))
    whole = w.modern_chunk(0, 0, [w.modern_section(0, [STONE])])
    for bad in (b"", b"\x01", whole[:-3], whole[:20], b"\x0a\0\0\x63\0\0"):
        with pytest.raises(NbtError):
            parse_chunk(bad)


def by_hand(chunk):
    """Runs of each column, cell by cell."""
    from stratavox.functions.materials import material_of

    columns = [[] for _ in range(256)]
    for s in sorted((s for s in chunk.sections if not s.empty), key=lambda s: s.y):
        mats = [material_of(n) for n in s.palette]
        for c in range(256):
            for y in range(16):
                k = int(s.indices[y * 256 + c])
                m = mats[k] if k < len(mats) else mats[0]
                if not m.solid:
                    continue
                at, last = s.y * 16 + y, columns[c][-1] if columns[c] else None
                if last and last[2:] == (m.color, m.flags) and last[1] + 1 == at:
                    columns[c][-1] = (last[0], at, *last[2:])
                else:
                    columns[c].append((at, at, m.color, m.flags))
    return columns


PALETTE = [AIR, STONE, "minecraft:granite", "minecraft:polished_granite", "minecraft:water", "oak_stairs"]


def random_chunk(rng, duplicate=False):
    ys = [-4, -3, 0, 1, 5] + ([1] if duplicate else [])
    out = []
    for y in ys:
        tall = rng.integers(0, len(PALETTE) + 2, (16 // 4, 256)).repeat(4, axis=0).ravel()
        out.append(Section(y, False, PALETTE, tall.astype(np.uint16)))
    return Chunk(0, 0, [out[k] for k in rng.permutation(len(out))] + [Section(9, True), Section(7, False, [STONE])])


@pytest.mark.parametrize("seed", range(6))
def test_voxels_against_cell_by_cell(seed):
    chunk = random_chunk(np.random.default_rng(seed), duplicate=seed % 2 == 1)
    v = voxelise(chunk)
    want = by_hand(chunk)
    got = [[] for _ in range(256)]
    for c, *run in zip(*(getattr(v, f).tolist() for f in ("cell", "y_min", "y_max", "color", "flags"))):
        got[c].append(tuple(run))
    assert got == want
    assert v.min_y == min(r[0] for c in want for r in c) and v.max_y == max(r[1] for c in want for r in c)


def test_bounds():
    at = lambda y, name=STONE: voxelise(Chunk(0, 0, [Section(y, False, [name])]))
    assert (at(20).min_y, at(20).max_y) == (320, 335) and (at(-8).min_y, at(-8).max_y) == (-128, -64)
    assert (at(0, "minecraft:barrier").min_y, at(0, "minecraft:barrier").max_y) == (0, 0) and len(at(0, "minecraft:barrier").cell) == 0
    assert chunk_hash([]) == 1 and chunk_hash([Section(0, True)] * 16) == 2111832065


def test_blob_checksums():
    none = np.zeros(0, dtype=np.int64)
    assert checksum(raw_blob(none, none, none, none, none)) == 1742602241
    one = raw_blob(*(np.array([v]) for v in (0, 0, 15, 0xFF7D7D7D, 1)))
    assert len(one) == 4106 and checksum(one) == -464329298
    cell = np.sort(RNG.integers(0, 4096, 9000))
    cell[:200] = 0
    cell.sort()
    y = RNG.integers(-64, 320, 9000)
    columns = read_blob(zstandard.compress(raw_blob(cell, y, y + 3, RNG.integers(0, 1 << 32, 9000), RNG.integers(0, 64, 9000))))
    assert [len(c) for c in columns] == np.bincount(cell, minlength=4096).tolist() and np.concatenate(columns)["y_min"].tolist() == y.tolist()


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    """A folder of regions: good and broken chunks, negative places, foreign files."""
    top = tmp_path_factory.mktemp("world")
    (top / "region").mkdir()
    rng = np.random.default_rng(3)
    names = [AIR, STONE, "minecraft:water", "minecraft:oak_leaves"]

    def chunk(x, z):
        return w.modern_chunk(x, z, [w.modern_section(y, names, rng.integers(0, 4, 4096)) for y in (-1, 0, 2)])

    places = {(0, 0): [(0, 0), (1, 0), (5, 9), (31, 31)], (-1, 0): [(31, 0), (0, 31)], (-1, -1): [(31, 31)], (9, 9): [(0, 0)]}
    for (rx, rz), cells in places.items():
        chunks = {c: (chunk(rx * 32 + c[0], rz * 32 + c[1]), 1 + k % 4) for k, c in enumerate(cells)}
        if (rx, rz) == (0, 0):
            chunks[2, 2] = (b"junk", 2)
            chunks[3, 3] = (w.modern_chunk(0, 0, [w.modern_section(0, [AIR])]), 2)
        (top / "region" / f"r.{rx}.{rz}.mca").write_bytes(w.region(chunks, 1234))
    (top / "region" / "r.0.1.mca").write_bytes(b"short")
    (top / "region" / "c.0.0.mca").write_bytes(b"other")
    (top / "region" / "r.0.0.mcc").write_bytes(b"other")
    with zipfile.ZipFile(top / "world.zip", "w") as z:
        for f in (top / "region").iterdir():
            z.write(f, f"save/region/{f.name}")
        z.writestr("save/poi/r.0.0.mca", b"not terrain")
    return top


def test_scan_and_box(spark, world):
    box = Box.around(0, 0, 40)
    rows = scan(discover(spark, str(world / "region"), box), box).collect()
    found = {(r.chunk_x, r.chunk_z): r for r in rows if r.error is None}
    assert set(found) == {(0, 0), (1, 0), (5, 9), (31, 31), (3, 3), (-1, 0), (-32, 31), (-1, -1)}
    assert all(r.timestamp == 1234 for r in found.values()) and found[3, 3].runs == [] and (found[3, 3].min_y, found[3, 3].max_y) == (0, 0)
    assert sorted(r.error is not None for r in rows).count(True) == 2
    near = Box.around(0, 0, 1)
    assert {(r.chunk_x, r.chunk_z) for r in scan(discover(spark, str(world / "region"), near), near).where("error IS NULL").collect()} == {(0, 0), (1, 0), (-1, 0), (-1, -1)}
    assert not any("r.9.9" in r.path for r in discover(spark, str(world / "region"), box).collect())
    zipped = scan(discover(spark, str(world / "world.zip"), box), box).where("error IS NULL")
    assert {(r.chunk_x, r.chunk_z): r.hash for r in zipped.collect()} == {k: r.hash for k, r in found.items()}
    with pytest.raises(Exception):
        discover(spark, str(world / "nowhere"))


def test_data_source(spark, world):
    register(spark)
    read = lambda p, **o: spark.read.format("voxel_regions").option("path", str(world / p)).options(**o).load()
    assert {(r.rx, r.rz) for r in read("region").select("rx", "rz").collect()} == {(0, 0), (-1, 0), (-1, -1), (9, 9), (0, 1)}
    assert {(r.rx, r.rz) for r in read("region").where("rx < 0 AND rz = 0").collect()} == {(-1, 0)}
    assert {(r.rx, r.rz) for r in read("world.zip", radius="4").select("rx", "rz").collect()} == {(0, 0), (-1, 0), (-1, -1)}
    chunks = scan(read("region", radius="40"), Box.around(0, 0, 40)).where("error IS NULL")
    assert chunks.count() == 8 and runs_of(chunks).count() > 0


def test_bake_to_sqlite_and_again(spark, world, tmp_path):
    out = tmp_path / "deep" / "tiles.sqlite"
    options = BakeOptions(str(world / "region"), str(out), radius=40, detail_levels=5, quiet=True)
    stats = run(spark, options)
    assert stats["chunks"] == 8 and stats["skipped"] == 2
    db = sqlite3.connect(out)
    rows = db.execute("SELECT DetailLevel, PosX, PosZ, MinY, DataChecksum, Data, DataFormatVersion, CompressionMode, ApplyToParent, ApplyToChildren, Mapping, NorthAdjData FROM FullData").fetchall()
    assert len(rows) == stats["tiles"] == db.execute("SELECT count(*) FROM (SELECT DISTINCT DetailLevel, PosX, PosZ FROM FullData)").fetchone()[0]
    for r in rows:
        assert checksum(zstandard.decompress(r[5])) == r[4] and r[6:] == (2, 4, 0, 0, None, None)
    assert {r[0] for r in rows} == set(range(6)) and {r[1:3] for r in rows if r[0] == 0} == {(0, 0), (1, 2), (7, 7), (-1, 0), (-8, 7), (-1, -1)}
    made = bake(spark, options)
    runs = {}
    for r in made.runs.collect():
        runs.setdefault((r.level, r.gx >> 6, r.gz >> 6), []).append(((r.gx & 63) * 64 + (r.gz & 63), r.run_ord, r.y_min, r.y_max, r.color, r.flags))
    for level, x, z, *_rest in rows:
        columns = read_blob(_rest[2])
        want = sorted(runs.get((level, x, z), []))
        assert [(k, int(p["y_min"]), int(p["y_max"]), int(p["color"]), int(p["flags"])) for k, c in enumerate(columns) for p in c] == [(k, *v) for k, _, *v in want]
    assert db.execute("SELECT count(*) FROM ChunkHash").fetchone()[0] == 8 and db.execute("SELECT ScriptName FROM Schema ORDER BY 1").fetchall() == [(s,) for s in SCRIPTS]
    db.close()
    assert run(spark, options)["tiles"] == len(rows)
    db = sqlite3.connect(out)
    assert db.execute("SELECT count(*) FROM FullData").fetchone()[0] == len(rows)
    db.close()
    missing = BakeOptions(str(world / "region"), str(tmp_path / "none.sqlite"), cx=10**6, radius=1, quiet=True)
    assert run(spark, missing) == {"regions": 0} and not (tmp_path / "none.sqlite").exists()


def test_upsert_keeps_the_old_file_on_failure(tmp_path):
    path = tmp_path / "x.sqlite"
    assert upsert(path, [(0, 1, 2, 3, 4, b"a"), (0, 1, 2, 3, 5, b"b")], [(0, 0, 12345), (0, 0, 6)], 77) == (2, 2)

    def broken():
        yield (0, 1, 2, 3, 9, b"c")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        upsert(path, broken(), [], 78)
    db = sqlite3.connect(path)
    assert db.execute("SELECT DataChecksum, Data, CreatedUnixDateTime FROM FullData").fetchall() == [(5, b"b", 77)]
    assert db.execute("SELECT ChunkHash FROM ChunkHash").fetchall() == [(6,)]
    assert list(tmp_path.iterdir()) == [path]


def test_options():
    o = parse(["--map", "m", "-j", "4", "--detail-levels", "10", "--zstd-level", "22", "--quiet"])
    assert o == BakeOptions("m", threads=4, detail_levels=10, zstd_level=22, quiet=True) and parse(["--map", "m", "-t", "2"]).threads == 2
    for bad in ({"detail_levels": 11}, {"zstd_level": 0}, {"zstd_level": 23}):
        with pytest.raises(ValueError):
            BakeOptions("m", **bad)
    assert BakeOptions("m").box == Box(-64, 64, -64, 64)


def test_stream(spark, world, tmp_path):
    from stratavox.streaming.incremental import watch

    out = tmp_path / "s.sqlite"
    options = BakeOptions(str(world / "region"), str(out), radius=40, detail_levels=3)
    watch(spark, options, str(tmp_path / "checkpoint")).awaitTermination()
    batch = tmp_path / "b.sqlite"
    run(spark, BakeOptions(str(world / "region"), str(batch), radius=40, detail_levels=3, quiet=True))
    query = "SELECT DetailLevel, PosX, PosZ, MinY, DataChecksum FROM FullData ORDER BY 1, 2, 3"
    a, b = (sqlite3.connect(p).execute(query).fetchall() for p in (out, batch))
    assert a == b and a
    with pytest.raises(ValueError):
        watch(spark, BakeOptions("m", detail_levels=4), "c")


def test_writer_is_its_own_zip_reader(world):
    with zipfile.ZipFile(io.BytesIO((world / "world.zip").read_bytes())) as z:
        assert "save/region/r.0.0.mca" in z.namelist()


@pytest.mark.parametrize(("levels", "top"), [(0, False), (2, True), (3, False), (6, False), (6, True)])
def test_bulk_levels_are_those_of_the_dataframe_pyramid(spark, world, levels, top):
    from stratavox.operators.tiles import nested_tiles
    from stratavox.plans.job import assemble, encoded_tiles
    from stratavox.sources.blobs import encode

    box = Box.around(0, 0, 400)
    chunks = scan(discover(spark, str(world / "region"), box), box).cache()
    # A second file for one place, and a chunk of air on its own.
    chunks = chunks.union(chunks.where("chunk_x = 0 AND chunk_z = 0").selectExpr("'z' AS path", *[c for c in chunks.columns if c != "path"]).withColumn("runs", F.slice("runs", 1, 300)))
    made = assemble(chunks, levels, top, keep=None)
    columns = ["level", "pos_x", "pos_z", "min_y", "checksum", "raw_bytes"]
    want = sorted(tuple(r) for r in encode(nested_tiles(made.tiles, made.runs)).select(*columns).collect())
    assert sorted(tuple(r) for r in encoded_tiles(chunks, levels, top).select(*columns).collect()) == want


def test_names_are_listed_by_the_box(spark, tmp_path):
    names = ["r.0.0.mca", "r.-1.0.mca", "r.+1.01.mca", "r.-01.-1.extra.mca", "r.9.0.mca", "r.0.-9.mca", "r.00.1.mca"]
    for n in names:
        (tmp_path / n).write_bytes(n.encode())
    found = lambda box: sorted(bytes(r.content).decode() for r in discover(spark, str(tmp_path), box).collect())
    assert found(Box(-32, 63, -32, 63)) == sorted(n for n in names if "9" not in n)
    assert found(Box()) == sorted(names)
    assert found(Box(0, 31, 0, 31)) == ["r.0.0.mca"] and found(Box(5000, 5001, 0, 0)) == []


def test_an_archive_is_a_folder(spark, world):
    box = Box.around(0, 0, 40)
    columns = ["chunk_x", "chunk_z", "min_y", "max_y", "hash", "error"]
    rows = lambda path: sorted(map(str, scan(discover(spark, str(path), box), box).select(*columns).collect()))
    assert rows(world / "world.zip") == rows(world / "region")


def test_places_by_document(spark):
    names, cells = ["minecraft:air", "minecraft:stone"], np.zeros(4096, int)
    cells[:256] = 1
    document = lambda x, z: w.modern_chunk(x, z, [w.modern_section(0, names, cells)])
    files = [("r.0.0.mca", w.region({(0, 0): (document(40, -3), 2), (1, 0): (document(7, 7), 2)})), ("r.1.0.mca", w.region({(0, 0): (document(7, 7), 1)}))]
    chunks = scan(spark.createDataFrame(files, "path string, content binary"))
    placed = by_document(chunks)
    assert {(r.chunk_x, r.chunk_z, r.path) for r in placed.collect()} == {(40, -3, "r.0.0.mca"), (7, 7, "r.1.0.mca")}
    assert {(r.gx >> 4, r.gz >> 4) for r in runs_of(placed).select("gx", "gz").distinct().collect()} == {(40, -3), (7, 7)}


def test_a_hash_does_not_depend_on_pieces():
    values = np.random.default_rng(0).integers(-128, 128, 1000).astype(np.int8)
    assert len({poly_hash(values, piece) for piece in (1, 7, 999, 1000, 1 << 20)}) == 1


def test_a_folder_that_executors_do_not_see_is_refused():
    conf = SimpleNamespace(get=lambda *_: None)
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
