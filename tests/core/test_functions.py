import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratavox.functions import columns as C
from stratavox.functions import materials as M
from stratavox.sources.blobs import varints
from stratavox.sources.nbt import unpack
from stratavox.sources.regions import poly_hash
from stratavox.sources.writer import pack


def one(spark, *columns):
    return spark.range(1).select(*columns).collect()[0]


def longs(values):
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


WORD = 0x123456789ABCDEF0


def test_unpack_of_known_words(spark):
    expected = [0, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1]
    assert unpack(np.full(256, WORD), 4)[:16].tolist() == expected
    assert unpack(np.full(4, WORD), 4, 64)[:16].tolist() == expected
    assert one(spark, C.unpack(F.array_repeat(F.lit(WORD), 256), 4))[0][:16] == expected


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 15), st.booleans(), st.integers(0, 1 << 30))
def test_pack_and_unpack(bits, spanning, seed):
    values = np.random.default_rng(seed).integers(0, 1 << bits, 4096)
    packed = pack(values, bits, spanning)
    # The reader tells the layouts apart by the number of words, which here is ambiguous.
    if spanning and 64 % bits and len(packed) >= -(-4096 // (64 // bits)):
        return
    assert (unpack(packed, bits) == values).all()


def test_column_unpack_agrees_with_numpy(spark):
    rng = np.random.default_rng(0)
    for bits in (1, 4, 5, 7, 13):
        for n in (0, 1, 3, 9, 200):
            words = rng.integers(-(1 << 63), (1 << 63) - 1, n)
            got = one(spark, C.unpack(longs(words) if n else F.array().cast("array<bigint>"), bits, 300))[0]
            per = 64 // bits
            aligned = n >= -(-300 // per)
            u = [int(w) & (1 << 64) - 1 for w in words]
            whole = sum(w << 64 * k for k, w in enumerate(u))
            want = [(u[i // per] >> i % per * bits if i // per < n else 0) & (1 << bits) - 1 for i in range(300)] if aligned else [whole >> i * bits & (1 << bits) - 1 for i in range(300)]
            assert got == want


def test_blend_of_eight_colours(spark):
    colors = [0xFF102030 + 0x101010 * k for k in range(8)]
    assert one(spark, C.blend_array(longs(colors)))[0] == 0xFF485868
    assert one(spark, C.blend_array(longs([0x00FFFFFF])))[0] == 0
    assert spark.createDataFrame([(c,) for c in colors], "c long").select(C.blend("c")).first()[0] == 0xFF485868


@pytest.mark.parametrize(("n", "want"), [(0, 1), (16 * 4096, 2111832065), (24 * 4096, -1127219199)])
def test_hash_of_air(n, want):
    assert poly_hash(np.zeros(n, dtype=np.uint16)) == want


def test_hashes_agree(spark):
    values = np.random.default_rng(1).integers(-128, 128, 500)
    h = 1
    for v in values.tolist():
        h = (h * 31 + v) & 0xFFFFFFFF
    h -= (h >> 31) << 32
    assert poly_hash(values) == h == one(spark, C.poly_hash(longs(values)))[0]
    assert one(spark, C.signed_bytes(F.lit("00FF7F80")))[0] == [0, -1, 127, -128]
    assert one(spark, C.signed_bytes(F.lit("")))[0] == []


@given(st.integers(0, (1 << 35) - 1))
def test_varint_round_trip(value):
    raw = varints(np.array([value]))
    assert sum((b & 127) << 7 * k for k, b in enumerate(raw)) == value and all(b > 127 for b in raw[:-1]) and raw[-1] < 128


def test_varint_columns(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2097151, 2097152, (1 << 35) - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", C.varint_hex(F.col("v"))).collect()
    assert all(bytes.fromhex(h) == varints(np.array([v])) for v, h in rows)


def test_materials(spark):
    assert len(M.MATERIALS) == 183 == len({m[0] for m in M.MATERIALS})
    stone = M.material_of("minecraft:stone")
    assert stone.color == 0xFF7D7D7D and stone.opacity and M.material_of("minecraft:air").color == 0
    # A fallback is by substring, in order, and other namespaces have no table entries.
    assert not M.material_of("oak_stairs").solid and M.material_of("sandstone_stairs").color == 0xFFDBCFA3
    assert M.material_of("fire_coral").light == 15 and M.material_of("mod:stone").color == 0xFF7D7D7D and M.material_of("Stone").color == 0xFF7D7D7D
    names = [m[0] for m in M.MATERIALS] + ["minecraft:oak_log", "x:log", "leafy", "birch_leaves2", "void_thing", "watery", "soily", "wood_fire"]
    df = M.with_material(spark.createDataFrame([(n,) for n in names], "name string"))
    for r in df.collect():
        assert (r.color, r.flags, r.light, r.opacity) == tuple(vars(M.material_of(r.name)).values())


def test_legacy_names(spark):
    ids = [(i, m) for i in range(70) for m in range(16)] + [(300, 0), (4095, 15)]
    df = spark.createDataFrame(ids, "id int, meta int").select("id", "meta", M.legacy_name_of(F.col("id"), F.col("meta")).alias("n"))
    assert all(r.n == M.legacy_name(r.id, r.meta) for r in df.collect())
    assert M.legacy_name(17, 5) == "minecraft:spruce_log" and M.legacy_name(1, 9) == "minecraft:stone" and M.legacy_name(999, 0) == "minecraft:stone"


def test_region_names(spark):
    names = {"r.0.0.mca": (0, 0), "a/b/r.-3.17.mca": (-3, 17), "r.1.2.old.mca": (1, 2), "r.+1.2.mca": (1, 2), "c.0.0.mca": None, "r.0.mca": None, "r.0.0.mcc": None, "r.x.0.mca": None, "r.99999999999.0.mca": None, "r.0.0.mca.bak": None}
    from stratavox.sources.regions import coords_of

    df = spark.createDataFrame([(n,) for n in names], "p string").select("p", C.region_coord("p", 0).alias("x"), C.region_coord("p", 1).alias("z"))
    for r in df.collect():
        assert coords_of(r.p) == names[r.p] == ((r.x, r.z) if r.x is not None and r.z is not None else None)
