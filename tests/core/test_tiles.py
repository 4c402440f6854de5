import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratavox.operators import tiles as T
from stratavox.operators import voxels as V
from stratavox.operators.relations import last_wins


def fold(values):
    s = 0
    for m in values:
        if m < s or s == 0:
            s = m
    return s


def closed(values):
    if min(values) < 0:
        return min(values)
    if 0 in values:
        after = values[len(values) - values[::-1].index(0) :]
        return min(after, default=0)
    return min(values)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-3, 5), min_size=1, max_size=8))
def test_the_fold_has_a_closed_form(values):
    assert fold(values) == closed(values)


def test_fold_column(spark):
    rng = random.Random(1)
    cases = [[rng.randint(-2, 4) for _ in range(rng.randint(1, 7))] for _ in range(200)]
    rows = [(g, i, m, m + 1) for g, c in enumerate(cases) for i, m in enumerate(c)]
    for function in (T.fold_tiles, T.fold_few):
        got = function(spark.createDataFrame(rows, "g int, i int, min_y int, max_y int"), ["g"], ["i"]).collect()
        assert all(r.min_y == fold(cases[r.g]) and r.max_y == max(0, max(cases[r.g]) + 1) for r in got) and len(got) == 200


def merge(columns):
    """One cell by hand: columns in order, each a list of (y_min, y_max, color, flags)."""
    points = [p for c in columns for p in c]
    if not points:
        return None
    shown = [p[2] for p in points[:8] if p[2] >> 24 & 255]
    mean = lambda s: sum(c >> s & 255 for c in shown) // len(shown) << s if shown else 0
    return min(p[0] for p in points), max(p[1] for p in points), sum(map(mean, (24, 16, 8, 0))), next((p[3] for p in points if p[3]), 0)


def world(seed, n=40):
    rng = random.Random(seed)
    out = {}
    for _ in range(n * 6):
        x, z = rng.randint(-n // 2, n // 2), rng.randint(-n // 2, n // 2)
        y = 0
        runs = []
        for _ in range(rng.randint(1, 5)):
            y += rng.randint(1, 4)
            h = rng.randint(0, 3)
            runs.append((y, y + h, rng.choice([0xFF000000, 0x22000000, 0]) | rng.getrandbits(24), rng.choice([0, 1, 4, 9])))
            y += h + 1
        out[x, z] = runs
    return out


def levels_by_hand(columns, levels, top):
    for _ in range(levels):
        cells = {}
        for (x, z), runs in columns.items():
            cells.setdefault((x >> 1, z >> 1), {})[x & 1, z & 1] = runs[-1:] if top else runs
        merged = {k: merge([c.get(p, []) for p in ((0, 0), (0, 1), (1, 0), (1, 1))]) for k, c in cells.items()}
        columns = {k: [m] for k, m in merged.items() if m and not (top and m[2] == 0)}
    return columns


def test_pyramid_against_cell_by_cell(spark):
    for top in (False, True):
        columns = world(5)
        rows = [(x, z, k, *r) for (x, z), runs in columns.items() for k, r in enumerate(runs)]
        runs = spark.createDataFrame(rows, "gx int, gz int, run_ord int, y_min int, y_max int, color long, flags int")
        got = {}
        for r in T.pyramid(runs, 5, top).collect():
            got.setdefault((r.level, r.gx, r.gz), []).append((r.run_ord, r.y_min, r.y_max, r.color, r.flags))
        for level in range(6):
            want = {k: v for k, v in levels_by_hand(columns, level, top).items()}
            have = {k[1:]: [p[1:] for p in sorted(v)] for k, v in got.items() if k[0] == level}
            assert have == want


def test_lower_levels_share_a_partitioning(spark):
    runs = spark.createDataFrame([(1, 2, 0, 3, 4, 5, 6)], "gx int, gz int, run_ord int, y_min int, y_max int, color long, flags int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # The union repeats the chain below each level, so the deepest one is looked at alone.
        plan = T.pyramid(runs, 3).where("level = 3")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1


def test_runs_and_chunk_hash(spark):
    rng = random.Random(2)
    cells = {(rng.randint(-3, 3), rng.randint(-3, 3), rng.randint(-20, 20)): rng.choice([(7, 1), (7, 4), (9, 1)]) for _ in range(900)}
    df = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "gx int, gz int, y int, color long, flags int")
    want = set()
    for (x, z, y), m in cells.items():
        if cells.get((x, z, y - 1)) != m:
            top = y
            while cells.get((x, z, top + 1)) == m:
                top += 1
            want.add((x, z, y, top, *m))
    got = V.vertical_runs(df).collect()
    assert {(r.gx, r.gz, r.y_min, r.y_max, r.color, r.flags) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault((r.gx, r.gz), []).append((r.run_ord, r.y_min))
    assert all([o for o, _ in sorted(v)] == list(range(len(v))) and sorted(v) == sorted(v, key=lambda p: p[1]) for v in by.values())
    codes = [rng.randrange(5) for _ in range(100)]
    h = 1
    for c in codes:
        h = (h * 31 + c) & 0xFFFFFFFF
    df = spark.createDataFrame([(0, 0, i, c) for i, c in enumerate(codes) if c != 2], "chunk_x int, chunk_z int, i long, code int")
    assert V.chunk_hash(df, 100, 2).first().hash == h - ((h >> 31) << 32)


def test_empty_tiles_stay(spark):
    tiles = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 5, 5, 0, 0)], "level int, pos_x int, pos_z int, min_y int, max_y int")
    runs = spark.createDataFrame([(0, 1, 2, 0, 1, 2, 3, 4)], "level int, gx int, gz int, run_ord int, y_min int, y_max int, color long, flags int")
    got = {(r.pos_x, r.pos_z): r.runs for r in T.nested_tiles(tiles, runs).collect()}
    assert got[5, 5] is None and [tuple(r) for r in got[0, 0]] == [(66, 0, 1, 2, 3, 4)]


def test_last_wins(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"), (F.col("id") * 3).alias("v"))
    got = {r.k: (r.seq, r.v) for r in last_wins(df, ["k"], "seq").collect()}
    assert len(got) == 7 and all(got[k][0] == max(range(k, 1000, 7)) and got[k][1] == 3 * got[k][0] for k in range(7))
