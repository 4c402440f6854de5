"""The queries of the catalog in DuckDB SQL, stated apart from the operators."""

from __future__ import annotations

from stratavox.functions.materials import EMPTY_NAMES, FALLBACKS, LEGACY_DEFAULT, LEGACY_IDS, MATERIALS, PREFIX
from stratavox.plans.adapters import ADAPTERS, AIR_CODE, PALETTE

_BARE = f"CASE WHEN starts_with(name, '{PREFIX}') THEN substring(name, {len(PREFIX) + 1}) ELSE name END"


def _values(rows: list[tuple], columns: str) -> str:
    quoted = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else "NULL" if v is None else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) AS v({columns})"


def _fallback(field: str) -> str:
    at = ("color", "flags", "light", "opacity").index(field) + 1
    whens = " ".join("WHEN " + " OR ".join(f"contains(bare, '{w}')" for w in words) + f" THEN {row[at - 1]}" for words, *row in FALLBACKS if words)
    return f"CASE {whens} ELSE {FALLBACKS[-1][at]} END"


_MAT = f"mat AS ({_values(MATERIALS, 'bare, color, flags, light, opacity')})"


def _with_material(source: str, columns: str) -> str:
    fields = ", ".join(f"CAST(coalesce(m.{f}, {_fallback(f).replace('bare', 's.bare')}) AS {'BIGINT' if f == 'color' else 'INTEGER'}) AS {f}" for f in ("color", "flags", "light", "opacity"))
    return f"SELECT {columns}, {fields} FROM (SELECT *, {_BARE} AS bare FROM {source}) s LEFT JOIN mat m ON s.bare = m.bare"


_B = f"b AS ({ADAPTERS['blocks']}), pal AS ({_values(list(enumerate(PALETTE)), 'pal, name')}), named AS (SELECT gx, gz, y, name FROM b JOIN pal USING (pal))"
_BLOCKS = f"{_B}, {_MAT}, blocks AS ({_with_material('named', 'gx, gz, y')})"
_SOLID = f"{_BLOCKS}, solid AS (SELECT gx, gz, y, color, flags FROM blocks WHERE (flags & 32) = 0 AND color <> 0)"
_RUNS = f"""{_SOLID},
islands AS (SELECT *, y - row_number() OVER (PARTITION BY gx, gz, color, flags ORDER BY y) AS island FROM solid),
spans AS (SELECT gx, gz, color, flags, CAST(min(y) AS INTEGER) AS y_min, CAST(max(y) AS INTEGER) AS y_max FROM islands GROUP BY gx, gz, color, flags, island),
runs AS MATERIALIZED (SELECT gx, gz, CAST(row_number() OVER (PARTITION BY gx, gz ORDER BY y_min) - 1 AS INTEGER) AS run_ord, y_min, y_max, color, flags FROM spans)"""
_BOUNDS = f"""{_BLOCKS},
bounds AS (SELECT CAST(gx >> 4 AS INTEGER) AS chunk_x, CAST(gz >> 4 AS INTEGER) AS chunk_z,
  CAST(coalesce(least(min(CASE WHEN (flags & 32) = 0 AND color <> 0 THEN y END), 320 + 0 * max(CASE WHEN (flags & 32) = 0 AND color <> 0 THEN y END)), 0) AS INTEGER) AS min_y,
  CAST(coalesce(greatest(max(CASE WHEN (flags & 32) = 0 AND color <> 0 THEN y END), -64 + 0 * max(CASE WHEN (flags & 32) = 0 AND color <> 0 THEN y END)), 0) AS INTEGER) AS max_y
  FROM blocks GROUP BY 1, 2)"""


def _fold(rows: str, keys: str, order: str) -> str:
    """Closed form: below 0 the least; else the least after the last 0; else the least."""
    return f"""(SELECT {keys}, CAST(CASE WHEN min(min_y) < 0 THEN min(min_y) WHEN count(last0) = 0 THEN min(min_y)
  ELSE coalesce(min(CASE WHEN o > last0 THEN min_y END), 0) END AS INTEGER) AS min_y, CAST(greatest(max(max_y), 0) AS INTEGER) AS max_y
  FROM (SELECT *, max(CASE WHEN min_y = 0 THEN o END) OVER (PARTITION BY {keys}) AS last0 FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS o FROM {rows}))
  GROUP BY {keys})"""


def _mean(limit: str = "") -> str:
    shown = f"((color >> 24) & 255) > 0{limit}"
    n = f"greatest(count(CASE WHEN {shown} THEN 1 END), 1)"
    parts = [f"((CAST(sum(CASE WHEN {shown} THEN (color >> {s}) & 255 ELSE 0 END) AS BIGINT) // {n}) << {s})" for s in (24, 16, 8, 0)]
    return f"CAST({' + '.join(parts)} AS BIGINT)"


def _level(below: str) -> str:
    """One level of the pyramid from a relation of runs."""
    return f"""(SELECT CAST(gx >> 1 AS INTEGER) AS gx, CAST(gz >> 1 AS INTEGER) AS gz, 0 AS run_ord, CAST(min(y_min) AS INTEGER) AS y_min, CAST(max(y_max) AS INTEGER) AS y_max,
  {_mean(' AND o <= 8')} AS color, CAST(coalesce(arg_min(CASE WHEN flags <> 0 THEN flags END, o), 0) AS INTEGER) AS flags
  FROM (SELECT *, row_number() OVER (PARTITION BY gx >> 1, gz >> 1 ORDER BY gx & 1, gz & 1, run_ord) AS o FROM {below}) GROUP BY gx >> 1, gz >> 1)"""


_COLS = "gx, gz, y_min, y_max, color, flags"
_SIGNED = "CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER)"
_W = f"w AS ({ADAPTERS['packed_words']})"
_N = f"n AS ({ADAPTERS['block_names']})"
_T = f"t AS ({ADAPTERS['byte_payloads']})"
_P = f"""p AS ({ADAPTERS['region_paths']}),
c AS (SELECT seq, regexp_extract(path, '^(?:.*/)?r\\.([+-]?[0-9]+)\\.([+-]?[0-9]+)(\\..*)?\\.mca$', 1) AS x, regexp_extract(path, '^(?:.*/)?r\\.([+-]?[0-9]+)\\.([+-]?[0-9]+)(\\..*)?\\.mca$', 2) AS z FROM p),
coords AS (SELECT seq, TRY_CAST(nullif(x, '') AS INTEGER) AS rx, TRY_CAST(nullif(z, '') AS INTEGER) AS rz FROM c)"""
_LEGACY = _values(
    [(k, mask, m, PREFIX + n) for k, (mask, named, default) in LEGACY_IDS.items() for m, n in [*named.items(), (None, default)]], "id, mask, m, name"
)
_HEX = {n: f"lpad(hex(CAST({{}} AS BIGINT) & {(1 << 4 * n) - 1}), {n}, '0')" for n in (2, 4, 8)}


def _varint() -> str:
    forms = []
    for k in range(5):
        parts = [_HEX[2].format(f"(((n >> {7 * j}) & 127) + {128 if j < k else 0})") for j in range(k + 1)]
        forms.append(f"WHEN n < {1 << 7 * (k + 1)} THEN {' || '.join(parts)}")
    return f"CASE {' '.join(forms)} END"


_HASHES = f"""cells AS (SELECT CAST(gx >> 4 AS INTEGER) AS chunk_x, CAST(gz >> 4 AS INTEGER) AS chunk_z, (y + 16) * 256 + (gz & 15) * 16 + (gx & 15) AS i, pal FROM b),
chunks AS (SELECT DISTINCT chunk_x, chunk_z FROM cells),
dense AS (SELECT c.chunk_x, c.chunk_z, list(CAST(coalesce(pal, {AIR_CODE}) AS BIGINT) ORDER BY r.i) AS codes FROM chunks c CROSS JOIN range(12288) r(i)
LEFT JOIN cells x ON x.chunk_x = c.chunk_x AND x.chunk_z = c.chunk_z AND x.i = r.i GROUP BY c.chunk_x, c.chunk_z),
hashes AS (SELECT chunk_x, chunk_z, {_SIGNED} AS hash FROM (SELECT chunk_x, chunk_z, list_reduce(list_prepend(1::BIGINT, codes), lambda a, x: (a * 31 + x) & 4294967295) AS h FROM dense))"""
_LEVELS = f"""l1 AS MATERIALIZED {_level('runs')}, l2 AS MATERIALIZED {_level('l1')}, l3 AS MATERIALIZED {_level('l2')}, l4 AS MATERIALIZED {_level('l3')},
leveled AS (SELECT 0 AS level, run_ord, {_COLS} FROM runs {' '.join(f'UNION ALL SELECT {k}, 0, {_COLS} FROM l{k}' for k in range(1, 5))})"""
_TILES = f"""placed AS (SELECT CAST(chunk_x >> 2 AS INTEGER) AS pos_x, CAST(chunk_z >> 2 AS INTEGER) AS pos_z, chunk_z & 31 AS sz, chunk_x & 31 AS sx, min_y, max_y FROM bounds),
t0 AS {_fold('placed', 'pos_x, pos_z', 'sz, sx')}, """ + ", ".join(
    f"u{k} AS (SELECT CAST(pos_x >> 1 AS INTEGER) AS px, CAST(pos_z >> 1 AS INTEGER) AS pz, pos_x AS cx, pos_z AS cz, min_y, max_y FROM t{k - 1}), "
    f"t{k} AS (SELECT px AS pos_x, pz AS pos_z, min_y, max_y FROM {_fold(f'u{k}', 'px, pz', 'cx, cz')})"
    for k in range(1, 5)
)

ORACLES: dict[str, str] = {
    "region_path_parse": f"WITH {_P} SELECT seq, rx, rz FROM coords",
    # Blocks (8, -40): chunks 0 and -3, radius 40, hence regions -2..1 and -2..1.
    "region_bbox_prune": f"WITH {_P} SELECT seq, rx, rz FROM coords WHERE rx BETWEEN (0 - 40) >> 5 AND (0 + 40) >> 5 AND rz BETWEEN (-3 - 40) >> 5 AND (-3 + 40) >> 5",
    "chunk_bbox_filter": f"""WITH {_B} SELECT DISTINCT chunk_x, chunk_z, chunk_x & 31 AS local_x, chunk_z & 31 AS local_z, CAST(chunk_x >> 2 AS INTEGER) AS pos_x, CAST(chunk_z >> 2 AS INTEGER) AS pos_z
FROM (SELECT CAST(gx >> 2 AS INTEGER) AS chunk_x, CAST(gz >> 2 AS INTEGER) AS chunk_z FROM named) WHERE chunk_x BETWEEN -2 AND 2 AND chunk_z BETWEEN -2 AND 2""",
    "unpack_aligned": f"WITH {_W} SELECT k, CAST(i AS INTEGER) AS i, (w >> CAST(i * 5 AS BIGINT)) & 31 AS v FROM w, range(12) r(i)",
    "unpack_spanning": f"""WITH {_W}, e AS (SELECT k, CAST(i AS INTEGER) AS i, CASE WHEN i * 5 < 64 THEN w ELSE -1 - w END AS a, -1 - w AS b, CAST((i * 5) % 64 AS BIGINT) AS off FROM w, range(25) r(i))
SELECT k, i, CASE WHEN off + 5 <= 64 THEN (a >> off) & 31 ELSE ((a >> off) & ((1::BIGINT << (64 - off)) - 1)) | ((b & ((1::BIGINT << (off - 59)) - 1)) << (64 - off)) END AS v FROM e""",
    "palette_bit_width": f"""WITH {_N}, s AS (SELECT grp, CAST(count(DISTINCT name) AS INTEGER) AS size FROM n GROUP BY grp)
SELECT grp, size, CASE WHEN size <= 1 THEN 0 WHEN size <= 16 THEN 4 WHEN size <= 32 THEN 5 WHEN size <= 64 THEN 6 ELSE 7 END AS block_bits,
CASE WHEN size <= 1 THEN 0 WHEN size <= 2 THEN 1 WHEN size <= 4 THEN 2 WHEN size <= 8 THEN 3 WHEN size <= 16 THEN 4 WHEN size <= 32 THEN 5 WHEN size <= 64 THEN 6 ELSE 7 END AS biome_bits FROM s""",
    "legacy_id_decode": f"""WITH g AS ({ADAPTERS['legacy_ids']}), l AS ({_LEGACY})
SELECT k, coalesce(e.name, d.name, '{PREFIX}{LEGACY_DEFAULT}') AS name, meta AS low, g.id & 15 AS high FROM g
LEFT JOIN l e ON e.id = g.id AND e.m = (g.meta & e.mask) LEFT JOIN l d ON d.id = g.id AND d.m IS NULL""",
    "first_appearance_dict": f"""WITH {_N}, f AS (SELECT grp, name, min(pos) AS first FROM n GROUP BY grp, name)
SELECT n.grp, pos, n.name, CAST(dense_rank() OVER (PARTITION BY n.grp ORDER BY first) - 1 AS INTEGER) AS code FROM n JOIN f ON n.grp = f.grp AND n.name = f.name""",
    "air_filter": f"""WITH {_N}, {_MAT} SELECT pos, name, bare IN ({', '.join(f"'{e}'" for e in EMPTY_NAMES)}) AS is_empty, (flags & 32) = 0 AND color <> 0 AS is_solid
FROM ({_with_material('n', 's.pos, s.name, s.bare AS bare')})""",
    "material_lookup": f"""WITH {_N}, {_MAT} SELECT pos, CAST(color AS BIGINT) AS color, CAST(flags AS INTEGER) AS flags, CAST(light AS INTEGER) AS light, CAST(opacity AS INTEGER) AS opacity
FROM (SELECT *, {_BARE} AS bare FROM n) s LEFT JOIN mat m ON s.bare = m.bare""",
    "material_fallback": f"WITH {_N}, {_MAT} {_with_material('n', 's.pos')}",
    "vertical_rle": f"WITH {_RUNS} SELECT * FROM runs",
    "chunk_bounds": f"WITH {_BOUNDS} SELECT * FROM bounds",
    "palette_index_clamp": f"WITH {_B} SELECT gx, gz, y, CASE pal - 1 {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(PALETTE[:5]))} ELSE '{PALETTE[0]}' END AS name FROM b",
    "block_index_unravel": f"""WITH {_W}, i AS (SELECT k, CAST(k % 4096 AS INTEGER) AS i, CAST(k % 24 AS INTEGER) - 4 AS s FROM w)
SELECT k, i % 16 AS x, i // 256 AS y, (i // 16) % 16 AS z, s * 16 + i // 256 AS abs_y FROM i""",
    "tile_min_fold": f"WITH s AS ({ADAPTERS['tile_headers']}) SELECT * FROM {_fold('s', 'pos_x, pos_z', 'seq')}",
    "tile_assembly_l0": f"""WITH {_RUNS}, {_BOUNDS.split(_BLOCKS + ',')[1]},
placed AS (SELECT CAST(chunk_x >> 2 AS INTEGER) AS pos_x, CAST(chunk_z >> 2 AS INTEGER) AS pos_z, chunk_z & 31 AS sz, chunk_x & 31 AS sx, min_y, max_y FROM bounds),
tiles AS {_fold('placed', 'pos_x, pos_z', 'sz, sx')}
SELECT pos_x, pos_z, CAST((gx & 63) * 64 + (gz & 63) AS INTEGER) AS cell, run_ord, y_min, y_max, color, flags, min_y, max_y FROM runs JOIN tiles ON pos_x = gx >> 6 AND pos_z = gz >> 6""",
    "argb_blend": f"WITH {_SOLID} SELECT gx, gz, {_mean()} AS color FROM solid GROUP BY gx, gz",
    "first8_samples": f"""WITH {_RUNS}, o AS (SELECT CAST(gx >> 1 AS INTEGER) AS px, CAST(gz >> 1 AS INTEGER) AS pz, color, flags,
CAST(row_number() OVER (PARTITION BY gx >> 1, gz >> 1 ORDER BY gx & 1, gz & 1, run_ord) - 1 AS INTEGER) AS ord FROM runs),
f AS (SELECT px, pz, CAST(coalesce(arg_min(CASE WHEN flags <> 0 THEN flags END, ord), 0) AS INTEGER) AS rep_flags FROM o GROUP BY px, pz)
SELECT o.px, o.pz, ord, rep_flags, color, flags FROM o JOIN f ON o.px = f.px AND o.pz = f.pz WHERE ord < 8""",
    "lod_downsample_l1": f"WITH {_RUNS} SELECT {_COLS} FROM {_level('runs')}",
    "lod_pyramid_l4": f"""WITH {_RUNS}, l1 AS MATERIALIZED {_level('runs')}, l2 AS MATERIALIZED {_level('l1')}, l3 AS MATERIALIZED {_level('l2')}, l4 AS {_level('l3')}
{' UNION ALL '.join(f'SELECT {k} AS level, {_COLS} FROM l{k}' for k in range(1, 5))}""",
    "lod_top_run": f"""WITH {_RUNS}, top AS (SELECT gx, gz, max(run_ord) AS run_ord, arg_max(y_min, run_ord) AS y_min, arg_max(y_max, run_ord) AS y_max, arg_max(color, run_ord) AS color, arg_max(flags, run_ord) AS flags FROM runs GROUP BY gx, gz)
SELECT {_COLS} FROM {_level('top')} WHERE color <> 0""",
    "chunk_hash": f"WITH {_B}, {_HASHES} SELECT chunk_x, chunk_z, hash FROM hashes",
    "blob_checksum": f"""WITH {_T}, bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hx, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM t),
hashed AS (SELECT doc_id, list_reduce(list_prepend(1::BIGINT, b), lambda a, x: (a * 31 + CASE WHEN x > 127 THEN x - 256 ELSE x END) & 4294967295) AS h FROM bytes)
SELECT doc_id, {_SIGNED} AS checksum FROM hashed""",
    "varint_encode": f"WITH {_T} SELECT doc_id, {_varint()} AS varint FROM t",
    "run_record_hex": f"WITH {_RUNS} SELECT gx, gz, run_ord, {_HEX[4].format('y_min')} || {_HEX[4].format('y_max')} || {_HEX[8].format('color')} || {_HEX[4].format('flags')} AS record FROM runs",
    "upsert_last_wins": f"WITH u AS ({ADAPTERS['hash_upserts']}) SELECT chunk_x, chunk_z, seq, h FROM (SELECT *, row_number() OVER (PARTITION BY chunk_x, chunk_z ORDER BY seq DESC) AS o FROM u) WHERE o = 1",
    "tile_union_counts": f"""WITH {_RUNS}, l1 AS MATERIALIZED {_level('runs')}, l2 AS {_level('l1')},
every AS (SELECT 0 AS level, {_COLS} FROM runs UNION ALL SELECT 1, {_COLS} FROM l1 UNION ALL SELECT 2, {_COLS} FROM l2)
SELECT level, count(DISTINCT (gx >> 6, gz >> 6)) AS tiles, count(*) AS runs, CAST(sum(y_max - y_min + 1) AS BIGINT) AS height FROM every GROUP BY level""",
    "empty_tile_outer": f"""WITH {_RUNS}, s AS ({ADAPTERS['tile_headers']}), tiles AS {_fold('s', 'pos_x, pos_z', 'seq')},
r AS (SELECT gx >> 6 AS px, gz >> 6 AS pz, count(*) AS n FROM runs GROUP BY 1, 2)
SELECT pos_x, pos_z, min_y, max_y, CAST(coalesce(n, 0) AS INTEGER) AS n_runs FROM tiles LEFT JOIN r ON pos_x = px AND pos_z = pz""",
    "section_sort": f"""WITH {_B}, s AS (SELECT DISTINCT CAST(gx >> 4 AS INTEGER) AS chunk_x, CAST(gz >> 4 AS INTEGER) AS chunk_z, CAST(y >> 4 AS INTEGER) AS section_y FROM b)
SELECT *, CAST(row_number() OVER (PARTITION BY chunk_x, chunk_z ORDER BY section_y) - 1 AS INTEGER) AS ord FROM s""",
    "header_location_decode": f"""WITH {_W}, r AS (SELECT k, w & 4294967295 AS raw, CAST(k % 1024 AS INTEGER) AS slot FROM w)
SELECT k, slot % 32 AS local_x, slot // 32 AS local_z, raw // 256 AS sector_offset, CAST(raw % 256 AS INTEGER) AS sector_count, (raw // 256) * 4096 AS byte_offset FROM r WHERE raw // 256 <> 0 AND raw % 256 <> 0""",
    "biome_decode": f"""WITH {_W}, s AS (SELECT k, w, CAST(k % 7 + 1 AS INTEGER) AS size FROM w),
b AS (SELECT *, CASE WHEN size <= 1 THEN 0 WHEN size <= 2 THEN 1 WHEN size <= 4 THEN 2 ELSE 3 END AS bits FROM s),
e AS (SELECT k, size, bits, i, CASE WHEN bits > 0 AND i < 64 // greatest(bits, 1) THEN (w >> CAST(i * bits AS BIGINT)) & ((1 << bits) - 1) ELSE 0 END AS v FROM b, range(64) r(i))
SELECT k, size, bits, CAST(sum(v * (i + 1)) AS BIGINT) AS weighted FROM e GROUP BY k, size, bits""",
    "scan_world": f"""WITH {_RUNS}, {_BOUNDS.split(_BLOCKS + ',')[1]}, {_HASHES},
n AS (SELECT gx >> 4 AS cx, gz >> 4 AS cz, CAST(count(*) AS INTEGER) AS n_runs, CAST(sum(y_max - y_min + 1) AS INTEGER) AS height FROM runs GROUP BY 1, 2)
SELECT h.chunk_x, h.chunk_z, min_y, max_y, hash, coalesce(n_runs, 0) AS n_runs, coalesce(height, 0) AS height
FROM hashes h JOIN bounds USING (chunk_x, chunk_z) LEFT JOIN n ON cx = h.chunk_x AND cz = h.chunk_z""",
    # The blob of a tile as hex: run counts of its 4096 columns, then its runs; hashed as signed bytes.
    "bake_world": f"""WITH {_RUNS}, {_BOUNDS.split(_BLOCKS + ',')[1]}, {_LEVELS}, {_TILES},
tiles AS ({' UNION ALL '.join(f'SELECT {k} AS level, pos_x, pos_z, min_y FROM t{k}' for k in range(5))}),
cut AS (SELECT level, gx >> 6 AS pos_x, gz >> 6 AS pos_z, (gx & 63) * 64 + (gz & 63) AS cell, run_ord,
  {_HEX[4].format('y_min')} || {_HEX[4].format('y_max')} || {_HEX[8].format('color')} || {_HEX[4].format('flags')} AS record FROM leveled),
counts AS (SELECT level, pos_x, pos_z, cell, count(*) AS n FROM cut GROUP BY ALL),
heads AS (SELECT t.level, t.pos_x, t.pos_z, string_agg({_varint()}, '' ORDER BY cell) AS head FROM (SELECT t.*, r.cell, coalesce(c.n, 0) AS n FROM tiles t CROSS JOIN range(4096) r(cell)
  LEFT JOIN counts c ON c.level = t.level AND c.pos_x = t.pos_x AND c.pos_z = t.pos_z AND c.cell = r.cell) t GROUP BY ALL),
bodies AS (SELECT level, pos_x, pos_z, string_agg(record, '' ORDER BY cell, run_ord) AS body FROM cut GROUP BY ALL),
blobs AS (SELECT t.level, t.pos_x, t.pos_z, min_y, head || coalesce(body, '') AS hx FROM tiles t JOIN heads h ON h.level = t.level AND h.pos_x = t.pos_x AND h.pos_z = t.pos_z
  LEFT JOIN bodies b ON b.level = t.level AND b.pos_x = t.pos_x AND b.pos_z = t.pos_z),
bytes AS (SELECT level, pos_x, pos_z, min_y, len(hx) // 2 AS raw_bytes, list_transform(regexp_extract_all(hx, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM blobs),
hashed AS (SELECT *, list_reduce(list_prepend(1::BIGINT, b), lambda a, x: (a * 31 + CASE WHEN x > 127 THEN x - 256 ELSE x END) & 4294967295) AS h FROM bytes)
SELECT level, pos_x, pos_z, min_y, {_SIGNED} AS checksum, raw_bytes FROM hashed""",
}

ORACLES["bake_levels"] = ORACLES["bake_world"]
# Chunks are moved by 101 and -46; within a tile they fold by file and slot: by region, then z and x within it.
ORACLES["document_tiles"] = f"""WITH {_RUNS}, {_BOUNDS.split(_BLOCKS + ',')[1]},
placed AS (SELECT CAST((chunk_x + 101) >> 2 AS INTEGER) AS pos_x, CAST((chunk_z - 46) >> 2 AS INTEGER) AS pos_z, 'region/r.' || (chunk_x >> 5) || '.' || (chunk_z >> 5) || '.mca' AS path,
  (chunk_x & 31) + (chunk_z & 31) * 32 AS slot, min_y, max_y FROM bounds),
tiles AS {_fold('placed', 'pos_x, pos_z', 'path, slot')},
n AS (SELECT ((gx >> 4) + 101) >> 2 AS px, ((gz >> 4) - 46) >> 2 AS pz, count(*) AS runs, CAST(sum(y_max - y_min + 1) AS BIGINT) AS height FROM runs GROUP BY 1, 2)
SELECT pos_x, pos_z, min_y, max_y, coalesce(runs, 0) AS runs, coalesce(height, 0) AS height FROM tiles LEFT JOIN n ON px = pos_x AND pz = pos_z"""
