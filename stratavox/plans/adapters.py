"""Voxel relations stated over the generic test tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Palette of the adapter ``blocks``; two entries share a material, two are air in the end.
PALETTE = ["stone", "granite", "polished_granite", "water", "oak_leaves", "air", "stone_stairs", "machine"]
AIR_CODE = 5

ADAPTERS = {
    # A strip 32 columns wide that grows with the table: 32 orders to a row of columns.
    "blocks": """select cast(l_partkey % 32 as int) - 16 as gx, cast(floor(l_orderkey / 32) as int) - 40 as gz,
 cast((l_suppkey * 7 + l_linenumber * 5 + cast(floor(l_quantity) as bigint)) % 48 as int) - 16 as y,
 cast(min((l_partkey * 3 + l_linenumber) % 8) as int) as pal from lineitem group by 1, 2, 3""",
    "region_paths": """select c_custkey as seq, concat('world/region/', case when c_custkey % 10 = 7 then 'c.' else 'r.' end,
 cast(c_custkey % 9 - 4 as varchar(8)), '.', cast(c_nationkey % 7 - 3 as varchar(8)),
 case when c_custkey % 10 = 8 then '.extra' else '' end, case when c_custkey % 10 = 9 then '.mcc' else '.mca' end) as path from customer""",
    "block_names": """select p_partkey as pos, cast(p_size as int) as grp, concat(case p_partkey % 3 when 0 then 'minecraft:' when 1 then '' else 'mod:' end,
 case p_partkey % 13 when 0 then 'stone' when 1 then 'oak_leaves' when 2 then 'palm_leaves' when 3 then 'palm_wood' when 4 then 'water'
 when 5 then 'fire_coral' when 6 then 'black_sand' when 7 then 'tall_grass' when 8 then 'stone_stairs' when 9 then 'cave_air'
 when 10 then 'barrier' when 11 then 'granite' else 'machine' end) as name from part""",
    "packed_words": """select o_orderkey as k, case when o_orderkey % 2 = 1 then -1 - o_orderkey * 2654435761 else o_orderkey * 2654435761 end as w from orders""",
    "byte_payloads": """select doc_id, hex(text) as hx, n_chars as n from documents""",
    "tile_headers": """select c_custkey as seq, cast(c_custkey % 16 - 8 as int) as pos_x, cast(c_nationkey % 16 - 8 as int) as pos_z,
 cast((c_custkey * 7) % 11 - case when c_nationkey % 3 = 0 then 3 else 0 end as int) as min_y, cast((c_custkey * 5) % 23 - 6 as int) as max_y from customer""",
    "hash_upserts": """select cast(user_id % 37 - 18 as int) as chunk_x, cast(user_id % 29 - 14 as int) as chunk_z, event_id as seq, cast(event_id * 31 % 1000003 as int) as h from events""",
    "legacy_ids": """select p_partkey as k, cast(p_partkey % 64 as int) as id, cast(p_size % 16 as int) as meta from part""",
}


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter over the Parquet tables of a folder."""
    return spark.sql(re.sub(r" from (\w+)", rf" from parquet.`{sf_dir}/\1.parquet`", ADAPTERS[name]))
