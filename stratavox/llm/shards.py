"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have shards, and every shard has a weight;
inner nodes weigh what their shards weigh together. A key descends from the root: at each
node it draws ``-ln(u) / weight`` for every child, ``u`` being a uniform hash of the key and
the child's name, and enters the child with the least draw. A changed weight alters the
draws of its own ancestors only, so rows move within subtrees whose weights changed. A
shard added as a subtree of its own takes rows into itself and moves none between others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.store import materialize, table

SHARDS = 16
RACK_SHARDS = 4
REGION_RACKS = 2


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int = SHARDS) -> list[Shard]:
    """Equal shards, four to a rack and two racks to a region."""
    per_region = RACK_SHARDS * REGION_RACKS
    return [Shard(i // per_region, i // RACK_SHARDS, i) for i in range(shards)]


def with_new_region(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """``tree`` with one more shard, in a region and rack of its own."""
    new = Shard(max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1, max(s.shard for s in tree) + 1, weight)
    return [*tree, new]


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    """Exponential draw of rate ``weight``: 53 hash bits make a uniform number within (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}/{node}")), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _descend(key: Column, tree: list[Shard], levels: tuple[str, ...] = ("region", "rack", "shard")) -> Column:
    level, *rest = levels
    children: dict[int, list[Shard]] = {}
    for s in tree:
        if s.weight > 0:
            children.setdefault(getattr(s, level), []).append(s)
    inner = {node: _descend(key, below, tuple(rest)) if rest else F.lit(node) for node, below in children.items()}
    if len(children) == 1:
        return next(iter(inner.values()))
    draws = {node: _draw(key, level, node, sum(s.weight for s in below)) for node, below in children.items()}
    won = F.array_min(F.array(*[F.struct(d.alias("draw"), F.lit(node).alias("node")) for node, d in draws.items()]))["node"]
    if not rest:
        return won
    chain = F
    for node, column in inner.items():
        chain = chain.when(won == node, column)
    return chain


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """Shard of a key, as a JVM expression. A null key is one key like any other."""
    if not any(s.weight > 0 for s in tree):
        raise ValueError("the tree has no shard with a positive weight")
    return _descend(key, tree)


def assign(docs: DataFrame, tree: list[Shard], grown: list[Shard], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard every row and number the rows of a shard without gaps.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. Null or empty text
    has size 1; a null text has a null checksum. Rows that repeat a key share its shard and
    get slots of their own. Slots: every input partition counts its rows of each shard; the
    counts, one row per partition and shard, give each partition its first slot. So no task
    sees a whole shard.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        F.spark_partition_id().alias("part"),
    )
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), tree)).withColumn("grown_shard", shard_of(F.col("doc_id"), grown))
    rows = materialize(rows, "shards")
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    base = counts.selectExpr("shard", "part", "sum(n) OVER (PARTITION BY shard ORDER BY part) - n AS base")
    within = rows.selectExpr("*", "row_number() OVER (PARTITION BY part, shard ORDER BY doc_id, text_crc32, size) - 1 AS rn")
    return within.join(base, ["part", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rn") + F.col("base")).cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards; the law is ``key``."""
    tree = even_tree(SHARDS)
    return assign(table(spark, sf_dir, "documents"), tree, with_new_region(tree))
