"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.llm.store import materialize, release


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; nodes of a component share one of its nodes as root.

    Every round a node moves to whichever of itself and its neighbours has the least hash,
    and edges move with their ends. An edge stays within its component, so components stay
    apart, and with hashed priorities runs of ever lesser neighbours are short: the edges are
    used up in about log(n) rounds. Stars, paths and cliques need no task to hold all edges
    of a node: least neighbours come from partial aggregates, and joins can be split.
    """
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    roots = materialize(now.select(F.col("a").alias("node")).union(now.select(F.col("b"))).distinct().withColumn("root", F.col("node")), name)
    while not now.isEmpty():
        both = now.union(now.select("b", "a"))
        rank = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("to"))
        step = materialize(both.groupBy("a").agg(F.min(rank).alias("m")).select("a", F.least("m", own)["to"].alias("to")), name)
        moved = (
            now.join(step.withColumnRenamed("to", "ta"), "a")
            .join(step.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        after = materialize(moved, name)
        followed = roots.join(step.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        next_roots = materialize(followed, name)
        release(now, step, roots)
        now, roots = after, next_roots
    return roots
