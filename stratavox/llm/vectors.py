"""Near-duplicate vectors: spherical k-means cells and blocked cosine products within cells.

Equal vectors are one class, so copies cost nothing. Classes go to the cells of their few
nearest centroids: written once, with the numbers of those cells, and sent to each as they
are. A dense cell is cut into blocks, every two blocks of it are multiplied in double
precision, and a pair counts in the first cell that both classes are in. Blocks hand on
counts and, of every component of their links, a star only.

Centroids are fitted on a bounded sample; every vector is indexed. Two vectors are compared
when they share a cell, hence links are found with a recall under 1 (see the README for
the measured one), and no pair below the threshold is ever linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.components import components
from stratavox.llm.store import batchwise, groupwise, materialize, release, table

THRESHOLD = 0.95
#: Vectors the centroids are fitted on, and rounds of fitting.
MAX_TRAIN, ROUNDS = 20_000, 8
#: Vectors a cell has on average, cells at most, and cells each vector is put into.
CELL_ROWS, MAX_CELLS, PROBES = 256, 4096, 6
#: Vectors in a block; a cell has one as a rule.
BLOCK = 4096


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, shorter ones filled up with zeros. No list or number may be null."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width))
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - first[row]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; none may be zero. Dividing by the largest first keeps squares in range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means: centroids are unit means, empty cells keep theirs."""
    rng = np.random.default_rng(7)
    c = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.sqrt((total**2).sum(1))
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def _hashed(vectors: DataFrame) -> DataFrame:
    """``vectors`` with id: 128 bits as text that stand for the vector, null for unusable ones."""
    e = F.col("embedding")
    sound = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    plain = F.transform(e, lambda x: x.cast("double") + F.lit(0.0))
    both = F.concat(*[F.lpad(F.hex(F.xxhash64(*seed, plain)), 16, "0") for seed in ((), (F.lit(1),))])
    return vectors.select("vec_id", "embedding", F.when(F.coalesce(sound, F.lit(False)), both).alias("id"))


def _cells(centroids, firsts: DataFrame) -> DataFrame:
    """``firsts(id, copies, embedding)`` with the nearest cells of each, ascending."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        probes = min(PROBES, len(c))
        near = [np.zeros((0, probes), np.int32)]
        for i in range(0, len(batch), 1024):
            s = unit(matrix(batch.column(2)[i : i + 1024], c.shape[1])) @ c.T
            near.append(np.sort(np.argpartition(-s, probes - 1, axis=1)[:, :probes], axis=1).astype(np.int32))
        near = np.concatenate(near)
        lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, probes, dtype=np.int32), near.ravel())
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "copies", "embedding", "cells"])

    kind = firsts.schema["embedding"].dataType.simpleString()
    return firsts.mapInArrow(batchwise(run), f"id string, copies long, embedding {kind}, cells array<int>")


def _least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least one of its component over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _compare(threshold: float, width: int):
    def run(t: pa.Table) -> pa.Table:
        """Links of block i with block j of a cell: counts as rows (id, null, links), and of each component a star as rows (id, other, 0)."""
        cell = t.column("cell")[0].as_py()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        block, copies = (t.column(c).to_numpy() for c in ("block", "copies"))
        x = unit(matrix(t.column("embedding"), width))
        cells = t.column("cells").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        rows, others = np.flatnonzero(block == i), np.flatnonzero(block == j)
        r, o = [np.zeros(0, int)], [np.zeros(0, int)]
        for k in range(0, len(rows), 512):
            a, b = np.nonzero(x[rows[k : k + 512]] @ x[others].T >= threshold)
            a, b = rows[k + a], others[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            first = _first_common(cells[a], cells[b]) == cell
            r.append(a[first])
            o.append(b[first])
        r, o = np.concatenate(r), np.concatenate(o)
        links = (np.bincount(r, copies[o], len(t)) + np.bincount(o, copies[r], len(t))).astype(np.int64)
        some, least = np.flatnonzero(links), _least_linked(len(t), r, o)
        star = np.flatnonzero(least != np.arange(len(t)))
        ids = t.column("id").combine_chunks()
        return pa.table(
            {
                "id": pa.concat_arrays([ids.take(pa.array(some)), ids.take(pa.array(star))]),
                "other": pa.concat_arrays([pa.nulls(len(some), ids.type), ids.take(pa.array(least[star]))]),
                "links": pa.array(np.concatenate([links[some], np.zeros(len(star), np.int64)]), pa.int64()),
            }
        )

    return groupwise(run)


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least cell that both rows of sorted cells have."""
    out = np.full(len(a), np.iinfo(np.int32).max, dtype=np.int64)
    for k in range(a.shape[1]):
        has = (b == a[:, k : k + 1]).any(1)
        out = np.minimum(out, np.where(has, a[:, k], out))
    return out


def near(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``vectors(vec_id, embedding)``.

    A vector that is null, empty, zero, or holds null or non-finite components links with
    nothing, and is kept. Equal vectors link with each other, also under one vec_id. Vectors
    of another length are compared as if filled up with zeros. A null vec_id names no
    component and is not kept, unless its vector is unusable.
    """
    spark = vectors.sparkSession
    hashed = _hashed(vectors)
    own = materialize(hashed.select("vec_id", "id", F.size("embedding").alias("size")), "vectors")
    groups = own.where("id IS NOT NULL").groupBy("id").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.max("size").alias("size"))
    groups = materialize(groups, "groups")
    n, width = groups.agg(F.count("*"), F.max("size")).first()
    if n == 0:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # One row stands for a class. Keyed by vec_id as well, the copies of a large class do not meet in one task.
    heads = groups.select(F.col("id").alias("head"), "first", "copies")
    same = (F.col("id") == F.col("head")) & F.col("vec_id").eqNullSafe(F.col("first"))
    firsts = materialize(hashed.join(heads, same).dropDuplicates(["id"]).select("id", "copies", "embedding"), "firsts")
    chosen = firsts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, MAX_TRAIN / n) * (1 << 30)))
    sample = chosen.orderBy("id").toArrow().column("embedding")
    x = unit(matrix(sample, width)) if len(sample) else np.eye(1, width)
    cells = max(1, min(n // CELL_ROWS, MAX_CELLS, len(x)))
    centroids = spark.sparkContext.broadcast(fit_cells(x, cells))

    placed = materialize(_cells(centroids, firsts), "cells")
    release(firsts)
    put = placed.select(F.explode("cells").alias("cell"), "id", "copies", "embedding", "cells")
    blocks = put.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = put.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = dealt.withColumn("other", each).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    pairs = pairs.select("cell", "i", "j", "block", "id", "copies", "embedding", "cells")
    found = pairs.groupBy("cell", "i", "j").applyInArrow(_compare(threshold, width), "id string, other string, links long")
    found = materialize(found, "found")
    release(placed)

    roots = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    facts = groups.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    facts = facts.withColumn("root", F.coalesce("root", "id"))
    least = facts.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = facts.join(least, "root").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = own.join(facts, "id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("id").isNull().alias("alone")
    )
    kept = F.col("alone") | F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.select("vec_id", "n_links", "component_id", kept.alias("kept"))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings at a cosine of 0.95."""
    return near(table(spark, sf_dir, "embeddings"))


#: Over all pairs, so for small tables only.
OP2_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
    WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN component c ON c.vec_id = v.vec_id LEFT JOIN counted n ON n.vec_id = v.vec_id"""
