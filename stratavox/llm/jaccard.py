"""Jaccard join of word n-gram sets with token-combination prefixes, and its components.

Documents with equal sets are one class. Classes are cut down before any pair is formed:

1. In hash order, the first tokens of a class and those of any partner, larger or smaller,
   have a known number in common; a class with fewer first tokens that are also among
   another's has no partner.
2. Among the rest, all tokens are counted. A class needs at least 80 % tokens that others have.
3. Tokens are ordered from rare to frequent. Two linked classes share more than m tokens
   within prefixes that are m tokens longer than a plain prefix. Rare tokens are indexed
   singly. Frequent ones fall into m lots by hash and are indexed in pairs within a lot: m+1
   shared tokens put a rare token or a pair of one lot in both prefixes.
4. Classes under one index key are candidates. All pairs of a key are never formed: each
   class is verified against one pivot per key, components are merged, and only keys that
   still hold several components go on, with other pivots. Once few pairs across components
   are left they are all verified in blocks: the classes outside a key's main component
   with each other and with that component, once however many keys they share, and only
   where sizes are near enough. A block is bounded by its classes and by its tokens, and
   gives one link for each two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.components import components
from stratavox.llm.filters import holds, key_filter, may_hold
from stratavox.llm.store import batchwise, give_back, groupwise, materialize, release, table
from stratavox.llm.words import SPACED, U64, Words, mix, ngram_hashes, slices

SHINGLE = 5
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Part of a set's tokens, in hash order, that the first count looks at (percent).
FIRST_LOOK = 30
#: Classes that hold a token, from which on it counts as frequent.
FREQUENT = 9
#: Entries of a bucket in the token counts, about; there are as many buckets as that takes.
BUCKET_ENTRIES = 1 << 18
#: Tokens of a lot of classes.
FLUSH_ENTRIES = 1 << 18
#: Rounds with pivots at most, and pairs across components per index entry at which they end.
ROUNDS, FEW_PAIRS = 6, 32
#: Classes and tokens in a block of those that are compared with others of their keys; of the others twice as many.
BLOCK, BLOCK_TOKENS = 512, 1 << 18


def least_shared(n: np.ndarray) -> np.ndarray:
    """Tokens that a set of ``n`` shares with any linked one, at least."""
    return -(-n * PERCENT // 100)


def first_look(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, np.maximum(n - least_shared(n) + 1, -(-n * FIRST_LOOK // 100)))


def least_met(n: Column, look: Column) -> Column:
    """Tokens that the first look of a set of ``n`` has in common with that of any linked set, at least.

    With c common tokens, all others of both sets may come first: then look(n) - (n - c) of
    the common ones are in the one look and look(m) - (m - c) in the other's, and the smaller
    number is in both. The first is least for the least c. The second is, with look(m) at
    FIRST_LOOK percent of m or more and c * (100 + PERCENT) >= PERCENT * (n + m), no less than
    a line in m, which is least at an end of the sizes that may be linked.
    """
    own = look - (n - F.ceil(n * PERCENT / 100))
    larger = F.ceil(n * (PERCENT + FIRST_LOOK - 100) / PERCENT)
    smaller = F.ceil(n * PERCENT * FIRST_LOOK / 10_000)
    return F.least(own, larger, smaller)


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each document its distinct shingle hashes, ascending."""
    w = Words(raw, off, SPACED)
    grams = ngram_hashes(w.hash, size)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            h = np.sort(grams[a : b - size + 1])
            if len(h) > 1:
                h = h[np.concatenate([[True], h[1:] != h[:-1]])]
            yield h
        elif n:
            yield mix(ngram_hashes(w.hash[a:b], n) + U64(n))
        else:
            yield grams[:0]


def fingerprint(tokens: np.ndarray) -> int:
    """64 bits that stand for a set."""
    with np.errstate(over="ignore"):
        s = mix(tokens + U64(0x632BE59BD9B4E019)).sum(dtype=U64)
        return int(mix(np.array([s ^ (U64(len(tokens)) * U64(0x9E3779B97F4A7C15))], dtype=U64)).view(np.int64)[0])


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, fp = [], []
        for _, _, raw, off in slices(batch.column(1)):
            for s in shingle_sets(raw, off):
                n.append(len(s))
                fp.append(fingerprint(s))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.int64())], names=["doc_id", "n_shingles", "fp"])

    return docs.select("doc_id", "text").mapInArrow(batchwise(run), "doc_id long, n_shingles long, fp long")


def _postings(docs: DataFrame, whole: bool, keep=None) -> DataFrame:
    """Lots of classes with their tokens: the first look of every class, or all tokens of the classes in ``keep``.

    A row is a lot (about FLUSH_ENTRIES tokens): its number, the classes, how many tokens
    each has, and the tokens, all as bytes. A lot holds a class once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: dict[int, np.ndarray] = {}
        size = 0

        def lot() -> pa.RecordBatch:
            fp, n = np.array(list(held), dtype=np.int64), np.array([len(v) for v in held.values()], dtype=np.int64)
            columns = [pa.array([x.tobytes()], pa.binary()) for x in (fp, n, np.concatenate(list(held.values())))]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), *columns], names=["lot", "fps", "sizes", "tokens"])

        for batch in batches:
            for _, _, raw, off in slices(batch.column(0)):
                for s in shingle_sets(raw, off):
                    fp = fingerprint(s)
                    if not len(s) or fp in held or (keep is not None and not holds(keep.value, np.array([fp]))[0]):
                        continue
                    held[fp] = s if whole else s[: int(first_look(np.int64(len(s))))]
                    size += len(held[fp])
                    if size >= FLUSH_ENTRIES:
                        yield lot()
                        held, size, number = {}, 0, number + 1
        if held:
            yield lot()
        held = {}
        give_back()

    return docs.select("text").mapInArrow(run, "lot long, fps binary, sizes binary, tokens binary")


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal keys."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return list(zip(cuts.tolist(), np.append(cuts[1:], len(keys)).tolist(), strict=True))


def _dealt(buckets: int):
    edge = [(b << 64) // buckets for b in range(1, buckets)]
    edges = np.array(edge, dtype=U64)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """(bucket, lot, tokens, classes of the lot that hold each) by equal ranges of the hash space."""
        for lot, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = np.frombuffer(data.as_buffer(), dtype=U64)
            if (tokens[1:] > tokens[:-1]).all():  # of one class
                n = np.ones(len(tokens), dtype=np.uint8)
            else:
                tokens, n = np.unique(tokens, return_counts=True)
                n = np.minimum(n, 255).astype(np.uint8)
            cuts = np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])
            spans = [(b, i, j) for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _, _ in spans], pa.int64()),
                    pa.array([lot] * len(spans), pa.int64()),
                    pa.array([tokens[i:j].tobytes() for _, i, j in spans], pa.binary()),
                    pa.array([n[i:j].tobytes() for _, i, j in spans], pa.binary()),
                ],
                names=["bucket", "lot", "tokens", "counts"],
            )

    return batchwise(run)


def _bytes(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _shared_tokens(t: pa.Table) -> pa.Table:
    """For each lot of a bucket its tokens that several classes hold, and how many do.

    A token is there once for each lot, however many classes of it have the token. A lot
    counts up to 255 classes, and a class in two lots counts twice: the order of tokens that
    follows is the same for all classes, which is all that is asked of it.
    """
    tokens, n = _bytes(t.column("tokens"), U64), _bytes(t.column("counts"), np.uint8).astype(np.int64)
    sizes = np.array([len(x) for x in t.column("counts").to_pylist()])
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(tokens, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], tokens[order][1:] != tokens[order][:-1]]))
    total = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(tokens))))
    df = np.empty(len(tokens), dtype=np.int64)
    df[order] = total
    some = df > 1
    tokens, df, row = tokens[some], df[some].astype(np.uint32), row[some]
    spans = _spans(row)
    return pa.table(
        {
            "lot": t.column("lot").take(pa.array([int(row[i]) for i, _ in spans], pa.int64())),
            "tokens": pa.array([tokens[i:j].tobytes() for i, j in spans], pa.binary()),
            "df": pa.array([df[i:j].tobytes() for i, j in spans], pa.binary()),
        }
    )


def _measured(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes of a lot, first index of each class's tokens, tokens, classes that hold each or 0 if one does)."""
    own = t.filter(pa.compute.is_valid(t.column("fps")))
    rest = t.filter(pa.compute.is_null(t.column("fps")))
    fps, sizes, tokens = _bytes(own.column("fps"), np.int64), _bytes(own.column("sizes"), np.int64), _bytes(own.column("tokens"), U64)
    # Tokens of a bucket come in order, and buckets are ranges, so their first tokens put them in order.
    parts = [(np.frombuffer(t, U64), np.frombuffer(d, np.uint32)) for t, d in zip(rest.column("tokens").to_pylist(), rest.column("df").to_pylist(), strict=True)]
    parts.sort(key=lambda p: p[0][0])
    known = np.concatenate([*(t for t, _ in parts), np.zeros(1, U64)])
    n = np.concatenate([*(d for _, d in parts), np.zeros(1, np.uint32)])
    df = np.zeros(len(tokens), dtype=np.uint32)
    for a in range(0, len(tokens), FLUSH_ENTRIES):
        some = tokens[a : a + FLUSH_ENTRIES]
        at = np.searchsorted(known[:-1], some)
        df[a : a + FLUSH_ENTRIES] = np.where(known[at] == some, n[at], 0)
    return fps, np.cumsum(sizes) - sizes, tokens, df


def _count_shared(t: pa.Table) -> pa.Table:
    fps, first, _, df = _measured(t)
    return pa.table({"fp": pa.array(fps), "shared": pa.array(np.add.reduceat((df > 0).astype(np.int64), first) if len(first) else first, pa.int64())})


def _ordered_sets(t: pa.Table) -> pa.Table:
    """fp, its shared tokens from rare to frequent, how many are rare."""
    fps, first, tokens, df = _measured(t)
    of = np.repeat(np.arange(len(fps)), np.diff(np.append(first, len(tokens))))
    some = df > 0
    of, tokens, df = of[some], tokens[some], df[some]
    order = np.lexsort((tokens, df, of))
    tokens, df = tokens[order], df[order]
    ends = np.searchsorted(of, np.arange(len(fps) + 1))
    return pa.table(
        {
            "fp": pa.array(fps),
            "rare": pa.array(np.bincount(of, df < FREQUENT, len(fps)).astype(np.int64)),
            "tokens": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.view(np.int64))),
        }
    )


def _by_lot(postings: DataFrame, buckets: int, function, schema: str) -> DataFrame:
    """Apply ``function`` to each lot with the counts of its shared tokens.

    Counts are made by bucket from one entry for each lot and token, and go back to the lots;
    a lot is bounded, and so is what a token brings to a bucket, however many classes hold it.
    """
    dealt = postings.select("lot", "tokens").mapInArrow(_dealt(buckets), "bucket long, lot long, tokens binary, counts binary")
    shared = dealt.groupBy("bucket").applyInArrow(groupwise(_shared_tokens), "lot long, tokens binary, df binary")
    none = F.lit(None).cast("binary")
    rows = postings.select("lot", "fps", "sizes", "tokens", none.alias("df")).union(shared.select("lot", none, none, "tokens", "df"))
    return rows.groupBy("lot").applyInArrow(groupwise(function), schema)


def _lots(level: np.ndarray | int) -> int:
    """Lots of frequent tokens at a size level: about five prefix tokens to a lot."""
    return max(1, int(0.05 * 1.25**level))


def size_level(n: int) -> int:
    """Linked sets are at most one level apart."""
    level = int(np.log(n) / np.log(1.25))
    while 1.25 ** (level + 1) <= n:
        level += 1
    while 1.25**level > n:
        level -= 1
    return level


def signatures(n: int, rare: int, tokens: np.ndarray) -> np.ndarray:
    """Index keys of a class: rare prefix tokens, and pairs of frequent ones within a lot.

    A class takes part at its own size level and the next, so linked classes meet at one.
    Its tokens that no other class has come first and fill the prefix without a key.
    """
    plain = int(n - least_shared(np.int64(n)) + 1) - (n - len(tokens))
    level = size_level(n)
    out = [mix(tokens[: max(0, min(rare, plain + _lots(level + 1)))] + U64(1))]
    for at in (level, level + 1):
        lots = _lots(at)
        frequent = tokens[rare : max(rare, plain + lots)]
        lot = frequent % U64(lots)
        order = np.lexsort((frequent, lot))
        frequent, lot = frequent[order], lot[order]
        gap = 1
        while gap < len(frequent):
            same = lot[gap:] == lot[:-gap]
            if not same.any():
                break
            a, b = frequent[:-gap][same], frequent[gap:][same]
            out.append(mix(mix(a + U64(at + 2)) * U64(3) + b))
            gap += 1
    return np.unique(np.concatenate(out))


def _index(sets: DataFrame) -> DataFrame:
    """(sig, fp, n) entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(3)
            flat, off = tokens.values.to_numpy(zero_copy_only=False).view(U64), tokens.offsets.to_numpy()
            held: list[tuple[np.ndarray, int, int]] = []
            size = 0
            for i, (fp, n, rare) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                s = signatures(n, rare, flat[off[i] : off[i + 1]])
                held.append((s, fp, n))
                size += len(s)
                if size >= FLUSH_ENTRIES or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([h[0] for h in held]).view(np.int64)),
                            pa.array(np.concatenate([np.full(len(h[0]), h[1], np.int64) for h in held])),
                            pa.array(np.concatenate([np.full(len(h[0]), h[2], np.int64) for h in held])),
                        ],
                        names=["sig", "fp", "n"],
                    )
                    held, size = [], 0

    return sets.select("fp", "n", "rare", "tokens").mapInArrow(run, "sig long, fp long, n long")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; tokens no other class has count for the union only."""
    left = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= (F.col("na") + F.col("nb") - both) * PERCENT).select("a", "b")


def _alike(n: str, m: str):
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _pairs(fp, other) -> list:
    return [F.least(fp, other).alias("a"), F.greatest(fp, other).alias("b")]


def _overlaps(t: pa.Table, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Intersection sizes of the sets at ``rows`` with those at ``others``."""
    tokens = t.column("tokens").combine_chunks()
    flat, off = tokens.values.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()

    def postings(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = off[at + 1] - off[at]
        keys = np.concatenate([flat[off[i] : off[i + 1]] for i in at]) if len(at) else flat[:0]
        order = np.argsort(keys, kind="stable")
        return keys[order], np.repeat(np.arange(len(at)), sizes)[order]

    (lk, li), (rk, ri) = postings(rows), postings(others)
    first, last = np.searchsorted(rk, lk, "left"), np.searchsorted(rk, lk, "right")
    hits = last - first
    out = np.zeros(len(rows) * len(others), dtype=np.int64)
    ends = np.cumsum(hits)
    at = 0
    while at < len(lk):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 19), "right")))
        n = hits[at:to]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(out, np.repeat(li[at:to], n) * len(others) + ri[np.repeat(first[at:to], n) + nth], 1)
        at = to
    return out.reshape(len(rows), len(others))


def _block_links(t: pa.Table) -> pa.Table:
    """One link (a, b) for every two components that a block of rows and others links."""
    left = t.column("left").to_numpy(zero_copy_only=False).astype(bool)
    fp, n, root = (t.column(c).to_numpy() for c in ("fp", "n", "root"))
    rows, others = np.flatnonzero(left), np.flatnonzero(~left)
    both = _overlaps(t, rows, others)
    r, o = np.nonzero(both * 100 >= (n[rows][:, None] + n[others][None, :] - both) * PERCENT)
    r, o = rows[r], others[o]
    apart = root[r] != root[o]
    r, o = r[apart], o[apart]
    pair = np.column_stack([np.minimum(root[r], root[o]), np.maximum(root[r], root[o])])
    _, one = np.unique(pair, axis=0, return_index=True)
    return pa.table({"a": pa.array(fp[r[one]], pa.int64()), "b": pa.array(fp[o[one]], pa.int64())})


def _cross_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the classes outside a main component with all that share its keys, block by block.

    A class takes part at its size level and the next, so that only sizes that may be linked meet.
    """
    size = F.size("tokens")
    rows = members.join(sets.select("fp", "n", size.alias("size")), "fp")
    level = F.floor(F.log("n") / float(np.log(100 / PERCENT))).cast("int")
    rows = rows.withColumn("level", F.explode(F.array(level, level + 1)))
    few = lambda classes, tokens, k: F.greatest(F.ceil(classes / (k * BLOCK)), F.ceil(tokens / (k * BLOCK_TOKENS)))
    blocks = rows.groupBy("main", "level").agg(
        F.count_if("out").alias("outs"), F.sum(F.when(F.col("out"), F.col("size"))).alias("out_tokens"), F.count("*").alias("all"), F.sum("size").alias("all_tokens")
    )
    blocks = blocks.where("outs > 0 AND all > 1").select("main", "level", few(F.col("outs"), F.col("out_tokens"), 1).alias("bi"), few(F.col("all"), F.col("all_tokens"), 2).alias("bj"))
    rows = rows.join(blocks, ["main", "level"])
    i, j = F.pmod(F.xxhash64("fp"), "bi"), F.pmod(F.xxhash64("fp", F.lit(1)), "bj")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where("out").select("main", "level", i.alias("i"), every("bj").alias("j"), "fp", "root", F.lit(True).alias("left"))
    right = rows.select("main", "level", every("bi").alias("i"), j.alias("j"), "fp", "root", F.lit(False).alias("left"))
    # Tokens come last, so that rows are dealt out by block and not by main component.
    dealt = materialize(left.union(right), "blocks").join(sets.select("fp", "n", "tokens"), "fp")
    return dealt.groupBy("main", "level", "i", "j").applyInArrow(groupwise(_block_links), "a long, b long")


def _link_classes(sets: DataFrame) -> DataFrame:
    """(node, root) over all links between classes."""
    index = materialize(_index(sets), "index")
    keys = index.groupBy("sig").agg(F.count("*").alias("k"), F.min(F.struct("fp", "n")).alias("pivot")).where("k > 1")
    active = materialize(index.join(keys, "sig").select("sig", "fp", "n", F.col("pivot.fp").alias("pf"), F.col("pivot.n").alias("pn")), "keys")
    release(index)
    made = [active]
    fresh = active.where("fp <> pf").where(_alike("n", "pn")).select(*_pairs("fp", "pf")).distinct()
    tried = materialize(fresh, "pairs")
    links = materialize(_linked(tried, sets), "links")
    made += [tried, links]
    active = active.select("sig", "fp", "n")
    for turn in range(1, ROUNDS + 1):
        roots = components(links)
        named = active.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("sig", "fp", "n", F.coalesce("root", "fp").alias("root"))
        own = F.struct(F.xxhash64("sig", "fp", F.lit(turn)).alias("h"), "fp", "n", "root")
        open_keys = (
            named.groupBy("sig", "root")
            .agg(F.count("*").alias("k"), F.min(own).alias("pivot"))
            .groupBy("sig")
            .agg(F.count("*").alias("roots"), F.min("pivot").alias("pivot"), F.max(F.struct("k", "root")).alias("main"))
            .where("roots > 1")
        )
        made.append(roots)
        open_rows = materialize(named.join(open_keys, "sig").select("sig", "fp", "n", "root", "pivot", "main"), "keys")
        outside = open_rows.where("root <> main.root").select(F.col("main.root").alias("main"), "fp", "root").distinct()
        inside = open_rows.where("root = main.root").select(F.col("root").alias("main"), "fp", "root").distinct()
        members = materialize(outside.withColumn("out", F.lit(True)).union(inside.withColumn("out", F.lit(False))), "members")
        made += [open_rows, members]
        sizes = members.groupBy("main").agg(F.count_if("out").alias("outs"), F.count("*").alias("all"))
        cross = sizes.agg(F.sum(F.col("outs") * F.col("all"))).first()[0]
        if not cross:
            break
        if turn == ROUNDS or cross <= FEW_PAIRS * open_rows.count():
            made.append(materialize(_cross_links(members, sets), "links"))
            links = links.union(made[-1])
            break
        fresh = open_rows.where("root <> pivot.root").select("fp", "n", F.col("pivot.fp").alias("pf"), F.col("pivot.n").alias("pn"))
        fresh = fresh.where(_alike("n", "pn")).select(*_pairs("fp", "pf")).distinct().join(tried, ["a", "b"], "left_anti")
        fresh = materialize(fresh, "pairs")
        found = materialize(_linked(fresh, sets), "links")
        made += [fresh, found]
        links, tried, active = links.union(found), tried.union(fresh), open_rows.select("sig", "fp", "n")
    out = components(links)
    release(*made)
    return out


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs(doc_id integer, text)``.

    Null, empty and wordless texts have no shingles, link with nothing, and are their own
    component. Repeated rows are copies. A null doc_id never names a component: a component
    of null ids only has a null one.
    """
    own = materialize(_sets(docs), "sets")
    classes = own.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    classes = materialize(classes, "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = int(-(-total * FIRST_LOOK // 100 // BUCKET_ENTRIES)) + 8

    postings = materialize(_postings(docs, whole=False), "looks")
    n, t = F.col("n"), F.ceil(F.col("n") * PERCENT / 100)
    look = F.least(n, F.greatest(n - t + 1, F.ceil(n * FIRST_LOOK / 100)))
    looked = _by_lot(postings, buckets, _count_shared, "fp long, shared long").groupBy("fp").agg(F.max("shared").alias("shared"))
    hopeful = materialize(looked.join(classes, "fp").where(F.col("shared") >= least_met(n, look)).select("fp", "n"), "hopeful")
    release(postings)
    kept, total = hopeful.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    keep = key_filter(hopeful, "fp", kept)

    buckets = int(total // BUCKET_ENTRIES) + 8
    postings = materialize(_postings(docs, whole=True, keep=keep), "postings")
    sets = _by_lot(postings, buckets, _ordered_sets, "fp long, rare long, tokens array<long>")
    sets = sets.join(hopeful, "fp").where(F.size("tokens") >= t).select("fp", "n", "rare", "tokens").dropDuplicates(["fp"])
    sets = materialize(sets, "tokens")
    release(postings)

    roots = _link_classes(sets)
    release(sets, hopeful)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = named.join(least, "root").select("fp", "component_id")
    return own.join(of_class, "fp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of every component: the one with the smallest doc_id.

    Rows that repeat its doc_id are copies of it, of which one row stays. Rows without a
    doc_id stay all. Only rows whose id may be that of a copy, by a filter of fixed size, are
    joined with the exact ids; the others stay where they are, so most texts are not moved.
    """
    found = materialize(join(docs).select("doc_id", "component_id"), "components")
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    repeated = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    repeated = materialize(repeated, "repeated")
    both = gone.union(repeated).select(F.xxhash64("doc_id").alias("key"))
    maybe = F.col("doc_id").isNotNull() & may_hold(key_filter(both, "key", both.count()), F.xxhash64("doc_id"))
    rest = docs.where(maybe).join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not repeated.isEmpty():
        single = rest.join(repeated, "doc_id", "left_anti")
        rest = single.select(*docs.columns).union(rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))
    return docs.where(~maybe).union(rest)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 5-word shingles and a similarity of 0.8."""
    return join(table(spark, sf_dir, "documents"))


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Over all pairs that share a shingle, so for small tables only.
OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS sh
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM w JOIN component c ON c.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""
