import math
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from stratavox.llm.shards import Shard, assign, even_tree, op1_sharding, shard_of, with_new_region
from tests.conftest import SF


def draw(key, level, node, weight):
    h = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
    h = xxhash.xxh64_intdigest(f"{level}/{node}".encode(), seed=h)
    return -math.log(((h >> 11) + 0.5) / 2**53) / weight


def descend(key, tree, levels=("region", "rack", "shard")):
    level, *rest = levels
    below = defaultdict(list)
    for s in tree:
        below[getattr(s, level)].append(s)
    node = min(below, key=lambda n: draw(key, level, n, sum(s.weight for s in below[n]))) if len(below) > 1 else next(iter(below))
    return descend(key, below[node], tuple(rest)) if rest else node


def test_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op1_sharding(spark, SF).collect()
    tree = even_tree()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "key"
        assert r.shard == descend(r.doc_id, tree) and r.grown_shard == descend(r.doc_id, with_new_region(tree))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_odd_rows(spark, odd_docs):
    rows = assign(odd_docs, even_tree(), with_new_region(even_tree())).collect()
    assert len(rows) == odd_docs.count()
    null = next(r for r in rows if r.doc_id == 1)
    assert null.size == 1 and null.text_crc32 is None
    same = [r for r in rows if r.doc_id == 13]
    assert len({r.shard for r in same}) == 1 and len({r.slot for r in same}) == 2
    assert assign(odd_docs.limit(0), even_tree(), even_tree(17)).count() == 0


def shards(spark, tree, n=20_000):
    return [r[0] for r in spark.range(n).select(shard_of(F.col("id"), tree)).collect()]


def test_balance_and_growth(spark):
    before, after = shards(spark, even_tree()), shards(spark, with_new_region(even_tree()))
    count = Counter(before)
    assert len(count) == 16 and max(count.values()) < 1.15 * 20_000 / 16
    moved = [(a, b) for a, b in zip(before, after) if a != b]
    assert {b for _, b in moved} == {16} and 0.8 * 20_000 / 17 < len(moved) < 1.2 * 20_000 / 17


def test_a_weight_moves_rows_within_its_own_subtrees(spark):
    tree = even_tree()
    heavier = [Shard(s.region, s.rack, s.shard, 2.0 if s.shard == 5 else s.weight) for s in tree]
    where = {s.shard: s for s in tree}
    for a, b in zip(shards(spark, tree), shards(spark, heavier)):
        if a != b:
            # Into the heavier shard's region, or within it into its rack, or into the shard itself.
            assert where[b].region == 0
            assert where[a].region != 0 or where[b].rack == where[5].rack
            assert where[a].rack != where[5].rack or b == 5


def test_weights_set_the_shares(spark):
    count = Counter(shards(spark, [Shard(0, 0, 0, 3.0), Shard(0, 1, 1, 1.0), Shard(1, 2, 2, 0.0)]))
    assert set(count) == {0, 1} and 2.7 < count[0] / count[1] < 3.3
