import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stratavox.llm import jaccard
from tests.conftest import SF, SF2


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc_id, n_shingles, component_id by comparing all pairs of distinct sets that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    distinct = list({s for _, s in sets if s})
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for k, s in enumerate(distinct):
        for j in {j for x in s for j in at[x]}:
            both = len(s & distinct[j])
            if 100 * both >= 80 * (len(s) + len(distinct[j]) - both):
                parent[find(k)] = find(j)
        for x in s:
            at[x].append(k)
    number = {s: find(k) for k, s in enumerate(distinct)}
    least = {}
    for i, s in sets:
        if s and i is not None:
            least[number[s]] = min(i, least.get(number[s], i))
    return sorted(((i, len(s), least.get(number[s]) if s else i) for i, s in sets), key=str)


def check(df, rows):
    got = sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)
    return got


def test_query_matches_brute_force(spark):
    for sf in (SF, SF2):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        got = check(jaccard.op4_jaccard_join(spark, sf), rows)
        assert any(i != c for i, _, c in got)


def test_odd_rows(spark, odd_docs):
    check(jaccard.join(odd_docs), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert jaccard.join(odd_docs.limit(0)).count() == 0


def crowd(words, seed, n, size, edits):
    """Copies of one text with random edits, chains, passages that many share, and strangers."""
    rng = random.Random(seed)
    base = [rng.choice(words) for _ in range(size)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append(" ".join(w))
    chain = [rng.choice(words) for _ in range(80)]
    for _ in range(15):
        chain[rng.randrange(80)] = rng.choice(words)
        chain[rng.randrange(80)] = rng.choice(words)
        rows.append(" ".join(chain))
    for _ in range(40):
        own = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append(" ".join(passage + own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "size", "edits"), [(1, 150, 6), (2, 150, 12), (3, 40, 2), (4, 400, 20)])
def test_crowds(spark, words, seed, size, edits):
    rows = crowd(words, seed, 120, size, edits)
    check(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_crowds_under_other_parameters(spark, words, monkeypatch):
    """Few rare tokens, small blocks, all rounds: the same components."""
    rows = crowd(words, 9, 150, 120, 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("FREQUENT", 2), ("BLOCK", 16), ("BLOCK_TOKENS", 300), ("FEW_PAIRS", 0), ("ROUNDS", 2), ("BUCKET_ENTRIES", 500)):
        monkeypatch.setattr(jaccard, name, value)
    check(jaccard.join(docs), rows)


def test_signatures_meet_for_every_linked_pair(words):
    """Linked sets share an index key, whatever their sizes and however frequent their tokens."""
    import numpy as np

    rng = np.random.default_rng(0)
    for n in [*range(4, 40), 90, 300, 1000]:
        for _ in range(20):
            a = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
            m = int(rng.integers(-(-4 * n // 5), n + 1))
            extra = rng.choice(1 << 40, int(rng.integers(0, n // 4 + 1)), replace=False).astype(np.uint64)
            b = np.unique(np.concatenate([rng.choice(a, m, replace=False), extra]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or n == both == len(b):
                continue
            df = {int(t): int(rng.integers(2, 30)) for t in np.union1d(a, b)}
            keys = []
            for s in (a, b):
                own = rng.permutation(np.setdiff1d(s, np.intersect1d(a, b)))
                alone = set(own[: len(own) // 2].tolist())
                shared = sorted((t for t in s.tolist() if t not in alone), key=lambda t: (df[t], t))
                rare = sum(df[t] < jaccard.FREQUENT for t in shared)
                keys.append(set(jaccard.signatures(len(s), rare, np.array(shared, dtype=np.uint64)).tolist()))
            assert keys[0] & keys[1], (n, len(b), both)


def test_keep_one(spark, odd_docs):
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    parts = brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    want = {i for i, _, c in parts if i is not None and i == c}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert [r.doc_id for r in jaccard.keep_one(twice).collect()] == [1]


def threshold_pairs(top, repeats, seed):
    """Two texts for every two sizes up to ``top`` that just reach 80 %, no others alike."""
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.getrandbits(60):x}"
    for n in range(4, top + 1):
        for m in range(n, n * 5 // 4 + 1):
            both = -(-4 * (n + m) // 9)
            if both > n or both == n == m:
                continue
            for _ in range(repeats):
                common = [word() for _ in range(both + 4)]
                for size in (n, m):
                    rows.append(" ".join(common + [word() for _ in range(size - both)]))
    return list(enumerate(rows))


def test_every_two_sizes_link_at_the_threshold(spark):
    """The first look must not drop a set, whichever of its partner's tokens come first in hash order."""
    rows = threshold_pairs(48, 6, 11)
    got = check(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    assert all(c == i - i % 2 for i, _, c in got)


def test_first_looks_meet_in_the_worst_order(spark):
    """For all sizes and all that may be linked: tokens of one set only come first in both looks."""
    import numpy as np
    from pyspark.sql import functions as F

    top = 600
    n = F.col("n")
    look = {k: int(jaccard.first_look(np.int64(k))) for k in range(1, 2 * top)}
    sizes = spark.createDataFrame([(k, look[k]) for k in range(1, top + 1)], "n long, look long")
    least = {r.n: r.least for r in sizes.select("n", jaccard.least_met(n, F.col("look")).alias("least")).collect()}
    for k in range(1, top + 1):
        for m in range(-(-4 * k // 5), 5 * k // 4 + 1):
            both = -(-4 * (k + m) // 9)
            if both <= min(k, m):
                assert least[k] <= min(look[k] - (k - both), look[m] - (m - both)), (k, m)


def test_a_filter_follows_the_number_of_keys(spark):
    import numpy as np

    from stratavox.llm import filters

    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    bits = filters.bitmap(keys, "h", 3000)
    assert len(bits) << 6 == 1 << 16 and filters.filter_bits(10**6) == 24 and filters.filter_bits(10**12) == 30
    held = np.array([r.h for r in keys.collect()], dtype=np.int64)
    other = np.array([r.h for r in spark.range(10_000, 20_000).select(F.xxhash64("id").alias("h")).collect()], dtype=np.int64)
    assert filters.holds(bits, held).all() and filters.holds(bits, other).mean() < 0.1
    shared = filters.key_filter(keys, "h", 3000)
    assert spark.range(3000).where(filters.may_hold(shared, F.xxhash64("id"))).count() == 3000


def test_long_near_copies(spark, words):
    """Long texts, each a near copy of another, in blocks bounded by tokens."""
    rng = random.Random(8)
    base = [rng.choice(words) for _ in range(20_000)]
    rows = []
    for k in range(12):
        copy = list(base)
        copy[100 * k] = "other"
        rows.append((k, " ".join(copy)))
    rows.append((99, " ".join(rng.choice(words) for _ in range(300_000))))
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict.fromkeys(range(12), 0), 99: 99}
