import hashlib
import random
import time
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from stratavox.llm.packing import Bins, op6_packing, pack
from tests.conftest import SF, SF2


def plain_best_fit(items, capacity, per_source):
    """Bin of each (size, source, cluster): the tightest of all open bins without conflict."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [
            (capacity - sum(s for s, _, _ in b), k)
            for k, b in enumerate(bins)
            if sum(s for s, _, _ in b) + size <= capacity and all(c != cluster for _, _, c in b) and sum(s == source for _, s, _ in b) < per_source
        ]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append([])
        bins[k].append((size, source, cluster))
        out.append(k)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10), st.integers(0, 3), st.integers(0, 6)), max_size=60), st.integers(1, 3))
def test_bins_are_best_fit(items, per_source):
    b = Bins(10, per_source)
    assert [b.put(*i) for i in items] == plain_best_fit(items, 10, per_source)


def check(rows, docs, capacity, per_source):
    """Every word is in one piece, bins hold no conflict and no more than fits."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.first_word, r.size))
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for i, versions in docs.items():
        want = Counter()
        for text, _ in versions:
            n = len((text or "").encode().split())
            want.update((k, min(capacity, n - k)) for k in range(0, n, capacity))
            want.update([(0, 0)] * (n == 0))
        assert Counter(pieces[i]) == want
    for b in bins.values():
        assert sum(r.size for r in b) + b[0].room == capacity and len({r.room for r in b}) == 1
        if all(len(docs[r.doc_id]) == 1 for r in b):
            assert max(Counter(docs[r.doc_id][0][1] for r in b).values()) <= per_source
            assert max(Counter("".join(c.lower() if c.isascii() else c for c in docs[r.doc_id][0][0]) for r in b).values()) == 1
    return bins


def test_query(spark):
    docs = defaultdict(list)
    for r in spark.read.parquet(f"{SF2}/documents.parquet").collect():
        docs[r.doc_id].append((r.text, r.source))
    bins = check(op6_packing(spark, SF2).collect(), docs, 2048, 4)
    fill = sum(sum(r.size for r in b) for b in bins.values()) / len(bins) / 2048
    assert fill > 0.9


def test_odd_rows(spark, odd_docs):
    docs = defaultdict(list)
    for r in odd_docs.collect():
        docs[r.doc_id].append((r.text, r.source))
    check(pack(odd_docs, 16, 2).collect(), docs, 16, 2)
    assert pack(odd_docs.limit(0)).count() == 0


def test_many_groups_and_a_hot_cluster(spark):
    rng = random.Random(4)
    docs = {i: [("same text here" if i % 3 == 0 else "w " * rng.randint(1, 30) + str(i), f"s{i % 2}")] for i in range(400)}
    df = spark.createDataFrame([(i, *v[0]) for i, v in docs.items()], "doc_id long, text string, source string")
    check(pack(df, 32, 3, group_rows=50).collect(), docs, 32, 3)


def test_bins_follow_from_the_rows_and_not_from_their_files(spark, odd_docs):
    ids = lambda df: Counter((r.doc_id, r.piece, r.size, r.bin_id, r.room) for r in pack(df, 16, 2, group_rows=20).collect())
    assert ids(odd_docs.repartition(1)) == ids(odd_docs.repartition(5, "text"))


def test_ids_of_text_and_a_given_cluster(spark):
    rows = [(f"d{i}", f"words of {i} here", "s", i // 2) for i in range(40)] + [("d0", "words of 0 here", "s", 0)] * 5 + [(None, "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, near int")
    out = pack(df, 64, 50, cluster="near").collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    bins = defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r.doc_id)
    for ids in bins.values():
        near = [int(i[1:]) // 2 for i in ids if i]
        assert len(near) == len(set(near))


def test_a_hot_cluster_or_source_is_passed_over_fast():
    for source, cluster in ((lambda i: i % 7, lambda i: 0), (lambda i: 0, lambda i: i)):
        b, began = Bins(1000, 2), time.time()
        for i in range(8192):
            b.put(1 + (8192 - i) // 100, source(i), cluster(i))
        assert time.time() - began < 4


def test_query_equals_plain_best_fit(spark):
    """The whole query by hand: pieces in order of size and document, each into the tightest bin without conflict."""
    rest, full, empty = [], [], []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = (r.text or "").encode()
        n, mark = len(text.split()), int.from_bytes(hashlib.blake2b(text.lower(), digest_size=8).digest(), "big", signed=True)
        empty += [(r.doc_id, 0, 0, 0)] * (n == 0)
        for piece, first in enumerate(range(0, n, 2048)):
            size = min(2048, n - first)
            (full if size == 2048 else rest).append((-size, r.doc_id, mark, r.source, piece, first))
    rest.sort()
    bins = plain_best_fit([(-s, source, mark) for s, _, mark, source, _, _ in rest], 2048, 4)
    want = {(i, piece, first, -s): f"group-0-{b}" for (s, i, _, _, piece, first), b in zip(rest, bins, strict=True)}
    out = op6_packing(spark, SF).collect()
    got = {(r.doc_id, r.piece, r.first_word, r.size): r.bin_id for r in out}
    assert len(out) == len(got) == len(rest) + len(full) + len(empty)
    assert {k: got[k] for k in want} == want and all(got[k] is None for k in empty)
    alone = [got[i, piece, first, 2048] for _, i, _, _, piece, first in full]
    assert len(set(alone)) == len(alone) and all(b.startswith("row-") for b in alone)
