import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pytest

from stratavox.llm import labelled, quality, toxicity
from tests.conftest import SF, SF2


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    p = labels == 1
    return (rank[p].mean() - (p.sum() - 1) / 2) / (~p).sum()


def held_out(spark, query, column, sf, lang=None):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    part = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels and lang in (None, docs[r.doc_id])]
    return np.array(part), rows


def test_quality_on_held_out_rows(spark):
    part, rows = held_out(spark, quality.op10_quality, "quality", SF2)
    assert auc(part[:, 0], part[:, 1]) > 0.95 and (part[:, 1] == part[:, 2]).mean() > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_on_held_out_rows(spark):
    # Some 300 toxic documents train here; in languages other than English they have no word in common.
    part, rows = held_out(spark, toxicity.op5_toxicity, "toxic", "/root/testdata/sf0.1", "en")
    assert auc(part[:, 0], part[:, 1]) > 0.9
    clean = part[part[:, 1] == 0]
    assert clean[:, 2].mean() < 0.01
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, odd_docs, module):
    labels = spark.createDataFrame([(k % 18, k % 2, k % 2, None) for k in range(40)] + [(None, 1, 1, None), (3, None, None, None)], "doc_id long, quality int, toxic int, y string")
    out = module.score(odd_docs, labels)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    again = {r.doc_id: r.score for r in out.collect()}
    assert all(again[r.doc_id] == r.score for r in rows if r.doc_id not in (None, 13))
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert len({r.score for r in module.score(odd_docs, none).where("doc_id < 8").collect()}) >= 1
    assert module.score(odd_docs.limit(0), labels).count() == 0
    assert module.clean(odd_docs, labels, 0.5).columns == odd_docs.columns


@pytest.mark.parametrize("module", [quality, toxicity])
def test_held_out_labels_do_not_matter(spark, module):
    """Turning the labels of the held-out fold changes no score; nor do lang, source and doc order."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    before = {r.doc_id: r.score for r in module.score(docs, labels).collect()}
    out = labelled.fold("doc_id", module.PARTS) == module.HELD_OUT
    from pyspark.sql import functions as F

    turned = labels.withColumns({c: F.when(out, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    mixed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}).orderBy("text")
    after = {r.doc_id: r.score for r in module.score(mixed, turned).collect()}
    assert before.keys() == after.keys() and all(abs(before[k] - after[k]) < 1e-9 for k in before)


def test_sample_is_bounded_and_outside_the_fold(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    ids = [r.doc_id for r in labelled.label_sample(labels.union(labels), "quality", 5, 0, 1000).collect()]
    assert 850 < len(ids) < 1150 and len(set(ids)) == len(ids)
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_trees_against_a_walk_node_by_node():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.grow(x, y)
    assert auc(forest.score(x), y) > 0.99 and len(forest.roots) == quality.TREES
    for row in x[:50]:
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.cut[node] else forest.right[node]
            total += forest.value[node]
        assert abs(labelled.sigmoid(np.array([total]))[0] - forest.score(row[None])[0]) < 1e-12


def test_statistics_by_hand():
    import pyarrow as pa

    (got,) = (quality.statistics(r, o) for _, _, r, o in quality.slices(pa.array(["Ab ab | ab!\nX1", "", None])))
    row = got[0]
    size = len("Ab ab | ab!\nX1")
    assert row[quality._UPPER] == 2 / size and row[quality._BAR] == 1 / size and row[quality._NEWLINE] == 1 / size
    assert row[quality._KINDS + 1] == np.log1p(5) and row[quality._KINDS + 4] == 4 / 5 and row[quality._KINDS + 5] == 2 / 5
    assert not got[1].any() and not got[2].any()


def test_windows_cover_all_words():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join("w" * rng.randint(1, 5) for _ in range(n)) for n in (*range(25), 500)]
    for i, j, raw, off in toxicity.slices(pa.array(texts)):
        start, size, n = toxicity._windows(raw, off)
        doc = np.repeat(np.arange(j - i), n)
        for k in range(j - i):
            covered = np.zeros(off[k + 1] - off[k], dtype=bool)
            for a, s in zip(start[doc == k] - off[k], size[doc == k]):
                covered[a : a + s] = True
            assert all(covered[m] for m, c in enumerate(texts[i + k]) if c != " ")
            assert (n[k] == 0) == (not texts[i + k])


def test_a_planted_passage_is_found_wherever_it_is():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    bad = ["zurkwitz", "vexpuddle", "qwistrag"]

    def text(n, toxic):
        w = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(toxic):
            w[rng.randrange(n)] = rng.choice(bad)
        return " ".join(w)

    rows = [(i, text(120, 3 * (i % 4 == 0)), int(i % 4 == 0)) for i in range(800)]
    model = toxicity.train(rows)
    import pyarrow as pa

    score = toxicity.scorer(SimpleNamespace(value=model))
    tests = [text(3000, 0) for _ in range(40)] + [text(3000, 3) for _ in range(40)]
    s = score(pa.array(tests))
    assert s[:40].max() < 0.5 and np.median(s[40:]) > 0.7


def plain_scores(texts, model):
    """Window by window and document by document."""
    pair = model.compressors()
    for t in texts:
        b = bytes(toxicity._FOLDED[np.frombuffer((t or "").encode(), np.uint8)])
        words = [m.span() for m in re.finditer(rb"[^ ]+", b)]
        gains, i = [], 0
        while i == 0 and words or i + toxicity.WINDOW - toxicity.STRIDE < len(words):
            part = words[i : i + toxicity.WINDOW]
            w = b[max(part[0][0] - 1, 0) : part[-1][1]]
            gains.append(len(pair[0].compress(w)) - len(pair[1].compress(w)))
            i += toxicity.STRIDE
        best = (sorted((max(g, 0) for g in gains), reverse=True) + [0, 0, 0])[:3]
        x = np.array([*best, np.log1p(sum(g >= 5 for g in gains)), np.log1p(len(gains))])
        yield float(labelled.sigmoid(x @ model.weights[:-1] + model.weights[-1]))


def test_toxicity_scores_equal_brute_force(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    train = [(r.doc_id, r.text, labels[r.doc_id]) for r in spark.read.parquet(f"{SF2}/documents.parquet").collect() if r.doc_id in labels]
    model = toxicity.train(train)
    texts = [t for _, t in docs[:120]] + [None, "", " \n", "one", "a b c d e f", "a b c d e f g", "Ünï " * 3000]
    monkeypatch.setattr(toxicity, "_AT_ONCE", 37)
    import pyarrow as pa

    got = toxicity.scorer(SimpleNamespace(value=model))(pa.array(texts, pa.string()))
    assert got.tolist() == pytest.approx(list(plain_scores(texts, model)), abs=1e-12)


def test_statistics_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["Ab ab | ab!\nX1 " * 30, "", "zz top " * 50, "one"]
    (whole,) = (quality.statistics(r, o) for _, _, r, o in quality.slices(pa.array(texts)))
    monkeypatch.setattr(quality, "SLICE_BYTES", 7)
    (pieces,) = (quality.statistics(r, o) for _, _, r, o in quality.slices(pa.array(texts)))
    alone = [quality.statistics(r, o)[0] for t in texts for _, _, r, o in quality.slices(pa.array([t]))]
    assert np.allclose(whole, pieces) and np.allclose(whole, np.array(alone))


def test_a_long_labelled_text_takes_part(spark):
    rows = [(i, ("zurk witz " if i % 2 else "fine day ") * (60_000 if i == 3 else 20), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[2]) for r in rows], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, labels).where("doc_id = 3").count() == 1


def plain_statistics(text):
    """The statistics of a document, one by one."""
    b = (text or "").encode()
    if not b:
        return np.zeros(quality.STATISTICS)
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    kinds = [0] * quality._KINDS
    for c in b:
        kinds[quality._KIND[c]] += 1
    words, folded = (re.findall(rb"[^\x20\x09-\x0D]+", x) for x in (b, low))
    n = max(len(words), 1)
    sizes = [len(x) for x in words]
    grams = [tuple(folded[i : i + 3]) for i in range(len(words) - 2)]
    most = lambda x: max((x.count(v) for v in set(x)), default=0)
    mean = sum(sizes) / n
    return np.array(
        [*(k / len(b) for k in kinds), np.log1p(len(b)), np.log1p(len(words)), mean, np.sqrt(max(0, sum(x * x for x in sizes) / n - mean**2)), len(set(folded)) / n, most(folded) / n]
        + [len(set(grams)) / max(len(grams), 1), most(grams) / max(len(grams), 1), sum(65 <= x[0] <= 90 for x in words) / n, sum(quality._KIND[x[-1]] >= quality._STOP for x in words) / n]
        + [np.log1p(len(b) / (kinds[quality._NEWLINE] + 1))]
    )


def test_quality_query_equals_brute_force(spark):
    """Every score by a walk over every tree from statistics counted one by one."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.op10_quality(spark, SF).collect()}
    rows = [r for r in docs.collect() if len(r.text or "") < 20_000]
    for r in rows:
        x, total = plain_statistics(r.text), forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if x[forest.feature[node]] <= forest.cut[node] else forest.right[node]
            total += forest.value[node]
        assert got[r.doc_id] == pytest.approx(float(labelled.sigmoid(np.array([total]))[0]), abs=1e-9)
    assert len(rows) > 100
