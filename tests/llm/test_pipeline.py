import re

import corpus_pipeline
from stratavox.llm import quality, toxicity
from stratavox.llm.store import materialize
from tests.conftest import SF2
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as components


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF2}/benchmark.parquet").collect()]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            want = {r.doc_id for r in quality.score(docs, labels).collect() if r.score >= quality.THRESHOLD}
        elif name == "toxicity":
            want = {r.doc_id for r in toxicity.score(docs, labels).collect() if r.score < toxicity.THRESHOLD}
        elif name == "dedup":
            want = {i for i, _, c in components(list(before.items())) if i == c}
        out = materialize(stage(spark, docs, SF2), name)
        if name == "packing":
            sizes = {}
            for r in out.collect():
                sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.size
            assert sizes == {i: len(t.encode().split()) for i, t in before.items()}
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "decontamination":
            hits = {r[0]: r for r in contaminated(before.items(), items)}
            assert all(after.get(i) == t for i, t in before.items() if not hits[i][5])
            assert set(before) - set(after) == {i for i, r in hits.items() if r[5] and r[2] >= 0.5 * r[1]}
            assert not any(r[5] for r in contaminated(after.items(), items))
            for i in after:
                if hits[i][5]:
                    assert len(re.findall(r"\S+", after[i])) <= len(re.findall(r"\S+", before[i]))
        else:
            assert after == {i: before[i] for i in want}
            held[name] = len(before) - len(after)
        docs = out
    assert all(held.values())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "bin_id", "size"} <= set(out.columns) and out.count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def folder_of(path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_odd_and_empty_tables(spark, odd_docs, tmp_path):
    """Null ids, texts and labels, very long texts, repeated rows, clashing columns; then no rows at all."""
    labels = spark.createDataFrame([(k % 18, int(k % 5 > 0), int(k % 7 == 0), "x") for k in range(60)] + [(None, 1, 1, None), (3, None, None, None)], "doc_id long, quality int, toxic int, text string")
    benchmark = spark.createDataFrame([(1, "only these words"), (None, "a b c"), (2, None)], "item_id long, text string")
    docs, sf_dir = odd_docs, folder_of(tmp_path / "odd", documents=odd_docs, labels=labels, benchmark=benchmark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        docs = kept
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    none = folder_of(tmp_path / "none", documents=odd_docs.limit(0), labels=labels.limit(0), benchmark=benchmark.limit(0))
    assert corpus_pipeline.run(spark, none).count() == 0
    unlabelled = folder_of(tmp_path / "unlabelled", documents=odd_docs, labels=labels.limit(0), benchmark=benchmark.limit(0))
    assert corpus_pipeline.run(spark, unlabelled).count() > 0
