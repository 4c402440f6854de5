import math
import os

import numpy as np
import pytest

from stratavox.llm import vectors
from tests.conftest import SF, SF2


def brute(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) over all pairs."""
    usable = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(rows[i][1]) for i in usable), default=0)
    x = np.array([list(rows[i][1]) + [0.0] * (width - len(rows[i][1])) for i in usable], dtype=float).reshape(len(usable), width)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    parent = {i: i for i in range(len(rows))}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(rows)
    for a in range(len(usable)):
        for b in range(len(usable)):
            if a != b and (near[a, b] or rows[usable[a]][1] == rows[usable[b]][1]):
                links[usable[a]] += 1
                parent[find(usable[a])] = find(usable[b])
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, links[i], least.get(find(i)), (k is not None and k == least.get(find(i))) or i not in usable) for i, (k, _) in enumerate(rows)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_query_against_all_pairs(spark):
    for sf in (SF, SF2):
        rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        assert rows_of(vectors.op2_vectors(spark, sf)) == brute(rows)


def test_recall_with_many_cells(spark, monkeypatch):
    """Small cells and blocks: recall of links against all pairs."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(600, 64))
    near = base[:200] + rng.normal(size=(200, 64)) * rng.uniform(0.05, 0.32, (200, 1))
    crowd = base[0] + rng.normal(size=(150, 64)) * 0.15
    data = np.concatenate([base, near, crowd, crowd[:30]]).tolist()
    rows = list(enumerate(data))
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    got = rows_of(vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    want = brute(rows)
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.97 * all_links <= found <= all_links
    assert all(a[1] <= b[1] for a, b in zip(got, want))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]),
        (8, [inf, 0.0, 0.0]), (9, [1.0, None, 0.0]), (10, [0.0, 1.0]), (11, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.01]), (12, [1e-300, 0.0, 0.0]), (13, [-1.0, 0.0, 0.0]),
        (13, [0.0, 0.0, 1.0]), (14, [0.0, 0.0, 1.0]), (15, [0.95, math.sqrt(1 - 0.95**2) + 1e-9, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, id int, cell int")
    assert rows_of(vectors.near(df)) == brute(rows)
    assert vectors.near(df.limit(0)).count() == 0
    assert vectors.near(df.where("vec_id = 4")).collect()[0].kept


def test_recall_on_the_check_tables(spark):
    """Links over tens of cells, against all pairs in double precision; the README states the figures."""
    path = "/root/testdata/check_s/embeddings.parquet"
    if not os.path.isdir(path):
        pytest.skip("no check tables")
    df = spark.read.parquet(path)
    rows = df.select("vec_id", "embedding").toPandas()
    sound = [i for i, v in enumerate(rows.embedding) if v is not None and np.isfinite(v).all() and np.any(v)]
    x = np.array([rows.embedding[i] for i in sound], dtype=float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    want = dict.fromkeys(rows.vec_id, 0)
    for a in range(0, len(x), 1000):
        n = (x[a : a + 1000] @ x.T >= 0.95).sum(1) - 1
        want.update(zip(rows.vec_id[sound[a : a + 1000]], n, strict=True))
    got = {r.vec_id: r.n_links for r in vectors.near(df).collect()}
    assert len(got) == len(want) and all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.999 * sum(want.values())


def test_least_linked():
    a, b = np.array([5, 1, 7, 3]), np.array([1, 6, 3, 7])
    assert vectors._least_linked(8, a, b).tolist() == [0, 1, 2, 3, 4, 1, 1, 3]
    chain = np.arange(999)
    assert not vectors._least_linked(1000, chain[::-1] + 1, chain[::-1]).any()
