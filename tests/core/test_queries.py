import os

import duckdb
import pytest

import __spark_entry__
from stratavox.plans.catalog import ORACLES, QUERIES
from tests.conftest import SF, SF2

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(folder):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, name):
    for folder in (SF, SF2):
        df = QUERIES[name](spark, folder)
        rel = views(folder).sql(ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        columns = sorted(df.columns)
        got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
        assert got == sorted(map(repr, rel.select(*columns).fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
