"""Every query against its SQL in another engine, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from veritally.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def test_registry():
    assert set(entry.queries()) >= set(queries.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 40


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, other, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    want = other.sql(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)
    assert [str(got[c].dtype) for c in columns] == [str(want[c].dtype) for c in columns] or got.empty


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert df.schema == queries.QUERIES[name](spark, SMALL).schema
    df.collect()
