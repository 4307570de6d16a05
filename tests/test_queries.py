"""Registered queries against their SQL at the smallest scale."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from regionflow.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "customer", "events", "documents", "pages", "conversations")
@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(same(r[c]) for c in cols) for r in df.collect())
    cur = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(tuple(same(r[i]) for i in at) for r in cur.fetchall())
    assert got


def test_registered_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert ("op1_packing" in entry.queries()) == (entry.llm_queries is not None)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
