"""Every registered query of the ledger against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyframe.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return str(v) if not isinstance(v, (int, bool, type(None))) else v


def compare(df, rel):
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    ours = sorted(repr([cell(r[c]) for c in order]) for r in df.collect())
    at = [rel.columns.index(c) for c in order]
    assert ours == sorted(repr([cell(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, db, name):
    compare(QUERIES[name](spark, DATA), db.sql(ORACLES[name]))


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
