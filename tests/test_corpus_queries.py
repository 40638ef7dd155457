"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from mailtriage.plans import corpus_queries, finding_queries, intake_queries, mail_queries, name_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES = corpus_queries.QUERIES | mail_queries.QUERIES | intake_queries.QUERIES | finding_queries.QUERIES | name_queries.QUERIES
ORACLE_SQL = corpus_queries.ORACLE_SQL | mail_queries.ORACLE_SQL | intake_queries.ORACLE_SQL | finding_queries.ORACLE_SQL | name_queries.ORACLE_SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the corpus tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
