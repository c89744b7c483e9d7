"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest
from conftest import SMALL, plan

from __spark_entry__ import entry, queries
from gridwash.catalog import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    return repr(v) if isinstance(v, float) else str(v)


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(name, spark, db):
    df = QUERIES[name](spark, SMALL)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(ORACLES[name])
    assert got == canonical([d[0] for d in cur.description], cur.fetchall())
    text = plan(df)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(queries())


def test_entry(spark):
    assert [r.region for r in entry(spark).orderBy("region").collect()] == [
        "Africa", "America", "Asia", "Europe", "Middle East"]
