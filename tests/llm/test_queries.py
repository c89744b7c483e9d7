"""Registered queries against their SQL, and what must hold for all of them."""

import math

import duckdb
import pytest

from gridwash.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    return repr(v) if isinstance(v, float) else str(v)


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(name, spark):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    df = QUERIES[name](spark, SMALL)
    cur = db.execute(ORACLES[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(
        [d[0] for d in cur.description], cur.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_mixing", "op2_pii"])
def test_native_queries_run_no_python(name, spark):
    text = QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
    for word in ("Python", "Pandas", "Arrow"):
        assert word not in text
