"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridwash.catalog.registry import Query, Tables

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name."""
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


from gridwash.llm import (  # noqa: E402, F401
    query_ann, query_bpe, query_clustering, query_fim, query_html, query_langid, query_lengths, query_mixing, query_pii,
    query_oddsketch, query_quality, query_simhash, query_topk)
