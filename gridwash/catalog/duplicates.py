"""Duplicate rows."""

from gridwash.catalog.registry import Tables, query
from gridwash.operators import duplicates as ops


@query("d1_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_suppkey FROM lineitem")
def d1(t: Tables):
    return ops.distinct_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"))


@query("d2_distinct_on", """
SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders
ORDER BY o_custkey, o_orderdate, o_orderkey""")
def d2(t: Tables):
    return ops.first_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_totalprice")


@query("d3_dedupe_keep_first", """
SELECT doc_id, text, lang, source FROM (
  SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents) d WHERE rn = 1""")
def d3(t: Tables):
    return ops.keep_first(t.documents, ["doc_id"], ["text", "lang"]).select("doc_id", "text", "lang", "source")


@query("d3_dedupe_whole_row", """
SELECT MIN(doc_id) AS doc_id, lang, source FROM (
  SELECT doc_id, COALESCE(NULLIF(lang, 'fr'), '') AS lang, source FROM documents) d GROUP BY lang, source""")
def d3_whole(t: Tables):
    """NULL counts as empty text; here every French row has NULL or empty text by turns."""
    df = t.documents.selectExpr(
        "doc_id", "CASE WHEN lang = 'fr' THEN CASE WHEN doc_id % 2 = 0 THEN '' END ELSE lang END AS lang", "source")
    return ops.keep_first(df, ["doc_id"]).selectExpr("doc_id", "coalesce(lang, '') AS lang", "source")


@query("d4_dedupe_report", """
SELECT COUNT(DISTINCT (text, lang)) AS kept, COUNT(*) - COUNT(DISTINCT (text, lang)) AS removed FROM documents""")
def d4(t: Tables):
    return ops.duplicate_report(t.documents, ["text", "lang"])


@query("d5_duplicate_row_count", """
SELECT (SELECT COUNT(*) FROM documents) - (SELECT COUNT(*) FROM (
  SELECT DISTINCT text, lang, NULLIF(source, 'src1') AS source FROM documents) d) AS duplicate_rows""")
def d5(t: Tables):
    return ops.duplicate_row_count(t.documents.selectExpr("text", "lang", "nullif(source, 'src1') AS source"))
