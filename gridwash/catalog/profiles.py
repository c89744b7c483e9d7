"""Profiles and data-quality findings."""

from pyspark.sql import functions as F

from gridwash.catalog.cells import DIRTY_ORDERS, dirty_orders
from gridwash.catalog.registry import Tables, query
from gridwash.operators import profile as ops
from gridwash.plans.steps import Step, replay

CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
            "c_mktsegment": "string"}
ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderpriority": "string", "o_orderstatus": "string"}


def _profile_sql(source: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS name, '{k}' AS dtype,
  CAST(ROUND(100.0 * COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*), 1) AS DOUBLE) AS null_pct,
  COUNT(DISTINCT {c}) AS unique_count,
  (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM ({source}) i
     WHERE {c} IS NOT NULL ORDER BY v LIMIT 5) s) AS samples
FROM ({source}) d""" for c, k in columns.items())


def _profiled(df):
    return ops.profile(df).select("name", "dtype", "null_pct", "unique_count",
                                  F.array_join("sample_values", "|").alias("samples"))


@query("f1_profile", _profile_sql("SELECT * FROM customer", CUSTOMER))
def f1(t: Tables):
    return _profiled(t.customer)


@query("f1_profile_nulls", _profile_sql(DIRTY_ORDERS, ORDERS))
def f1_nulls(t: Tables):
    return _profiled(dirty_orders(t).drop("o_totalprice"))


@query("f1_profile_approx", """
SELECT 'event_type' AS name, 'string' AS dtype, CAST(0 AS DOUBLE) AS null_pct, COUNT(DISTINCT event_type) AS unique_count
FROM events""")
def f1_approx(t: Tables):
    return ops.profile(t.events.select("event_type"), approx=True).drop("position")


@query("f2_sample_values", " UNION ALL ".join(f"""
SELECT '{c}' AS name, row_number() OVER (ORDER BY v) AS rn, v AS value FROM (
  SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM customer) s QUALIFY rn <= 5""" for c in CUSTOMER))
def f2(t: Tables):
    return ops.sample_values(t.customer)


@query("f3_sample_rows", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority,
       o_orderstatus FROM ({DIRTY_ORDERS}) d ORDER BY d.o_orderkey LIMIT 5""")
def f3(t: Tables):
    return ops.sample_rows(dirty_orders(t).drop("o_totalprice"), ["o_orderkey"], 5)


def _null_sql(source: str, columns) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count,
  CAST(ROUND(100.0 * COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*), 1) AS DOUBLE) AS null_pct
FROM ({source}) d HAVING COUNT(*) FILTER (WHERE {c} IS NULL) > 0""" for c in columns)


@query("f4_null_columns", _null_sql(DIRTY_ORDERS, [*ORDERS, "o_totalprice"]))
def f4(t: Tables):
    return ops.null_columns(dirty_orders(t))


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("f5_numeric_stats", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max,
  ROUND(AVG({c}), 2) AS avg, ROUND(CAST(MEDIAN({c}) AS DOUBLE), 2) AS median FROM lineitem""" for c in NUMBERS))
def f5(t: Tables):
    return ops.numeric_stats(t.lineitem)


SPARSE = """SELECT lang, source, NULLIF(source, 'src0') AS a, CASE WHEN n_chars % 2 = 0 THEN lang END AS b,
  CASE WHEN n_chars % 3 = 0 THEN lang END AS c, CASE WHEN n_chars % 5 = 0 THEN lang END AS d FROM documents"""
SPARSE_SPARK = ["lang", "source", "nullif(source, 'src0') AS a", "CASE WHEN n_chars % 2 = 0 THEN lang END AS b",
                "CASE WHEN n_chars % 3 = 0 THEN lang END AS c", "CASE WHEN n_chars % 5 = 0 THEN lang END AS d"]


@query("f6_suggestions", f"""
WITH d AS ({SPARSE}), n AS (
  SELECT 1 AS pos, 'a' AS col, CAST(ROUND(100.0 * COUNT(*) FILTER (WHERE a IS NULL) / COUNT(*), 1) AS DOUBLE) AS pct FROM d
  UNION ALL SELECT 2, 'b', CAST(ROUND(100.0 * COUNT(*) FILTER (WHERE b IS NULL) / COUNT(*), 1) AS DOUBLE) FROM d
  UNION ALL SELECT 3, 'c', CAST(ROUND(100.0 * COUNT(*) FILTER (WHERE c IS NULL) / COUNT(*), 1) AS DOUBLE) FROM d
  UNION ALL SELECT 4, 'd', CAST(ROUND(100.0 * COUNT(*) FILTER (WHERE d IS NULL) / COUNT(*), 1) AS DOUBLE) FROM d),
h AS (SELECT row_number() OVER (ORDER BY pos) AS rank, col, pct FROM n WHERE pct > 10),
c AS (SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM d) x) AS dups FROM d)
SELECT CAST(0 AS BIGINT) AS rank, 'Remove ' || dups || ' duplicate row' || CASE WHEN dups = 1 THEN '' ELSE 's' END AS text,
       'remove duplicate rows' AS instruction FROM c WHERE dups > 0
UNION ALL
SELECT rank, 'Column ''' || col || ''' has ' || pct || '% null values', 'drop rows where ' || col || ' is null'
FROM h WHERE rank <= 3""")
def f6(t: Tables):
    return ops.suggestions(t.documents.selectExpr(*SPARSE_SPARK), most_columns=3)


@query("f7_most_null_column", f"""
SELECT * FROM ({_null_sql(SPARSE, ['a', 'b', 'c', 'd'])}) n ORDER BY null_count DESC, "column" LIMIT 1""")
def f7(t: Tables):
    return ops.most_null_column(t.documents.selectExpr(*SPARSE_SPARK))


@query("f8_insights_after_steps", _null_sql(
    f"SELECT * FROM ({DIRTY_ORDERS}) q WHERE o_orderstatus = 'O' AND o_orderpriority IS NOT NULL",
    [*ORDERS, "o_totalprice"]))
def f8(t: Tables):
    steps = [Step("filter", {"where": "o_orderstatus = 'O'"}), Step("dropna", {"columns": ["o_orderpriority"]})]
    return ops.insights(replay(dirty_orders(t), steps))["null_columns"]


def _card(privacy: bool) -> str:
    tail = "" if privacy else " || CASE WHEN samples IS NULL THEN '' ELSE ', e.g.: ' || replace(samples, '|', ', ') END"
    return f"""SELECT '  - ' || name || ' (' || dtype || ') — ' || null_pct || '% nulls, ' || unique_count
        || ' unique values'{tail} AS line FROM ({_profile_sql("SELECT * FROM customer", CUSTOMER)}) p"""


@query("f10_schema_card", _card(privacy=False))
def f10(t: Tables):
    return ops.schema_card(t.customer).select("line")


@query("f10_schema_card_private", _card(privacy=True))
def f10_private(t: Tables):
    return ops.schema_card(t.customer, privacy=True).select("line")


@query("f10_sample_lines", f"""
SELECT '  o_orderkey=' || o_orderkey || ', o_custkey=' || o_custkey || ', o_orderpriority='
       || COALESCE(o_orderpriority, 'None') || ', o_orderstatus=' || o_orderstatus AS line
FROM ({DIRTY_ORDERS}) d ORDER BY o_orderkey LIMIT 3""")
def f10_lines(t: Tables):
    return ops.sample_lines(dirty_orders(t).drop("o_totalprice"), ["o_orderkey"])


@query("f11_preview_totals", """
SELECT COUNT(*) AS total_rows, CAST(5 AS BIGINT) AS total_columns FROM orders WHERE o_totalprice > 100000""")
def f11(t: Tables):
    _, totals = ops.preview(dirty_orders(t).join(
        t.orders.filter("o_totalprice > 100000").select("o_orderkey"), "o_orderkey", "left_semi"))
    return totals.withColumn("total_columns", F.col("total_columns").cast("bigint"))


_STEPPED = f"SELECT * FROM ({DIRTY_ORDERS}) q WHERE o_orderstatus = 'O' AND o_orderpriority IS NOT NULL"


@query("f8_all_findings", f"""
WITH d AS ({_STEPPED}),
n AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls, COUNT(*) AS n FROM d" for c in [*ORDERS, "o_totalprice"])}),
s AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, MIN({c})::DOUBLE AS lo, MAX({c})::DOUBLE AS hi, ROUND(AVG({c}), 2) AS av, ROUND(MEDIAN({c}), 2) AS md FROM d"
                          for c in ("o_orderkey", "o_custkey", "o_totalprice"))})
SELECT 'row_count' AS finding, CAST(NULL AS VARCHAR) AS "column", CAST(COUNT(*) AS DOUBLE) AS value FROM d
UNION ALL SELECT 'column_count', NULL, 5.0
UNION ALL SELECT 'duplicate_rows', NULL, (SELECT COUNT(*) FROM d) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM d) x)
UNION ALL SELECT 'null_count', c, nulls FROM n WHERE nulls > 0
UNION ALL SELECT 'null_pct', c, ROUND(100.0 * CAST(nulls AS DOUBLE) / n, 1) FROM n WHERE nulls > 0
UNION ALL SELECT 'min', c, lo FROM s UNION ALL SELECT 'max', c, hi FROM s
UNION ALL SELECT 'avg', c, av FROM s UNION ALL SELECT 'median', c, md FROM s""")
def f8_all(t: Tables):
    steps = [Step("filter", {"where": "o_orderstatus = 'O'"}), Step("dropna", {"columns": ["o_orderpriority"]})]
    return ops.findings(replay(dirty_orders(t), steps))


@query("f11_preview_rows", """
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place
FROM orders WHERE o_totalprice > 100000 ORDER BY place LIMIT 50""")
def f11_rows(t: Tables):
    """The rows shown, with the place at which they are shown."""
    shown, _ = ops.preview(t.orders.filter("o_totalprice > 100000").select("o_orderkey", "o_totalprice"), 50,
                           [("o_totalprice", "desc"), "o_orderkey"])
    # At most 50 rows, numbered as they come.
    return shown.withColumn("place", F.monotonically_increasing_id() + 1)
