"""Projection, filters, cell edits, aggregation and sorting."""

from pyspark.sql import functions as F

from gridwash.catalog.registry import Tables, query
from gridwash.operators import aggregates as agg
from gridwash.operators import cells as ops
from gridwash.operators import ordering
from gridwash.operators.segments import exact_median, row_index, row_numbers, running_total

DIRTY_ORDERS = """SELECT o_orderkey, o_custkey, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders"""


def dirty_orders(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey", "o_custkey", "nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice", "o_orderstatus")


@query("b1_select_columns", "SELECT c_name, c_mktsegment FROM customer")
def b1(t: Tables):
    return ops.select_columns(t.customer, ["c_name", "c_mktsegment"])


@query("b2_add_column", """
SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem""")
def b2(t: Tables):
    return ops.add_columns(t.lineitem, [{"name": "net", "expr": "round(l_extendedprice * (1 - l_discount), 4)"}]).select(
        "l_orderkey", "l_linenumber", "net")


@query("b3_overwrite_column", "SELECT l_orderkey, l_linenumber, l_quantity * 100 AS l_quantity FROM lineitem")
def b3(t: Tables):
    narrow = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return ops.add_columns(narrow, [{"name": "l_quantity", "expr": "l_quantity * 100"}])


@query("b4_rename", "SELECT s_suppkey AS id, s_name AS supplier, s_nationkey, s_acctbal FROM supplier")
def b4(t: Tables):
    return ops.rename_columns(t.supplier, {"s_suppkey": "id", "s_name": "supplier"})


@query("b5_drop_columns", "SELECT s_suppkey, s_name FROM supplier")
def b5(t: Tables):
    return ops.drop_columns(t.supplier, ["s_nationkey", "s_acctbal"])


@query("b6_replace_column", "SELECT o_orderkey, o_custkey, lower(o_orderpriority) AS o_orderpriority FROM orders")
def b6(t: Tables):
    narrow = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    return ops.add_columns(narrow, [{"name": "o_orderpriority", "expr": "lower(o_orderpriority)"}])


@query("b7_filter", """
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O'""")
def b7(t: Tables):
    return ops.filter_rows(t.orders, ["o_totalprice > 250000", "o_orderstatus == 'O'"]).select(
        "o_orderkey", "o_totalprice", "o_orderstatus")


@query("b8_filter_text_ci", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'")
def b8(t: Tables):
    return ops.filter_text(t.part, "p_name", "%RING%").select("p_partkey", "p_name")


@query("b9_drop_rows_where_null", f"SELECT * FROM ({DIRTY_ORDERS}) d WHERE o_orderpriority IS NOT NULL")
def b9(t: Tables):
    return ops.drop_null_rows(dirty_orders(t), ["o_orderpriority"])


@query("b10_dropna", f"SELECT * FROM ({DIRTY_ORDERS}) d WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL")
def b10(t: Tables):
    return ops.drop_null_rows(dirty_orders(t))


@query("b11_fill_nulls", f"""
SELECT o_orderkey, o_custkey, COALESCE(o_orderpriority, 'unknown') AS o_orderpriority,
       COALESCE(o_totalprice, 0.0) AS o_totalprice, o_orderstatus FROM ({DIRTY_ORDERS}) d""")
def b11(t: Tables):
    return ops.fill_nulls(ops.fill_nulls(dirty_orders(t), "o_orderpriority", "unknown"), "o_totalprice", 0)


@query("b12_update", f"""
SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice,
       CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM ({DIRTY_ORDERS}) d""")
def b12(t: Tables):
    return ops.update_cells(dirty_orders(t), {"o_orderstatus": "X"}, "o_totalprice > 400000")


@query("b13_update_list", """
WITH a AS (SELECT p_partkey, p_type, CASE WHEN p_size < 10 THEN 1.0 ELSE p_retailprice END AS p_retailprice FROM part),
b AS (SELECT p_partkey, p_type, CASE WHEN p_type = 'ECONOMY' THEN 2.0 ELSE p_retailprice END AS p_retailprice FROM a)
SELECT p_partkey, CASE WHEN p_retailprice <= 1 THEN 'BUDGET' ELSE p_type END AS p_type, p_retailprice FROM b""")
def b13(t: Tables):
    df = ops.update_cells(t.part, {"p_retailprice": 1}, "p_size < 10")
    df = ops.update_cells(df, {"p_retailprice": 2}, ["p_type == 'ECONOMY'"])
    return ops.update_cells(df, {"p_type": "BUDGET"}, "p_retailprice <= 1").select(
        "p_partkey", "p_type", "p_retailprice")


@query("b14_concat_text", """
SELECT c_custkey, c_mktsegment || '/' || CAST(c_nationkey AS VARCHAR) AS label FROM customer""")
def b14(t: Tables):
    return ops.concat_columns(t.customer, ["c_mktsegment", "c_nationkey"], "label", "/").select("c_custkey", "label")


@query("b15_round2", """
SELECT l_orderkey, l_linenumber, l_partkey, ROUND(l_extendedprice / 7.3, 2) AS unit_price FROM lineitem""")
def b15(t: Tables):
    df = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice / 7.3D AS unit_price")
    return ops.round_columns(df, ["unit_price"])


@query("b16_cast_lenient", """
SELECT doc_id, TRY_CAST(replace(source, 'src', CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END) AS BIGINT) AS source
FROM documents""")
def b16(t: Tables):
    df = t.documents.selectExpr("doc_id",
                                "replace(source, 'src', CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END) AS source")
    return ops.cast_column(df, "source", "bigint", lenient=True)


@query("b16_cast_failures", """
SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE doc_id % 4 = 0) AS failed_rows FROM documents""")
def b16_failures(t: Tables):
    df = t.documents.selectExpr("replace(source, 'src', CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END) AS source")
    return ops.cast_failures(df, "source", "bigint")


@query("e1_group_agg", """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS price,
       ROUND(AVG(l_discount), 6) AS discount, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi
FROM lineitem GROUP BY ALL""")
def e1(t: Tables):
    df = agg.group_agg(t.lineitem, ["l_returnflag", "l_linestatus"], [
        {"col": "*", "fn": "count", "as": "n"}, {"col": "l_extendedprice", "fn": "sum", "as": "price"},
        {"col": "l_discount", "fn": "avg", "as": "discount"}, {"col": "l_quantity", "fn": "min", "as": "lo"},
        {"col": "l_quantity", "fn": "max", "as": "hi"}])
    return ops.round_columns(ops.round_columns(df, ["price"], 2), ["discount"], 6)


@query("e2_groupby_named", """
SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS o_totalprice_sum, COUNT(o_orderkey) AS o_orderkey_count,
       ROUND(AVG(o_totalprice), 3) AS o_totalprice_mean FROM orders GROUP BY 1""")
def e2(t: Tables):
    df = agg.group_agg(t.orders, ["o_orderpriority"], [
        {"col": "o_totalprice", "fn": "sum"}, {"col": "o_orderkey", "fn": "count"},
        {"col": "o_totalprice", "fn": "mean"}])
    return ops.round_columns(ops.round_columns(df, ["o_totalprice_sum"], 2), ["o_totalprice_mean"], 3)


@query("e3_global_agg", """
SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 1) AS qty, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi
FROM lineitem""")
def e3(t: Tables):
    df = agg.group_agg(t.lineitem, [], [
        {"col": "*", "fn": "count", "as": "n"}, {"col": "l_quantity", "fn": "sum", "as": "qty"},
        {"col": "l_extendedprice", "fn": "min", "as": "lo"}, {"col": "l_extendedprice", "fn": "max", "as": "hi"}])
    return ops.round_columns(df, ["qty"], 1)


@query("e4_count_distinct", f"""
SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_orderpriority) AS priorities
FROM ({DIRTY_ORDERS}) d GROUP BY 1""")
def e4(t: Tables):
    return agg.group_agg(dirty_orders(t), ["o_orderstatus"], [
        {"col": "o_custkey", "fn": "count_distinct", "as": "customers"},
        {"col": "o_orderpriority", "fn": "count_distinct", "as": "priorities"}])


@query("e5_null_pct", f"""
SELECT 'o_orderpriority' AS "column", COUNT(*) FILTER (WHERE o_orderpriority IS NULL) AS null_count,
  CAST(ROUND(100.0 * COUNT(*) FILTER (WHERE o_orderpriority IS NULL) / COUNT(*), 1) AS DOUBLE) AS null_pct
FROM ({DIRTY_ORDERS}) d
UNION ALL
SELECT 'o_totalprice', COUNT(*) FILTER (WHERE o_totalprice IS NULL),
  CAST(ROUND(100.0 * COUNT(*) FILTER (WHERE o_totalprice IS NULL) / COUNT(*), 1) AS DOUBLE) FROM ({DIRTY_ORDERS}) d""")
def e5(t: Tables):
    return agg.filled_percentages(dirty_orders(t), ["o_orderpriority", "o_totalprice"])


@query("e6_median", """
SELECT l_returnflag, ROUND(MEDIAN(l_extendedprice), 4) AS median_price FROM lineitem GROUP BY 1""")
def e6(t: Tables):
    return exact_median(t.lineitem, ["l_returnflag"], "l_extendedprice", "median_price").withColumn(
        "median_price", F.round("median_price", 4))


@query("e6_median_in_band", """
SELECT event_type, ROUND(MEDIAN(value), 4) AS median_value FROM events GROUP BY 1""")
def e6_band(t: Tables):
    """The way for keys with more rows than an aggregate may hold."""
    return exact_median(t.events, ["event_type"], "value", "median_value", in_memory_rows=0).withColumn(
        "median_value", F.round("median_value", 4))


@query("e6_median_by_rank", """
SELECT event_type, ROUND(MEDIAN(value), 4) AS median_value FROM events GROUP BY 1""")
def e6_rank(t: Tables):
    """The way for very many such keys."""
    return exact_median(t.events, ["event_type"], "value", "median_value", in_memory_rows=0,
                        max_large_keys=0).withColumn("median_value", F.round("median_value", 4))


@query("e7_group_by_derived", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS order_year, COUNT(*) AS orders FROM orders GROUP BY 1""")
def e7(t: Tables):
    df = ops.add_columns(t.orders, [{"name": "order_year", "expr": "cast(year(o_orderdate) as bigint)"}])
    return agg.group_agg(df, ["order_year"], [{"col": "*", "fn": "count", "as": "orders"}])


KINDS = ["signup", "view", "click", "purchase", "error"]


@query("e8_pivot", "SELECT CAST(ts AS DATE) AS day, " + ", ".join(
    f"ROUND(SUM(value) FILTER (WHERE event_type = '{k}'), 2) AS {k}" for k in KINDS) + " FROM events GROUP BY 1")
def e8(t: Tables):
    df = t.events.select(F.to_date("ts").alias("day"), "event_type", "value")
    return agg.pivot_table(df, ["day"], "event_type", KINDS, F.round(F.sum("value"), 2))


@query("e9_chart_series", """
WITH k AS (SELECT COALESCE(CAST(user_id AS VARCHAR), 'null') AS label, event_id,
                  COALESCE(CASE WHEN event_type = 'error' THEN NULL ELSE value END, 0) AS v FROM events),
g AS (SELECT label, ROUND(SUM(v), 2) AS value, MIN(event_id) AS first_seen FROM k GROUP BY 1)
SELECT label, value FROM g ORDER BY first_seen LIMIT 30""")
def e9(t: Tables):
    df = t.events.withColumn("shown", F.expr("CASE WHEN event_type = 'error' THEN 'n/a' ELSE cast(value AS string) END"))
    return agg.chart_series(df, "user_id", "shown", "sum", "event_id", limit=30)


@query("g1_sort", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS row_index
FROM ({DIRTY_ORDERS}) d""")
def g1(t: Tables):
    """Position in the sorted table, NULL prices last."""
    df = dirty_orders(t).select("o_orderkey", "o_totalprice")
    return row_index(df, [("o_totalprice", "desc"), "o_orderkey"]).select("o_orderkey", "row_index")


@query("g1_sort_rows", f"SELECT o_orderkey, o_orderpriority FROM ({DIRTY_ORDERS}) d")
def g1_rows(t: Tables):
    return ordering.sort_rows(dirty_orders(t), [{"col": "o_orderpriority", "dir": "asc"}]).select(
        "o_orderkey", "o_orderpriority")


@query("g2_grid_sort", "SELECT p_partkey, p_name FROM part")
def g2(t: Tables):
    return ordering.grid_sort(t.part.select("p_partkey", "p_name"), "p_name", "desc")


@query("g3_top_n", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def g3(t: Tables):
    return ordering.top_n(t.part.select("p_partkey", "p_retailprice"), [("p_retailprice", "desc"), "p_partkey"], 25)


@query("g4_paginate", """
WITH m AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS created_at, c_nationkey AS row_count FROM customer
           WHERE c_name ILIKE '%9%')
SELECT id, name, created_at, row_count, (SELECT COUNT(*) FROM m) AS total FROM m
ORDER BY created_at DESC, id LIMIT 20 OFFSET 40""")
def g4(t: Tables):
    df = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                           F.col("c_acctbal").alias("created_at"), F.col("c_nationkey").alias("row_count"))
    return ordering.paginate(df, q="9", sort="no such column", direction="sideways", page=3, page_size=20)


@query("g5_latest_per_parent", """
SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20""")
def g5(t: Tables):
    return ordering.latest_for_parent(t.events, "user_id", 7, [("ts", "desc"), "event_id"], page=2).select(
        "event_id", "user_id", "event_type")


@query("g6_row_numbers_per_key", """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events""")
def g6(t: Tables):
    """Numbers within five very large groups, without one task per group."""
    df = t.events.select("event_id", "event_type", "ts")
    return row_numbers(df, ["event_type"], ["ts", "event_id"], "rn").select("event_id", "event_type", "rn")


@query("g7_running_total", """
SELECT event_id, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id)
  AS BIGINT) AS running FROM events""")
def g7(t: Tables):
    df = t.events.select("event_id", "event_type", "ts", "value")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return running_total(df, ["event_type"], ["ts", "event_id"], cents, "running").select("event_id", "running")
