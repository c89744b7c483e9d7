"""Joins and set operations."""

from pyspark.sql import functions as F

from gridwash.catalog.registry import Tables, query
from gridwash.operators import relations as ops


@query("h1_lookup_join", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def h1(t: Tables):
    facts = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ops.lookup_join(facts, t.orders.select("o_orderkey", "o_custkey"), "l_orderkey", "o_orderkey").drop("o_orderkey")


@query("h1_lookup_join_hot_keys", """
SELECT e.event_id, e.event_type, k.first_id FROM events e
JOIN (SELECT event_type, MIN(event_id) AS first_id FROM events GROUP BY 1) k ON e.event_type = k.event_type""")
def h1_hot(t: Tables):
    """Five keys with a fifth of the rows each: none of them goes through a shuffle."""
    kinds = t.events.groupBy(F.col("event_type").alias("kind")).agg(F.min("event_id").alias("first_id"))
    return ops.lookup_join(t.events.select("event_id", "event_type"), kinds, "event_type", "kind",
                           split_hot=True, hot_rows=500).drop("kind")


@query("h2_left_lookup", """
SELECT c_custkey, c_name, CAST(first_order AS DATE) AS first_order FROM customer
LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_order FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o
  ON c_custkey = o_custkey""")
def h2(t: Tables):
    finished = t.orders.filter("o_orderstatus = 'F'")
    return ops.first_child(t.customer.select("c_custkey", "c_name"), finished, "c_custkey", "o_custkey",
                           "o_orderdate", "first_order").withColumn("first_order", F.to_date("first_order"))


@query("h3_owned_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7")
def h3(t: Tables):
    return ops.owned_rows(t.orders, "o_custkey", 7).select("o_orderkey", "o_custkey", "o_totalprice")


@query("h4_owned_transitively", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 100 AND 300)""")
def h4(t: Tables):
    return ops.owned_through(t.lineitem, t.orders, "l_orderkey", "o_orderkey",
                             F.col("o_custkey").between(100, 300)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("h5_orphans", """
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def h5(t: Tables):
    return ops.orphans(t.orders, t.lineitem, "o_orderkey", "l_orderkey").select("o_orderkey", "o_custkey")


@query("h6_set_union", """
SELECT c_custkey FROM customer WHERE c_acctbal < 0
UNION SELECT o_custkey FROM orders WHERE o_totalprice > 450000""")
def h6(t: Tables):
    return ops.union_keys(t.customer.filter("c_acctbal < 0").select("c_custkey"),
                          t.orders.filter("o_totalprice > 450000").select("o_custkey"))


@query("h7_set_difference_names", """
SELECT name, position FROM (SELECT p_type AS name, MIN(p_partkey) AS position FROM part GROUP BY 1) r
WHERE lower(name) NOT IN (SELECT lower(p_type) FROM part WHERE p_type NOT IN ('PROMO', 'LARGE'))""")
def h7(t: Tables):
    required = t.part.groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("position"))
    target = t.part.filter("p_type NOT IN ('PROMO', 'LARGE')").select(F.lower("p_type").alias("name"))
    return ops.missing_columns(required, target)


@query("h8_cascade_delete_preview", """
SELECT 'parents' AS table_name, COUNT(*) AS rows_removed FROM orders WHERE o_custkey < 50
UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey < 50)""")
def h8(t: Tables):
    return ops.cascade_preview(t.orders, "o_orderkey", F.col("o_custkey") < 50, {"lineitem": (t.lineitem, "l_orderkey")})
