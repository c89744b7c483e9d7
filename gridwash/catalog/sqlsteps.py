"""What a SQL step may contain. Each text runs unchanged on Spark and in the check."""

from gridwash.catalog.registry import Tables, query
from gridwash.plans.steps import Step, replay


def sql_query(name: str, table: str, text: str):
    """One SQL step over one table."""
    oracle = text.strip()
    head = f"WITH data AS (SELECT * FROM {table})"
    oracle = f"{head}, {oracle[4:].lstrip()}" if oracle.upper().startswith("WITH") else f"{head} {oracle}"

    @query(name, oracle)
    def run(t: Tables):
        return replay(getattr(t, table), [Step("sql", {"query": text})])


sql_query("s1_sql_step", "orders", """
SELECT o_orderkey, "o_custkey", o_totalprice * 2 AS double_price FROM data WHERE o_orderpriority LIKE '1-%'""")

sql_query("s2_cte", "orders", """
WITH big AS (SELECT * FROM data WHERE o_totalprice > 300000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY 1)
SELECT n AS orders_per_customer, COUNT(*) AS customers FROM per GROUP BY n""")

sql_query("s3_self_join", "orders", """
SELECT a.o_orderkey, b.o_orderkey AS next_order, b.o_orderstatus AS next_status FROM data a JOIN data b
  ON b.o_orderkey = a.o_orderkey + 1 AND b.o_orderstatus <> a.o_orderstatus""")

sql_query("s3_range_join", "orders", """
SELECT a.o_orderkey, a.o_custkey FROM data a
  JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_order FROM data GROUP BY o_custkey) b
  ON a.o_custkey = b.o_custkey AND a.o_orderdate > b.first_order AND a.o_orderdate <= b.first_order + INTERVAL 1 YEAR""")

sql_query("s3_semi_anti_join", "events", """
SELECT DISTINCT user_id, event_type FROM data a
WHERE EXISTS (SELECT 1 FROM data b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.value > 55)
  AND NOT EXISTS (SELECT 1 FROM data c WHERE c.user_id = a.user_id AND c.event_type = 'error' AND c.value > 70)""")

sql_query("s3_asof_join", "events", """
SELECT event_id, last_view FROM (
  SELECT event_id, event_type, MAX(CASE WHEN event_type = 'view' THEN event_id END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view
  FROM data) x WHERE event_type = 'purchase'""")

sql_query("s4_window_functions", "orders", """
SELECT o_orderkey,
  CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS price_rank,
  CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS priority_rank,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_order,
  lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_but_one,
  CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS cents_of_last_three,
  CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS quarter
FROM data""")

sql_query("s5_rollup", "lineitem", """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MAX(l_extendedprice) AS top FROM data
GROUP BY ROLLUP (l_returnflag, l_linestatus)""")

sql_query("s5_cube", "lineitem", """
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, COUNT(*) AS n FROM data
GROUP BY CUBE (l_returnflag, l_linestatus)""")

sql_query("s5_grouping_sets", "lineitem", """
SELECT l_returnflag, l_linenumber, MIN(l_quantity) AS low, COUNT(DISTINCT l_suppkey) AS suppliers FROM data
GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())""")

sql_query("s6_set_operations", "customer", """
(SELECT c_nationkey, c_mktsegment FROM data WHERE c_acctbal > 0 INTERSECT SELECT c_nationkey, c_mktsegment FROM data
 WHERE c_acctbal < 0) UNION ALL (SELECT c_nationkey, c_mktsegment FROM data EXCEPT SELECT c_nationkey, c_mktsegment
 FROM data WHERE c_acctbal < 9000)""".replace("(SELECT", "SELECT * FROM (SELECT", 1).replace(
    "c_acctbal < 0) UNION", "c_acctbal < 0) i UNION").replace("UNION ALL (SELECT", "UNION ALL SELECT * FROM (SELECT").replace(
    "c_acctbal < 9000)", "c_acctbal < 9000) e"))

sql_query("s7_subqueries", "orders", """
SELECT o_orderkey, o_totalprice, (SELECT MAX(o_totalprice) FROM data) AS highest,
  (SELECT COUNT(*) FROM data b WHERE b.o_custkey = a.o_custkey) AS of_customer
FROM data a WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM data c WHERE c.o_custkey = a.o_custkey) * 1.5""")

sql_query("s8_string_functions", "documents", """
SELECT doc_id, upper(lang) AS up, CAST(length(text) AS BIGINT) AS chars, substr(source, 1, 3) AS head, lpad(source, 8, '*') AS padded,
  replace(lang, 'e', 'E') AS swapped, trim(concat('  ', lang, ' ')) AS trimmed, reverse(source) AS backwards,
  repeat(lang, 2) AS twice, split_part(source, 'r', 2) AS part, text LIKE '%a b%' AS has_ab, left(text, 12) AS opening,
  COALESCE(NULLIF(lang, 'de'), '?') AS lang_or, ascii(lang) AS code, md5(source) AS digest
FROM data""")

sql_query("s8_date_functions", "orders", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
  CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
  last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS later,
  CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy
FROM data""")

sql_query("s8_math_functions", "lineitem", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_discount - 0.05) AS dist, CAST(ceil(l_extendedprice) AS BIGINT) AS up,
  CAST(floor(l_extendedprice) AS BIGINT) AS down, round(sqrt(l_quantity), 6) AS root, l_orderkey % 7 AS rest,
  greatest(l_quantity, 20) AS at_least, least(l_quantity, 20) AS at_most, CAST(sign(l_tax - 0.04) AS DOUBLE) AS sgn,
  round(ln(l_quantity), 6) AS logarithm, round(power(l_discount, 2), 8) AS square
FROM data""")

sql_query("s8_regular_expressions", "pages", r"""
SELECT page_id, regexp_replace(url, '^https?://', '') AS bare_url, regexp_extract(url, '://([^/]+)', 1) AS host,
  regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page FROM data""")

sql_query("s8_conditionals", "part", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'medium' ELSE 'small' END AS size_class,
  p_type IN ('PROMO', 'ECONOMY') AS cheap, p_size BETWEEN 10 AND 20 AS teen, p_name LIKE '%bolt' AS bolt
FROM data""")


@query("s8_array_functions", """
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, ROUND(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
       ROUND(CAST(list_max(embedding) AS DOUBLE), 6) AS top, list_contains(embedding, embedding[3]) AS has_third
FROM embeddings""")
def s8_arrays(t: Tables):
    return replay(t.embeddings, [Step("sql", {"query": """
        SELECT vec_id, CAST(size(embedding) AS BIGINT) AS dims, round(CAST(embedding[0] AS DOUBLE), 6) AS first_value,
               round(CAST(array_max(embedding) AS DOUBLE), 6) AS top, array_contains(embedding, embedding[2]) AS has_third
        FROM data"""})])


@query("s8_json_functions", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def s8_json(t: Tables):
    return replay(t.events, [Step("sql", {"query": """
        SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM data"""})])
