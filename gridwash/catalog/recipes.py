"""Chains, recipes, fingerprints and the policy scan."""

import uuid

from pyspark.sql import functions as F

from gridwash.catalog.registry import Tables, query
from gridwash.functions.values import month_of
from gridwash.plans import guard, history, policy
from gridwash.plans.recipes import Recipe, apply_recipe, apply_recipe_many, renumber_after, snapshot_steps
from gridwash.plans.steps import Step, replay

# Orders as people type them: region names in mixed case, three date formats, money as text, every row twice.
MESSY = """
SELECT o.o_orderkey AS `order`,
  CASE o.o_orderkey % 3 WHEN 0 THEN date_format(o.o_orderdate, 'dd/MM/yyyy')
    WHEN 1 THEN date_format(o.o_orderdate, 'yyyy-MM-dd') ELSE date_format(o.o_orderdate, 'd MMM yyyy') END AS date,
  CASE o.o_orderkey % 2 WHEN 0 THEN lower(r.r_name) ELSE r.r_name END AS region,
  format_number(o.o_totalprice, 2) AS revenue
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey"""

TIDY_UP = (
    Step("distinct", {}, "remove duplicates"),
    Step("normalize_case", {"columns": ["region"], "style": "title"}, "title-case the regions"),
    Step("standardize_dates", {"column": "date", "formats": ["dd/MM/yyyy", "yyyy-MM-dd", "d MMM yyyy"]}, "fix the dates"),
    Step("parse_numbers", {"column": "revenue"}, "read the money as numbers"),
    Step("groupby", {"by": ["region"], "aggs": [{"col": "revenue", "fn": "sum"}, {"col": "order", "fn": "count"},
                                                {"col": "date", "fn": "min"}]}, "total revenue by region"),
    Step("add_columns", {"columns": [{"name": "revenue_sum", "expr": "round(revenue_sum, 2)"}]}, "round"),
)

FLAGSHIP = """
SELECT array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS region,
       ROUND(SUM(o_totalprice), 2) AS revenue_sum, COUNT(*) AS order_count, CAST(MIN(o_orderdate) AS DATE) AS date_min
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""


def messy_orders(t: Tables):
    once = t.spark.sql(MESSY, orders=t.orders, customer=t.customer, nation=t.nation, region=t.region)
    return once.unionByName(once)


@query("r1_flagship_recipe", FLAGSHIP)
def flagship(t: Tables):
    return replay(messy_orders(t), TIDY_UP)


CHAIN = [
    Step("add_columns", {"columns": [{"name": "year", "expr": "cast(year(o_orderdate) as bigint)"}]}),
    Step("filter", {"where": ["o_totalprice > 50000"]}),
    Step("update", {"set": {"o_orderstatus": "LATE"}, "where": ["year < 1997", "o_orderstatus == 'O'"]}),
    Step("sql", {"query": "SELECT o_orderstatus, year, o_totalprice, \"o_orderpriority\" FROM data;"}),
    Step("groupby", {"by": ["o_orderstatus", "year"], "aggs": [{"col": "o_totalprice", "fn": "max"},
                                                              {"col": "o_orderpriority", "fn": "count"}]}),
]


@query("r1_replay", """
WITH s1 AS (SELECT *, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders),
s2 AS (SELECT * FROM s1 WHERE o_totalprice > 50000),
s3 AS (SELECT * REPLACE (CASE WHEN year < 1997 AND o_orderstatus = 'O' THEN 'LATE' ELSE o_orderstatus END
       AS o_orderstatus) FROM s2)
SELECT o_orderstatus, year, MAX(o_totalprice) AS o_totalprice_max, COUNT(o_orderpriority) AS o_orderpriority_count
FROM s3 GROUP BY 1, 2""")
def r1(t: Tables):
    return replay(t.orders, CHAIN)


@query("r2_replay_up_to", """
SELECT o_orderkey, o_totalprice, o_orderstatus, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders
WHERE o_totalprice > 50000""")
def r2(t: Tables):
    return replay(t.orders, CHAIN, up_to=2).select("o_orderkey", "o_totalprice", "o_orderstatus", "year")


STEP_LOG = """SELECT conv_id AS file_id, turn * 3 + 2 AS step_number, '  ' || role || ' ' AS instruction,
  text AS sql_query, 'x' AS extra FROM conversations"""


def step_log(t: Tables):
    return t.conversations.selectExpr("conv_id AS file_id", "turn * 3 + 2 AS step_number",
                                      "concat('  ', role, ' ') AS instruction", "text AS sql_query", "'x' AS extra")


@query("r3_snapshot_steps", f"""
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY step_number) AS step_number,
       trim(instruction) AS instruction, sql_query FROM ({STEP_LOG}) s""")
def r3(t: Tables):
    return snapshot_steps(step_log(t))


@query("r4_renumber_after", f"""
WITH s AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY step_number) AS n, sql_query
           FROM ({STEP_LOG}) s),
e AS (SELECT conv_id AS file_id, COUNT(*) AS have FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT s.file_id, n + COALESCE(have, 0) AS step_number, sql_query FROM s LEFT JOIN e ON s.file_id = e.file_id""")
def r4(t: Tables):
    existing = t.conversations.filter("role = 'assistant'").select(F.col("conv_id").alias("file_id"))
    return renumber_after(snapshot_steps(step_log(t)), existing).select("file_id", "step_number", "sql_query")


MONTHLY = [Step("filter", {"where": "o_orderstatus <> 'P'"}),
           Step("groupby", {"by": ["o_orderpriority"], "aggs": [{"col": "o_totalprice", "fn": "max"},
                                                               {"col": "o_custkey", "fn": "count_distinct"}]})]


@query("r5_apply_recipe", """
SELECT o_orderpriority, MAX(o_totalprice) AS o_totalprice_max, COUNT(DISTINCT o_custkey) AS o_custkey_count_distinct
FROM orders WHERE year(o_orderdate) = 1998 AND o_totalprice > 1000 AND o_orderstatus <> 'P' GROUP BY 1""")
def r5(t: Tables):
    recipe = Recipe.from_json(Recipe.of("monthly", t.orders.filter("year(o_orderdate) = 1997"), MONTHLY).to_json())
    existing = [Step("filter", {"where": "o_totalprice > 1000"})]
    return apply_recipe(recipe, t.orders.filter("year(o_orderdate) = 1998"), existing)


@query("r7_apply_recipe_many", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, MAX(o_totalprice) AS o_totalprice_max,
       COUNT(DISTINCT o_custkey) AS o_custkey_count_distinct
FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2""")
def r7(t: Tables):
    exports = t.orders.withColumn("month", month_of(F.col("o_orderdate")))
    return apply_recipe_many(Recipe.of("monthly", t.orders, MONTHLY), exports, "month")


STORED_ROWS = [
    {"step_number": 2, "instruction": "latest first", "sql_query": "SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM data"},
    {"step_number": 1, "instruction": " open ones ", "sql_query": "SELECT o_orderkey, o_totalprice FROM data WHERE \"o_orderstatus\" = 'O';"},
    {"step_number": 3, "instruction": None, "sql_query": "SELECT o_orderkey, place FROM data WHERE place <= 5"},
]


@query("r5_recipe_from_rows", """
SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place
                               FROM orders WHERE o_orderstatus = 'O') s WHERE place <= 5""")
def r5_rows(t: Tables):
    rows = apply_recipe(Recipe.from_rows("top open", STORED_ROWS), t.orders)
    return rows.withColumn("place", F.col("place").cast("bigint"))


@query("r7_sql_recipe_many", """
SELECT o_orderpriority, o_orderkey, place FROM (
  SELECT o_orderpriority, o_orderkey,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place
  FROM orders WHERE o_orderstatus = 'O') s WHERE place <= 5""")
def r7_sql(t: Tables):
    """SQL steps run on each export alone."""
    rows = apply_recipe_many(Recipe.from_rows("top open", STORED_ROWS), t.orders, "o_orderpriority")
    return rows.withColumn("place", F.col("place").cast("bigint"))


@query("r7_row_steps_many", """
WITH d AS (SELECT o_orderpriority AS export, NULLIF(trim(CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderstatus END), '') AS status,
                  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)
SELECT export, coalesce(status, '') AS status, price, round(price / sum(price) OVER (PARTITION BY export), 9) AS share
FROM d WHERE price IS NOT NULL""")
def r7_row_steps(t: Tables):
    """Empty rows and shares of a total mean the rows of one export, and the export's name is no cell."""
    exports = t.orders.selectExpr("o_orderpriority AS export", "CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderstatus END AS status",
                                  "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price")
    steps = [Step("clean_text"), Step("drop_empty_rows"),
             Step("add_columns", {"columns": [{"name": "share", "expr": "round(price / sum(price) over (), 9)"}]})]
    return apply_recipe_many(Recipe.of("shares", t.orders, steps), exports, "export")


@query("r8_replay_checkpointed", """
SELECT o_orderkey, o_custkey * 2 + 11 AS o_custkey FROM orders""")
def r8(t: Tables):
    """Ten steps are stored by one call; the next goes on from there with two more, and plain replay is not needed."""
    def plus(expr):
        return Step("add_columns", {"columns": [{"name": "o_custkey", "expr": expr}]})

    steps = [plus("o_custkey * 2"), *[plus("o_custkey + 1") for _ in range(11)]]
    # A name of its own for each run: the shared folder may outlive the tables.
    base = f"{t.folder}/orders.parquet {uuid.uuid4().hex}"
    orders = t.orders.select("o_orderkey", "o_custkey")
    history.replay_checkpointed(base, orders, steps[:10])
    # The second call gets an empty table: every row comes from the stored beginning.
    return history.replay_checkpointed(base, orders.limit(0), steps)


CATALOG = """SELECT user_id AS export, event_type AS name, CASE WHEN MAX(value) > 60 THEN 'double' ELSE 'bigint' END
  AS dtype FROM events GROUP BY 1, 2"""


def export_catalog(t: Tables):
    return t.events.groupBy(F.col("user_id").alias("export"), F.col("event_type").alias("name")).agg(
        F.when(F.max("value") > 60, "double").otherwise("bigint").alias("dtype"))


@query("r10_schema_fingerprint", f"""
SELECT export, substr(sha256(string_agg(name || ':' || dtype, '|' ORDER BY name || ':' || dtype)), 1, 16) AS fingerprint
FROM ({CATALOG}) c GROUP BY 1""")
def r10(t: Tables):
    return history.schema_fingerprint(export_catalog(t))


@query("r10_schema_drift", f"""
WITH c AS ({CATALOG}), b AS (SELECT * FROM c WHERE export = 1),
p AS (SELECT export, substr(sha256(string_agg(name || ':' || dtype, '|' ORDER BY name || ':' || dtype)), 1, 16)
      AS fingerprint FROM c GROUP BY 1)
SELECT p.export, fingerprint,
  (SELECT COUNT(*) FROM c LEFT JOIN b ON c.name = b.name WHERE c.export = p.export AND b.name IS NULL) AS new_columns,
  (SELECT COUNT(*) FROM c JOIN b ON c.name = b.name WHERE c.export = p.export AND b.dtype <> c.dtype) AS retyped_columns,
  (SELECT COUNT(*) FROM b) - (SELECT COUNT(*) FROM c JOIN b ON c.name = b.name WHERE c.export = p.export)
    AS missing_columns
FROM p""")
def r10_drift(t: Tables):
    return history.schema_drift(export_catalog(t), 1)


@query("r11_step_audit", """
WITH n AS (SELECT COUNT(*) AS a, COUNT(*) FILTER (WHERE o_totalprice > 50000) AS b,
  COUNT(DISTINCT CASE WHEN o_totalprice > 50000 THEN o_orderpriority END) AS c FROM orders)
SELECT CAST(1 AS BIGINT) AS step_number, 'filter' AS op, a AS rows_before, b AS rows_after,
       CAST(3 AS BIGINT) AS columns_after, true AS content_changed FROM n
UNION ALL SELECT 2, 'update', b, b, 3, false FROM n
UNION ALL SELECT 3, 'groupby', b, c, 2, true FROM n""")
def r11(t: Tables):
    df = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    steps = [Step("filter", {"where": "o_totalprice > 50000"}),
             Step("update", {"set": {"o_orderpriority": "none"}, "where": "o_totalprice < 0"}),
             Step("groupby", {"by": ["o_orderpriority"], "aggs": [{"col": "o_totalprice", "fn": "max"}]})]
    return history.step_audit(df, steps).select(
        F.col("step_number").cast("bigint").alias("step_number"), "op", "rows_before", "rows_after",
        F.size("columns_after").cast("bigint").alias("columns_after"),
        (F.col("fingerprint_before") != F.col("fingerprint_after")).alias("content_changed"))


@query("r12_table_fingerprint", """
SELECT COUNT(*) AS row_count, CAST(SUM(CAST('0x' || substr(md5('v' || c_custkey || chr(31) || 'v' || c_name || chr(31)
  || 'v' || c_nationkey || chr(31) || 'v' || c_acctbal || chr(31)
  || COALESCE('v' || NULLIF(c_mktsegment, 'MACHINERY'), 'n')), 1, 15) AS BIGINT)) % 2305843009213693951 AS BIGINT)
  AS fingerprint
FROM customer""")
def r12(t: Tables):
    return history.table_fingerprint(t.customer.withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'MACHINERY')")))


# "~" stands for a quote, so that both dialects read the same literals.
STORED = """replace(CASE doc_id % 22
  WHEN 0 THEN concat('SELECT * FROM data WHERE lang = ~', lang, '~;;')
  WHEN 1 THEN concat('```sql', chr(10), 'SELECT * FROM data', chr(10), '```')
  WHEN 2 THEN concat('WITH t AS (SELECT ', doc_id, ') DELETE FROM data')
  WHEN 3 THEN concat('SELECT * FROM read_csv(~', source, '~)')
  WHEN 4 THEN concat('SELECT 1 ; SELECT ', doc_id)
  WHEN 5 THEN concat('EXPLAIN SELECT ', doc_id)
  WHEN 6 THEN '   '
  WHEN 7 THEN concat('SELECT "Drop Rate", "read_csv(" FROM data WHERE note = ~DROP; ', lang, '~')
  WHEN 8 THEN concat('select reflect(', doc_id, ')')
  WHEN 9 THEN concat('select * from parquet_scan (~', source, '~)')
  WHEN 10 THEN concat('SELECT a FROM data WHERE set = ', doc_id)
  WHEN 11 THEN concat(' with x as (select 1) select * from x where y = ~', replace(text, chr(39), ''), '~')
  WHEN 12 THEN concat('SELECT * FROM glob(~**~) -- drop ', lang)
  WHEN 13 THEN concat('SELECT 1 AS "it~s", reflect(~java.lang.Math~, ~abs~, ', doc_id, ') AS "b~"')
  WHEN 14 THEN concat('SELECT * FROM IDENTIFIER(~secret~) WHERE x = ', doc_id)
  WHEN 15 THEN concat('SELECT a FROM data WHERE EXISTS (SELECT 1 FROM customers c WHERE c.k = data.k AND c.n = ~', lang, '~)')
  WHEN 16 THEN concat('SELECT * FROM data VERSION AS OF ', doc_id)
  WHEN 17 THEN concat('SELECT * FROM data JOIN range(', doc_id, ') r ON r.id = data.id')
  WHEN 18 THEN concat('WITH t AS (SELECT * FROM data WHERE n = ~FROM x~) SELECT * FROM t JOIN data USING (k) LIMIT ', doc_id)
  WHEN 19 THEN concat('WITH t AS (WITH u AS (SELECT * FROM data) SELECT * FROM u) SELECT a + ', doc_id, ' FROM u')
  WHEN 20 THEN concat('SELECT sum(a) OVER w FROM data WINDOW w AS (PARTITION BY (SELECT ', doc_id, ' FROM hidden))')
  ELSE text END, '~', chr(39))"""
# The texts as lists of tokens: what hides code, calls, words, other characters. Written apart from the operator's patterns.
_HIDES = r'''r'[^']*'|'(?:[^'\\]|\\.|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|--[^\r\n]*|/[*][^+][\s\S]*?[*]/'''.replace("'", "''")
_WORDS = ", ".join(f"'{w}'" for w in policy.BLOCKED_WORDS + policy.SPARK_WORDS)


@query("r13_policy_scan", rf"""
WITH s AS (SELECT doc_id, {STORED} AS stored FROM documents),
f AS (SELECT doc_id, regexp_replace(stored, '^\s+|\s+$', '', 'g') AS q FROM s),
u AS (SELECT doc_id, CASE WHEN starts_with(q, '```') THEN regexp_replace(regexp_replace(q, '^```(?:sql)?\s*|\s*```$',
      '', 'g'), '^\s+|\s+$', '', 'g') ELSE q END AS q FROM f),
c AS (SELECT doc_id, regexp_replace(regexp_replace(q, ';+$', ''), '^\s+|\s+$', '', 'g') AS cleaned_sql FROM u),
k AS (SELECT *, list_filter(regexp_extract_all(cleaned_sql, '(?i){_HIDES}|\w+\s*[(]|\w+|\W'),
      lambda x: regexp_matches(x, '^\w') AND NOT regexp_matches(x, '^[rR][' || chr(39) || ']') OR x = ';') AS tokens FROM c),
n AS (SELECT *, list_transform(list_filter(tokens, lambda x: x <> ';'), lambda x: upper(regexp_replace(x, '[( \t]+$', '')))
        AS words,
      list_transform(list_filter(tokens, lambda x: regexp_matches(x,
        '(?i)^(read_\w+|\w+_scan|glob|sniff_csv|reflect|java_method|try_reflect)\s*[(]$')),
        lambda x: upper(regexp_replace(x, '[( \t]+$', ''))) AS calls FROM k),
w AS (SELECT *, list_filter(words, lambda x: x IN ({_WORDS}))[1] AS word, calls[1] AS call FROM n),
v AS (SELECT *, CASE WHEN cleaned_sql = '' THEN 'empty'
        WHEN words[1] IS NULL OR words[1] NOT IN ('SELECT', 'WITH') THEN 'not a select'
        WHEN word IS NOT NULL THEN 'blocked keyword' WHEN call IS NOT NULL THEN 'blocked function'
        WHEN list_contains(tokens, ';') THEN 'multiple statements' ELSE 'ok' END AS verdict FROM w),
b AS (SELECT *, regexp_replace(cleaned_sql, $$'[^']*'$$, '', 'g') AS bare FROM v),
t AS (SELECT *, CASE WHEN verdict <> 'ok' THEN NULL WHEN contains(bare, ' AS OF ') THEN 'AS OF'
        ELSE list_filter(regexp_extract_all(bare, '(?i)\b(?:from|join)\s+(\w+)', 1),
          lambda x: x NOT IN ('data', regexp_extract(bare, '(?i)^with\s+(\w+)', 1)))[1] END AS other FROM b)
SELECT doc_id, cleaned_sql, CASE WHEN other IS NULL THEN verdict ELSE 'reads another table' END AS verdict,
  CASE verdict WHEN 'blocked keyword' THEN word WHEN 'blocked function' THEN call ELSE other END AS blocked_keyword FROM t""")
def r13(t: Tables):
    df = t.documents.selectExpr("doc_id", f"{STORED} AS stored")
    return guard.policy_scan(df, "stored").drop("stored")
