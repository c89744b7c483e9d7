"""Text, date, number and JSON cleaning."""

from pyspark.sql import functions as F

from gridwash.catalog.registry import Tables, query
from gridwash.functions import replies, text, values
from gridwash.operators import cells, nested, tidy
from gridwash.operators.vocabulary import fuzzy_match

PADDED = """SELECT doc_id,
  CASE doc_id % 5 WHEN 0 THEN '  ' || text || ' ' WHEN 1 THEN chr(9) || text || chr(10) WHEN 2 THEN '   '
       WHEN 3 THEN replace(text, ' ', '  ') ELSE text END AS text,
  CASE WHEN doc_id % 10 = 2 THEN '' WHEN doc_id % 6 = 0 THEN source || ' ' ELSE source END AS source FROM documents"""
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def padded(t: Tables):
    return t.documents.selectExpr(
        "doc_id",
        "CASE doc_id % 5 WHEN 0 THEN concat('  ', text, ' ') WHEN 1 THEN concat(char(9), text, char(10)) "
        "WHEN 2 THEN '   ' WHEN 3 THEN replace(text, ' ', '  ') ELSE text END AS text",
        "CASE WHEN doc_id % 10 = 2 THEN '' WHEN doc_id % 6 = 0 THEN concat(source, ' ') ELSE source END AS source")


@query("c1_trim_all", f"SELECT doc_id, {TRIM.format('text')} AS text, {TRIM.format('source')} AS source FROM ({PADDED}) p")
def c1(t: Tables):
    return tidy.clean_text(padded(t))


@query("c2_collapse_spaces", f"SELECT doc_id, regexp_replace(text, ' {{2,}}', ' ', 'g') AS text, source FROM ({PADDED}) p")
def c2(t: Tables):
    return tidy.clean_text(padded(t), ["text"], trim=False, collapse=True)


@query("c4_drop_empty_rows", f"""
SELECT text, source FROM (SELECT {TRIM.format('text')} AS text, {TRIM.format('source')} AS source FROM ({PADDED}) p) c
WHERE text <> '' OR source <> ''""")
def c4(t: Tables):
    return tidy.drop_empty_rows(tidy.clean_text(padded(t).drop("doc_id")))


@query("c5_drop_empty_columns", "SELECT c_custkey, c_name FROM customer")
def c5(t: Tables):
    df = t.customer.select("c_custkey", "c_name", F.lit("").alias("notes"), F.lit(None).cast("string").alias("flag"))
    return tidy.drop_empty_columns(df, ignore_header=True)


@query("c6_clean_report", f"""
WITH p AS ({PADDED}),
c AS (SELECT text, source, regexp_replace({TRIM.format('text')}, ' {{2,}}', ' ', 'g') AS t2,
             regexp_replace({TRIM.format('source')}, ' {{2,}}', ' ', 'g') AS s2 FROM p)
SELECT CAST(SUM(CASE WHEN text <> t2 THEN 1 ELSE 0 END + CASE WHEN source <> s2 THEN 1 ELSE 0 END) AS BIGINT) + 1
         AS cells_touched,
       COUNT(*) FILTER (WHERE t2 = '' AND s2 = '') AS rows_removed, CAST(1 AS BIGINT) AS columns_removed FROM c""")
def c6(t: Tables):
    """One padded header and one nameless empty column besides the padded cells."""
    df = padded(t).drop("doc_id").withColumnRenamed("source", "source ").withColumn("", F.lit(""))
    return tidy.clean_report(df, collapse=True)


@query("c7_normalize_case", """
SELECT p_partkey,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS p_name,
  lower(p_type) AS p_type, upper(p_brand) AS p_brand FROM part""")
def c7(t: Tables):
    df = t.part.select("p_partkey", "p_name", "p_type", "p_brand")
    df = cells.normalize_case(df, ["p_name"], "title")
    return cells.normalize_case(cells.normalize_case(df, ["p_type"], "lower"), ["p_brand"], "upper")


@query("c8_standardize_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 10 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date FROM orders""")
def c8(t: Tables):
    return cells.standardize_dates(messy_dates(t), "order_date", FORMATS)


FORMATS = ["dd/MM/yyyy", "yyyy-MM-dd", "d MMM yyyy"]


def messy_dates(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 11 = 10 THEN 'soon' ELSE CASE o_orderkey % 3 "
        "WHEN 0 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
        "ELSE date_format(o_orderdate, 'd MMM yyyy') END END AS order_date")


@query("c8_unparsed_dates", """
SELECT COUNT(*) AS filled_rows, COUNT(*) FILTER (WHERE o_orderkey % 11 = 10) AS unparsed_rows FROM orders""")
def c8_unparsed(t: Tables):
    return cells.unparsed_dates(messy_dates(t), "order_date", FORMATS)


@query("c9_parse_number", """
SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders""")
def c9(t: Tables):
    messy = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' "
                                "ELSE concat(' ', format_number(o_totalprice, 2)) END AS price")
    return cells.parse_numbers(messy, "price")


@query("c10_is_numeric_like", """
WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name,
                  CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_type END AS mixed FROM part),
u AS (SELECT 'p_partkey' AS "column", p_partkey AS v FROM d UNION ALL SELECT 'p_name', p_name FROM d
      UNION ALL SELECT 'mixed', mixed FROM d)
SELECT "column", COUNT(*) FILTER (WHERE trim(v) <> '' AND TRY_CAST(v AS DOUBLE) IS NOT NULL) AS numeric_cells,
       COUNT(v) AS filled_cells,
       ROUND(COUNT(*) FILTER (WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL) / CAST(COUNT(v) AS DOUBLE), 4) AS numeric_share
FROM u GROUP BY 1""")
def c10(t: Tables):
    return cells.numeric_share(t.part.selectExpr(
        "cast(p_partkey AS string) AS p_partkey", "p_name",
        "CASE WHEN p_size % 2 = 0 THEN cast(p_size AS string) ELSE p_type END AS mixed"))


@query("c11_flatten_struct", """
SELECT c_custkey AS id, c_name AS "who.name", CAST(c_nationkey AS BIGINT) AS "who.place.nation",
       c_mktsegment AS "who.place.segment", '[' || c_custkey || ',' || c_nationkey || ']' AS "who.codes"
FROM customer""")
def c11(t: Tables):
    df = t.customer.selectExpr(
        "c_custkey AS id",
        "named_struct('name', c_name, 'place', named_struct('nation', cast(c_nationkey AS bigint), "
        "'segment', c_mktsegment), 'codes', array(c_custkey, cast(c_nationkey AS bigint))) AS who")
    return nested.flatten_struct(df)


@query("c12_arrays_as_json", """
SELECT l_orderkey, l_linenumber, '[' || l_partkey || ',' || l_suppkey || ']' AS sources FROM lineitem""")
def c12(t: Tables):
    return nested.flatten_struct(t.lineitem.select(
        "l_orderkey", "l_linenumber", F.array("l_partkey", "l_suppkey").alias("sources")))


@query("c13_flatten_json_text", """
SELECT event_id, COALESCE(json_extract_string(doc, '$.k'), '') AS "doc.k",
       COALESCE(json_extract_string(doc, '$.user.id'), '') AS "doc.user.id",
       COALESCE(json_extract_string(doc, '$.user.kind'), '') AS "doc.user.kind"
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props
        WHEN 1 THEN '{"user": {"id": ' || user_id || ', "kind": "' || event_type || '"}}'
        ELSE '{"k": null, "user": {"id": ' || user_id || '}}' END AS doc FROM events) e""")
def c13(t: Tables):
    df = t.events.selectExpr(
        "event_id", "CASE event_id % 3 WHEN 0 THEN props "
        "WHEN 1 THEN concat('{\"user\": {\"id\": ', user_id, ', \"kind\": \"', event_type, '\"}}') "
        "ELSE concat('{\"k\": null, \"user\": {\"id\": ', user_id, '}}') END AS doc")
    return nested.flatten_json_text(df, "doc").select("event_id", "`doc.k`", "`doc.user.id`", "`doc.user.kind`")


@query("c14_unwrap_array", """
SELECT CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_quantity AS qty FROM lineitem
UNION ALL SELECT CAST(-l_linenumber AS BIGINT), l_suppkey, l_tax FROM lineitem""")
def c14(t: Tables):
    """Each line item as a record that wraps two items."""
    def item(line, part, qty):
        return F.struct(line.cast("bigint").alias("line"), F.col(part).alias("part"), F.col(qty).alias("qty"))

    items = F.array(item(F.col("l_linenumber"), "l_partkey", "l_quantity"),
                    item(-F.col("l_linenumber"), "l_suppkey", "l_tax"))
    return nested.unwrap_array(t.lineitem.select("l_orderkey", items.alias("items")))


@query("c14_unwrap_scalars", """
SELECT CAST(l_partkey AS VARCHAR) AS value FROM lineitem UNION ALL SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem""")
def c14_scalars(t: Tables):
    return nested.unwrap_array(t.lineitem.select(F.array("l_partkey", "l_suppkey").alias("items")))


@query("c15_redact_literals", r"""
WITH m AS (SELECT conv_id, turn, 'Could not convert ''it''''s ' || text || ''' near ''' || role || ''' to INT64'
                  || chr(10) || 'LINE 1' AS message FROM conversations)
SELECT conv_id, turn, CASE WHEN trim(message) = '' THEN 'execution failed' ELSE
  substr(regexp_replace(regexp_extract(regexp_replace(message, '^\s+|\s+$', '', 'g'), '^[^\n]*'),
         '''(?:[^'']|'''')*''', '''<redacted>''', 'g'), 1, 500) END AS message FROM m""")
def c15(t: Tables):
    df = t.conversations.selectExpr(
        "conv_id", "turn", "concat(\"Could not convert 'it''s \", text, \"' near '\", role, \"' to INT64\", "
        "char(10), 'LINE 1') AS message")
    return df.withColumn("message", text.redact_literals(F.col("message")))


@query("c17_classify_reply", """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'clarification' WHEN 1 THEN 'insight' ELSE 'sql' END AS kind
FROM conversations""")
def c17(t: Tables):
    """Replies with a truthy flag, with an insight, with an empty insight or broken JSON."""
    df = t.conversations.selectExpr(
        "conv_id", "turn",
        "CASE turn % 4 WHEN 0 THEN concat(' {\"needs_clarification\": true, \"insight\": \"', role, '\"} ') "
        "WHEN 1 THEN concat('{\"needs_clarification\": false, \"insight\": \"', role, ' ', conv_id, '\"}') "
        "WHEN 2 THEN '{\"needs_clarification\": 0, \"insight\": \"\"}' "
        "ELSE concat('{\"insight\": ', text) END AS reply")
    return df.select("conv_id", "turn", replies.classify_reply(F.col("reply")).alias("kind"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
MISSPELT = """CASE c_custkey % 4 WHEN 0 THEN substr(c_mktsegment, 2) WHEN 1 THEN c_mktsegment || 'S'
  WHEN 2 THEN substr(c_mktsegment, 1, 3) || substr(c_mktsegment, 5, 1) || substr(c_mktsegment, 4, 1)
       || substr(c_mktsegment, 6) ELSE lower(c_mktsegment) END"""


@query("c18_fuzzy_match", f"""
WITH v AS (SELECT c_custkey, {MISSPELT} AS segment FROM customer),
s AS (SELECT c_custkey, segment, """ + ", ".join(
    f"jaro_winkler_similarity(segment, '{s}') AS s{i}" for i, s in enumerate(SEGMENTS)) + """ FROM v),
b AS (SELECT *, greatest(s0, s1, s2, s3, s4) AS top FROM s)
SELECT c_custkey, segment, CASE WHEN top < 0.7 THEN NULL """ + " ".join(
    f"WHEN s{i} = top THEN '{s}'" for i, s in enumerate(SEGMENTS)) + """ END AS matched FROM b""")
def c18(t: Tables):
    return fuzzy_match(t.customer.selectExpr("c_custkey", f"{MISSPELT} AS segment"), "segment", SEGMENTS)


@query("c18_fuzzy_match_table", """
WITH v AS (SELECT s_suppkey, replace(replace(s_name, 'Supplier', 'Suplier'), '#', ' ') AS name FROM supplier),
p AS (SELECT s_suppkey, name, w.s_name AS entry, jaro_winkler_similarity(name, w.s_name) AS score
      FROM v, (SELECT s_name FROM supplier) w),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, entry) AS rn FROM p)
SELECT s_suppkey, name, CASE WHEN score >= 0.7 THEN entry END AS matched FROM r WHERE rn = 1""")
def c18_table(t: Tables):
    df = t.supplier.selectExpr("s_suppkey", "replace(replace(s_name, 'Supplier', 'Suplier'), '#', ' ') AS name")
    return fuzzy_match(df, "name", t.supplier.select("s_name"))


@query("c19_month_of", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders""")
def c19(t: Tables):
    return t.orders.select("o_orderkey", values.month_of(F.col("o_orderdate")).alias("month"),
                           F.year("o_orderdate").cast("bigint").alias("year"))


@query("c20_base_name", r"""
SELECT page_id, regexp_replace(url, '\.[^/.]+$', '') AS base,
       CASE WHEN contains(split_part(url, '/', -1), '.') THEN lower(split_part(url, '.', -1)) ELSE '' END AS extension
FROM pages""")
def c20(t: Tables):
    return t.pages.select("page_id", text.base_name(F.col("url")).alias("base"),
                          text.extension(F.col("url")).alias("extension"))
