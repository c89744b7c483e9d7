"""Sources, sinks and ingest."""

from pyspark.sql import functions as F

from gridwash.catalog.registry import Tables, query
from gridwash.operators.ordering import cap_rows, number_parts
from gridwash.session import new_path
from gridwash.sources import readers, writers
from gridwash.sources.ingest import ingest, sanitize_columns
from gridwash.sources.triage import triage

ORDERS = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
                   o_orderpriority FROM orders"""
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def dated_orders(t: Tables):
    return t.orders.withColumn("o_orderdate", F.to_date("o_orderdate"))


@query("a1_read_csv", ORDERS)
def a1(t: Tables):
    path = new_path(t.spark, "orders-csv")
    writers.write_csv(dated_orders(t), path)
    return readers.read_csv(t.spark, path)


@query("a2_read_csv_lenient", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus
FROM orders""")
def a2(t: Tables):
    """Every third line lacks its last cell."""
    path = new_path(t.spark, "ragged-csv")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(",", "o_orderkey", "o_custkey")).otherwise(
        F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus"))
    t.orders.select(line).write.text(path)
    rows, _ = readers.read_csv_lenient(
        t.spark, path, t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").schema, sep=",", header=False)
    return rows


@query("a3_read_tsv", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def a3(t: Tables):
    path = new_path(t.spark, "supplier-tsv")
    writers.write_tsv(t.supplier, path)
    return readers.read_tsv(t.spark, path)


@query("a4_read_jsonl", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def a4(t: Tables):
    path = new_path(t.spark, "customer-json")
    writers.write_json(t.customer, path)
    return readers.read_json(t.spark, path).select(*t.customer.columns)


@query("a5_read_parquet", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def a5(t: Tables):
    return readers.read_parquet(t.spark, f"{t.folder}/part.parquet").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query("a6_write_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def a6(t: Tables):
    """Texts with line breaks, quotes and commas survive."""
    path = new_path(t.spark, "documents-csv")
    writers.write_csv(t.documents, path)
    return readers.read_csv(t.spark, path)


CONVERSATIONS = "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations"


@query("a1_read_csv_texts", CONVERSATIONS)
def a1_texts(t: Tables):
    """Texts with the delimiter, quotes and line breaks, through a sniffed delimiter and an inferred schema."""
    path = new_path(t.spark, "conversations-csv")
    writers.write_csv(t.conversations, path)
    return readers.read_csv(t.spark, path)


@query("a1_read_csv_parallel", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def a1_parallel(t: Tables):
    """Whole documents, whose line breaks and quotes are all over the files, cut into records by many tasks per file."""
    path = new_path(t.spark, "documents-csv")
    writers.write_csv(t.documents, path)
    return readers.read_csv(t.spark, path, parallel=True)


@query("a2_read_csv_lenient_texts", CONVERSATIONS)
def a2_texts(t: Tables):
    path = new_path(t.spark, "conversations-csv")
    writers.write_csv(t.conversations, path)
    rows, _ = readers.read_csv_lenient(t.spark, path)
    return rows


@query("a3_read_tsv_texts", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def a3_texts(t: Tables):
    path = new_path(t.spark, "documents-tsv")
    writers.write_tsv(t.documents, path)
    return readers.read_tsv(t.spark, path)


@query("a4_read_export_json", """
SELECT conv_id, CAST(turn AS BIGINT) AS turn, text FROM conversations
UNION ALL SELECT p_partkey, CAST(p_size AS BIGINT), p_name FROM part""")
def a4_export(t: Tables):
    """A folder of record lines and one of arrays, both named .json."""
    lines, arrays = f"{new_path(t.spark, 'lines')}.json", f"{new_path(t.spark, 'arrays')}.json"
    writers.write_export(t.conversations.select("conv_id", "turn", "text"), lines, "json")
    parts = t.part.selectExpr("p_partkey AS conv_id", "p_size AS turn", "p_name AS text")
    one = parts.groupBy((F.col("conv_id") % 20).alias("file")).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    one.repartition("file").write.partitionBy("file").text(arrays)
    return (readers.read_export(t.spark, lines).select("conv_id", "turn", "text")
            .unionByName(readers.read_export(t.spark, arrays).select("conv_id", "turn", "text")))




@query("a7_write_json", """
SELECT o_orderkey, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, o_totalprice FROM orders""")
def a7(t: Tables):
    path = new_path(t.spark, "orders-json")
    df = t.orders.selectExpr("o_orderkey", "nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority",
                             "o_totalprice")
    writers.write_json(df, path)
    return readers.read_json(t.spark, path, df.schema)


@query("a8_write_parquet", """
SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem""")
def a8(t: Tables):
    path = new_path(t.spark, "lineitem-parquet")
    writers.write_parquet(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice",
                                            F.to_date("l_shipdate").alias("l_shipdate")), path)
    return readers.read_parquet(t.spark, path)


@query("a9_cap_rows", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY {', '.join(LINE_KEY)} LIMIT 4000""")
def a9(t: Tables):
    return cap_rows(t.lineitem, 4000, LINE_KEY).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("a11_sanitize_column_names", """
SELECT s_suppkey AS "id", s_name AS "name", s_nationkey AS "name_1", s_acctbal AS "unnamed" FROM supplier""")
def a11(t: Tables):
    return sanitize_columns(t.supplier.toDF("id\x00", " name\t", "name", "  "))


@query("a12_ingest", f"SELECT * FROM ({ORDERS}) o")
def a12(t: Tables):
    landed, path = new_path(t.spark, "landed-csv"), new_path(t.spark, "original")
    writers.write_csv(dated_orders(t), landed)
    return t.spark.read.parquet(ingest(t.spark, landed, path, fmt="csv").path)


@query("a12_ingest_texts", CONVERSATIONS)
def a12_texts(t: Tables):
    landed, path = new_path(t.spark, "landed-csv"), new_path(t.spark, "original")
    writers.write_csv(t.conversations, landed)
    return t.spark.read.parquet(ingest(t.spark, landed, path, fmt="csv").path)


@query("a13_split_parts", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST((row_number() OVER (ORDER BY {', '.join(LINE_KEY[:4])}) - 1) // 7000 + 1 AS BIGINT) AS part
FROM lineitem""")
def a13(t: Tables):
    return number_parts(t.lineitem.select(*LINE_KEY[:4]), LINE_KEY[:4], 7000)


@query("a13_split_export", """
SELECT part, COUNT(*) AS part_rows, MIN(o_orderkey) AS first_key, MAX(o_orderkey) AS last_key
FROM (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS BIGINT) AS part
      FROM orders) p GROUP BY part""")
def a13_export(t: Tables):
    path = new_path(t.spark, "orders-parts")
    writers.split_export(t.orders.select("o_orderkey", "o_totalprice"), path, ["o_orderkey"], 1000)
    back = t.spark.read.option("header", True).schema("o_orderkey bigint, o_totalprice double, part bigint").csv(path)
    return back.groupBy("part").agg(F.count(F.lit(1)).alias("part_rows"), F.min("o_orderkey").alias("first_key"),
                                    F.max("o_orderkey").alias("last_key"))


@query("a14_landing_zone_triage", r"""
WITH landed AS (
  SELECT 'in/' || page_id || CASE page_id % 7 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.csv'
              WHEN 3 THEN '.parquet' WHEN 4 THEN '.xlsm' WHEN 5 THEN '.json' ELSE '' END AS path,
         CASE page_id % 5 WHEN 0 THEN 'PK' || chr(3) || chr(4) || html WHEN 1 THEN 'MZ' || html
              WHEN 2 THEN '#!' || html WHEN 3 THEN 'PK' || chr(3) || chr(4) || 'xl/vbaProject.bin' || html
              ELSE 'PAR1' || html END AS content
  FROM pages),
named AS (SELECT *, CASE WHEN path LIKE '%.%' THEN lower(split_part(path, '.', -1)) ELSE '' END AS ext FROM landed),
judged AS (
  SELECT path, ext,
    CASE WHEN ext = 'xlsx' AND NOT starts_with(content, 'PK' || chr(3) || chr(4)) THEN 'content is not .xlsx'
         WHEN ext = 'parquet' AND NOT starts_with(content, 'PAR1') THEN 'content is not .parquet'
         WHEN starts_with(content, 'MZ') THEN 'Windows executable'
         WHEN starts_with(content, '#!') THEN 'script'
         WHEN ext = 'xlsm' THEN 'macro-enabled workbook'
         WHEN ext = 'xlsx' AND (contains(content, 'vbaProject.bin') OR contains(content, 'xl/vbaProject')
              OR contains(content, 'xl/macros')) THEN 'contains macros' END AS reason
  FROM named)
SELECT path, ext, CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS verdict, reason FROM judged""")
def a14(t: Tables):
    pk = "concat('PK', char(3), char(4)"
    landed = t.pages.selectExpr(
        "concat('in/', page_id, CASE page_id % 7 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.csv' "
        "WHEN 3 THEN '.parquet' WHEN 4 THEN '.xlsm' WHEN 5 THEN '.json' ELSE '' END) AS path",
        f"encode(CASE page_id % 5 WHEN 0 THEN {pk}, html) WHEN 1 THEN concat('MZ', html) WHEN 2 THEN concat('#!', html) "
        f"WHEN 3 THEN {pk}, 'xl/vbaProject.bin', html) ELSE concat('PAR1', html) END, 'utf-8') AS content")
    return triage(landed)
