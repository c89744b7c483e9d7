"""op12: fill-in-middle form of all documents."""

from pyspark.sql import functions as F

from gridwash.llm.fim import fill_in_middle, restored
from gridwash.llm.queries import query

SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
drawn AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS one,
         ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS two,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS three, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS four FROM cut),
formed AS (
  SELECT *, least(one, two) AS a, greatest(one, two) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR three >= 50
              THEN 'plain' WHEN four < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix,
         coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query("op12_fim", SQL)
def op12_fim(t):
    digest = [F.sha2(c.cast("binary"), 256) for c in (F.col("output"), restored())]
    return fill_in_middle(t.documents).select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest[0].alias("output_sha256"),
        digest[1].alias("restored_sha256"))
