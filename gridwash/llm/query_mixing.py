"""op1: the mix of all documents."""

from pyspark.sql import functions as F

from gridwash.llm.mixing import HALF_WORDS, RANDOM_DIGITS, TILT, mix
from gridwash.llm.queries import query

SQL = rf"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
pref AS (SELECT *, size * 1000 // (size + {HALF_WORDS}) AS p FROM base),
totals AS (
  SELECT source, sum(size)::BIGINT AS s, sum(size * p)::BIGINT AS sp,
         [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM pref GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY 3 * s / w, source) AS k, sum(s) OVER ()::BIGINT AS t, sum(w) OVER ()::BIGINT AS ws
  FROM totals),
levels AS (  -- words per unit of weight if the sources before this one stop at their limit
  SELECT *, (t - (3 * (sum(s) OVER (ORDER BY k) - s))::BIGINT) / (ws - (sum(w) OVER (ORDER BY k) - w))::BIGINT AS level
  FROM ordered),
chosen AS (SELECT coalesce(min_by(level, k) FILTER (level * w <= 3 * s), 0) AS level FROM levels),
targets AS (
  SELECT o.source, s, least(w * c.level, (3 * s)::DOUBLE) AS target, CASE WHEN s > 0 THEN sp / s ELSE 0 END AS pbar
  FROM ordered o, chosen c),
rated AS (
  SELECT d.doc_id, d.source, d.size, d.p, t.s, t.target, t.pbar, CASE WHEN t.s > 0 THEN t.target / t.s ELSE 0.0 END AS rate,
         (('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, {RANDOM_DIGITS}))::BIGINT::DOUBLE + 0.5)
           / {float(16 ** RANDOM_DIGITS)}::DOUBLE AS u
  FROM pref d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
expected AS (
  SELECT *, greatest(0.0, least(3.0, rate + least(rate, 3 - rate) * {TILT / 1000}::DOUBLE * (p - pbar))) AS e FROM rated),
odds AS (
  SELECT *, floor(e)::BIGINT AS c, e - floor(e) AS chance,
         CASE WHEN e > floor(e) THEN u * (1 - (e - floor(e))) / ((1 - u) * (e - floor(e))) END AS q FROM expected),
placed AS (
  SELECT *, target - sum(c * size) OVER (PARTITION BY source)::BIGINT AS rest,
         sum(CASE WHEN q IS NULL THEN 0 ELSE size END)
           OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM odds)
SELECT doc_id, size, s AS source_size, target,
       ((c + CASE WHEN q IS NOT NULL AND upto - size / 2 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""


@query("op1_mixing", SQL)
def op1_mixing(t):
    # The sums of a source are compared as whole numbers, so the bins of the operator leave no trace in the result.
    return mix(t.documents).select(
        F.col("id").alias("doc_id"), F.col("words").alias("size"), F.col("source_words").alias("source_size"), "target",
        (F.col("copies") * F.col("words")).cast("long").alias("taken"))
