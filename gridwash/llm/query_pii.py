"""op2: personal data in all documents."""

from pyspark.sql import functions as F

from gridwash.llm.pii import CONTEXT, NEAR, THRESHOLD, base_kinds, find_pii, listed
from gridwash.llm.queries import query

# The SQL uses the plain patterns; the kinds below are those of the operator with their order, scores and context words.
_MATCHES = """
  SELECT doc_id, '{kind}' AS kind, {nth} AS nth, m, p, n,
         sum(length(p) + length(m)) OVER (PARTITION BY doc_id, rowid ORDER BY i)::BIGINT AS stop
  FROM (SELECT doc_id, rowid, unnest(ms) AS m, unnest(ps[:-2]) AS p, unnest(ps[2:]) AS n,
               generate_subscripts(ms, 1) AS i
        FROM (SELECT doc_id, rowid, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps
              FROM texts WHERE regexp_matches(t, '{pattern}')))"""
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
SQL = rf"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS rowid, coalesce(text, '') AS t FROM documents),
proposed AS ({" UNION ALL ".join(_MATCHES.format(kind=k, nth=i, pattern=p) for i, (k, p) in enumerate(_PATTERNS.items()))}),
cleaned AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS c,
                   right(p, {NEAR}) || chr(10) || left(n, {NEAR}) AS near FROM proposed),
confirmed AS (
  SELECT doc_id, kind, nth, stop - length(m) AS start, stop FROM cleaned
  WHERE CASE kind
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(
                   try_cast(x AS HUGEINT), 0) <= 255))
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN substr(d, length(d) - i + 1, 1)::INT
           ELSE substr(d, length(d) - i + 1, 1)::INT * 2 - CASE WHEN substr(d, length(d) - i + 1, 1)::INT > 4 THEN 9 ELSE 0 END
      END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    WHEN 'iban' THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''),
      lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x::BIGINT ELSE ascii(x) - 55 END)),
      lambda s, x: (s * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
    WHEN 'ssn' THEN regexp_matches(near, '(?i)(^|[^A-Za-z])(ssn|social security)([^A-Za-z]|$)')
      AND 0.3 + {CONTEXT} >= {THRESHOLD}
    ELSE true END),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY nth, start) FILTER (nth < 4) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY nth, start) AS spans
  FROM confirmed GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


@query("op2_pii", SQL)
def op2_pii(t):
    found = find_pii(t.documents.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(base_kinds()))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in base_kinds()]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
