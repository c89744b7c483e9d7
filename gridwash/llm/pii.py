"""Personal data in texts. DataFrame operations only; no shuffle at all.

Regular expressions propose spans, validators confirm them (digit counts, the range of address parts, Luhn, mod 97), and
words that stand near a span adjust its score. Spans of the base kinds stay once confirmed; those of the further kinds
also need a score of at least ``THRESHOLD``.

A text is cut at the matches of a pattern, so positions are sums of the lengths of the pieces, and the neighbourhood of a
match is the end of the piece before and the beginning of the piece after it. Sums run in two levels, over blocks of matches,
since appending to an array copies it: time is linear in the matches for every text that fits a row. Patterns cannot run over the same
characters again and again: repeats are possessive, and a match starts only where a run starts or the last match ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwash.llm.common import text_of

THRESHOLD = 0.5
NEAR = 40  # characters on each side that are searched for context words
CONTEXT = 0.3  # what a context word adds to a score
BLOCK = 256  # matches, or pieces of a masked text, that are put together at a time
CHUNK = 1024  # characters of the parts that a text is cut in for masking, as a position in a long text is found from its start
SPAN = "array<struct<kind:string,start:int,end:int,score:double,value:string>>"


@dataclass(frozen=True)
class Kind:
    """How spans of one kind are found. ``confirm`` is SQL over ``m``, the matched text; ``hint`` is a cheap first test."""

    name: str
    pattern: str
    hint: str
    confirm: str
    score: float
    words: str
    base: bool = True


def _digits(least: int, most: int) -> str:
    return f"length(regexp_replace(m, '[^0-9]', '')) BETWEEN {least} AND {most}"


# From the right, every second digit doubled, with 9 taken off two-digit results; the sum ends in 0.
LUHN = """pmod(aggregate(sequence(1, length(regexp_replace(m, '[^0-9]', ''))), 0, (s, i) -> s + CASE
  WHEN i % 2 = 1 THEN int(substring(regexp_replace(m, '[^0-9]', ''), -i, 1))
  ELSE int(element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), 1 + int(substring(regexp_replace(m, '[^0-9]', ''), -i, 1)))) END),
  10) = 0"""
# The first four characters move to the end, letters count from 10, and the number leaves 1 when divided by 97.
MOD_97 = """aggregate(filter(split(concat(substring(replace(m, ' ', ''), 5), substring(replace(m, ' ', ''), 1, 4)), ''),
  c -> c <> ''), 0, (s, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN (s * 10 + int(c)) % 97
  ELSE (s * 100 + ascii(c) - 55) % 97 END) = 1"""
LOCAL = "A-Za-z0-9._%+-"

KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true",
         0.9, "e-?mail|mail|contact|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "t RLIKE '[0-9]'",
         "m RLIKE '^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:[.]|$)){4}$'", 0.6, "ip|address|host|server"),
    # A whole run of digits with single separators. Shorter runs than 13 digits are no cards, so they are not proposed.
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,}+", "t RLIKE '[0-9]'",
         f"{_digits(13, 19)} AND {LUHN}", 0.7, "card|credit|visa|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')", _digits(9, 15), 0.7,
         "phone|call|tel|mobile|fax|telefon"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", "t RLIKE '[0-9]'", MOD_97,
         0.8, "iban|bank|account|konto", base=False),
    # Nothing but the neighbourhood tells such a number from any other, so a context word is needed.
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "t RLIKE '[0-9]'", "true", 0.3, "ssn|social security", base=False),
)


def _sql(text: str) -> str:
    """A regular expression as a SQL literal."""
    return "r'" + text.replace("'", "\\x27") + "'"


def _running(items: str, start: str, entry: str, step: str) -> str:
    """SQL of an array with one ``entry`` per element ``x`` of ``items``, and a number ``at`` carried from each to the next.

    ``step`` gives ``item`` and the new ``at`` from ``a.at`` and ``x``. Elements are appended to arrays of at most ``BLOCK``.
    """
    inner = f"""aggregate(slice(all_items, block * {BLOCK} + 1, {BLOCK}),
        struct(b.at AS at, CAST(array() AS array<{entry}>) AS found),
        (a, x) -> transform(array({step}), r -> struct(r.at AS at, concat(a.found, array(r.item)) AS found))[0])"""
    return f"""transform(array({items}), all_items -> flatten(aggregate(sequence(0, (size(all_items) - 1) div {BLOCK}),
        struct({start} AS at, CAST(array() AS array<array<{entry}>>) AS blocks),
        (b, block) -> transform(array({inner}), r -> struct(r.at AS at, concat(b.blocks, array(r.found)) AS blocks))[0],
        b -> b.blocks)))[0]"""


def _spans(kind: Kind) -> Column:
    """Confirmed spans of one kind in text ``t``."""
    pattern = _sql(kind.pattern)
    pieces, matches = f"split(t, {pattern}, -1)", f"regexp_extract_all(t, {pattern}, 0)"
    proposed = f"""transform(zip_with(zip_with({matches}, slice({pieces}, 1, size({pieces}) - 1), (m, p) -> struct(m, p)),
        slice({pieces}, 2, size({pieces})), (x, n) -> struct(x.m AS m, x.p AS p, n AS n)),
        x -> struct(length(x.p) AS ahead, length(x.m) AS long, x.m AS m, right(x.p, {NEAR}) AS p, left(x.n, {NEAR}) AS n))"""
    entry = "struct<start:int,end:int,m:string,p:string,n:string>"
    placed = _running(proposed, "0", entry, """struct(struct(a.at + x.ahead AS start, a.at + x.ahead + x.long AS end,
        x.m AS m, x.p AS p, x.n AS n) AS item, a.at + x.ahead + x.long AS at)""")
    score = f"""least(1D, {kind.score}D + CASE WHEN concat(x.p, '\\n', x.n) RLIKE {_sql(rf"(?i)(?<![A-Za-z])(?:{kind.words})(?![A-Za-z])")}
        THEN {CONTEXT}D ELSE 0D END)"""
    confirmed = f"filter({placed}, x -> {kind.confirm.replace('(m', '(x.m').replace('m RLIKE', 'x.m RLIKE')})"
    spans = f"""transform({confirmed}, x -> struct('{kind.name}' AS kind, x.start AS start, x.end AS end,
        {score} AS score, x.m AS value))"""
    if not kind.base:
        spans = f"filter({spans}, y -> y.score >= {THRESHOLD})"
    return F.expr(f"CASE WHEN {kind.hint} AND t RLIKE {pattern} THEN CAST({spans} AS {SPAN}) ELSE CAST(array() AS {SPAN}) END")


def find_pii(docs: DataFrame, text_column: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with an array of spans: kind, start, end (code points, end exclusive), score and value.

    Spans are ordered by kind, as in ``KINDS``, then by start. NULL and empty texts have none. Kinds may overlap. All
    other columns stay, repeated rows too; ``name`` must not be taken. An empty table stays empty.
    """
    if name.lower() in [c.lower() for c in docs.columns]:
        raise ValueError(f"column {name} exists")
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = docs.select(kept, text_of(text_column).alias("t")).select("row", F.concat(*[_spans(k) for k in KINDS]).alias("s"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("s").alias(name))


def base_kinds() -> list[str]:
    return [k.name for k in KINDS if k.base]


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first.

    A NULL text stays NULL and a text without spans stays as it is.
    """
    name = "spans_" + "_".join(docs.columns)  # cannot be a column of docs, being longer than each
    spans = f"array_sort(transform(`{name}`, s -> struct(s.start AS start, -s.end AS upto, s.kind AS kind)))"
    # What stands before a span, from the one or more parts of the text that hold it.
    piece = f"""substring(array_join(slice(chunks, a.at div {CHUNK} + 1, (x.start - 1) div {CHUNK} - a.at div {CHUNK} + 1), ''),
        a.at % {CHUNK} + 1, x.start - a.at)"""
    pieces = _running(spans, "0", "string", f"""CASE WHEN x.start < a.at THEN struct('' AS item, greatest(a.at, -x.upto) AS at)
        ELSE struct(concat(CASE WHEN x.start > a.at THEN {piece} ELSE '' END, '[', upper(x.kind), ']') AS item, -x.upto AS at) END""")
    masked = f"""transform(array(regexp_extract_all(`{text_column}`, '(?s).{{1,{CHUNK}}}', 0)), chunks -> concat(array_join({pieces}, ''),
        substring(`{text_column}`, 1 + array_max(transform(`{name}`, s -> s.end)))))[0]"""
    found = find_pii(docs, text_column, name)
    text = F.when(F.size(F.col(f"`{name}`")) > 0, F.expr(masked)).otherwise(F.col(f"`{text_column}`"))
    return found.select(*[text.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns])
