"""Text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a browser's trim() removes: tab to carriage return, blank, no-break and Ogham
# space, en quad to hair space, line and paragraph separators, narrow no-break, medium mathematical and
# ideographic space, byte order mark.
WHITE_SPACE = ("\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000\ufeff")

# The characters that end a line.
LINE_END = r"[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
# Fixed value: the fence lines around a code block.
CODE_FENCE = r"(?m)^```(?:sql)?\s*|\s*```$"
REDACTED = "'<redacted>'"
MAX_ERROR_LENGTH = 500


def trim_ws(c: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.trim(c, F.lit(WHITE_SPACE))


def collapse_spaces(c: Column) -> Column:
    """Runs of blanks become one blank."""
    return F.regexp_replace(c, " {2,}", " ")


def change_case(c: Column, style: str) -> Column:
    styles = {"upper": F.upper, "lower": F.lower, "title": F.initcap}
    if style not in styles:
        raise ValueError(f"unknown case style {style!r}; use one of {sorted(styles)}")
    return styles[style](c)


def redact_literals(c: Column, redact: bool = True) -> Column:
    """First line of an error text, quoted values hidden, then cut to 500 characters.

    Hiding comes before cutting: a cut inside a quoted value would lose its
    closing quote and leak the rest.
    """
    body = trim_ws(c)
    line = F.split(body, LINE_END, 2).getItem(0)
    if redact:
        line = F.regexp_replace(line, r"'[^']*+(?:''[^']*+)*'", REDACTED)
    return (F.when(c.isNull() | (body == ""), F.lit("execution failed"))
             .otherwise(F.substring(line, 1, MAX_ERROR_LENGTH)))


def base_name(c: Column) -> Column:
    """Drop the last extension of a path."""
    return F.regexp_replace(c, r"\.[^/.]+$", "")


def extension(c: Column) -> Column:
    """Lower-case text after the last dot of a file name, empty when there is none; dots of folders do not count."""
    name = F.substring_index(c, "/", -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def strip_fences(c: Column) -> Column:
    """A stored SQL text without code fences, trailing semicolons and outer white space."""
    body = trim_ws(c)
    unfenced = F.when(body.startswith("```"), trim_ws(F.regexp_replace(body, CODE_FENCE, "")))
    return trim_ws(F.regexp_replace(unfenced.otherwise(body), r";+$", ""))
