"""Dates, numbers and casts that tolerate bad input."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy")


def _shape(fmt: str) -> str:
    """A pattern that every text of the format meets: digits, words and the marks between them."""
    out = []
    for letters, mark in re.findall(r"([A-Za-z])\1*|('[^']*'|[^A-Za-z])", re.sub(r"M{3,}", "L", fmt)):
        if letters:
            out.append(r"[+-]?\d+" if letters in "yMdHms" else r"\D+" if letters == "L" else ".*")
        else:
            out.append(re.escape(mark.strip("'")) if len(mark) > 1 else re.escape(mark))
    return f"^{''.join(out)}$"


def standardize_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that parses wins, else NULL. Day or month first is the caller's choice of format.

    Parsing a text that does not fit costs an exception per row, so its shape is looked at first.
    """
    return F.coalesce(*[F.when(c.rlike(_shape(f)), F.to_date(F.try_to_timestamp(c, F.lit(f)))) for f in formats])


# Digits, at most one point, an exponent. Spark's cast alone would also take Java's number suffixes, as in '5d' or '12F'.
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def text_as_number(c: Column) -> Column:
    """The number that a text spells, else NULL."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def parse_number(c: Column, group_mark: str = ",") -> Column:
    """'1,240.50' to 1240.5; NULL when no number is left."""
    return text_as_number(F.replace(F.trim(c), F.lit(group_mark), F.lit("")))


def month_of(c: Column) -> Column:
    """'2024-03', from the numbers rather than through a date formatter."""
    return F.concat(F.lpad(F.year(c).cast("string"), 4, "0"), F.lit("-"), F.lpad(F.month(c).cast("string"), 2, "0"))


def numeric_like(c: Column) -> Column:
    """Whether a cell is a number or the text of one."""
    return F.coalesce(c.cast("string").rlike(NUMBER), F.lit(False))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.lit(100.0) * part.cast("double") / whole.cast("double"), digits)
