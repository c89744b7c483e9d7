"""Sorting, limits, paging and exact row positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwash.operators.cells import quoted
from gridwash.operators.naming import unused
from gridwash.operators.segments import any_rows, row_index, sort_columns, tie_break

# A top-n of this size is merged in one task; more rows go through the row index.
SMALL_LIMIT = 100_000


def sort_rows(df: DataFrame, sort: Sequence[str | tuple[str, str] | dict], spread_ties: bool = True) -> DataFrame:
    """NULLs last in both directions. Rows with equal keys spread over range partitions.

    Without ``spread_ties`` all rows of one key go to one task, which is fine for keys that are nearly unique.
    """
    order = [(s["col"], s.get("dir", "asc")) if isinstance(s, dict) else s for s in sort]
    return df.orderBy(*sort_columns(order), *([tie_break(df)] if spread_ties else []))


def grid_sort(df: DataFrame, column: str, direction: str = "asc", locale: str | None = None) -> DataFrame:
    """Sort by one column: numbers as numbers, text optionally by the rules of a locale, NULLs last."""
    cell = quoted(column)
    if locale and dict(df.dtypes)[column] == "string":
        cell = F.collate(cell, locale)
    key = cell.desc_nulls_last() if direction == "desc" else cell.asc_nulls_last()
    return df.orderBy(key, tie_break(df))


def top_n(df: DataFrame, sort: Sequence[str | tuple[str, str]], n: int) -> DataFrame:
    """The first n rows in the given order; the same total order, ties by hash, whatever n is."""
    if n <= SMALL_LIMIT:
        return df.orderBy(*sort_columns(sort), tie_break(df)).limit(n)
    at = unused(df, "_at")[0]
    return row_index(df, sort, at).filter(F.col(at) < n).drop(at)


def cap_rows(df: DataFrame, n: int = 1_000_000, order_by: Sequence[str | tuple[str, str]] | None = None) -> DataFrame:
    """At most n rows: the first in order, or any n when the table has no order."""
    if order_by:
        return top_n(df, order_by, n)
    return df.limit(n) if n <= SMALL_LIMIT else any_rows(df, n)


def number_parts(df: DataFrame, order_by: Sequence[str | tuple[str, str]], rows_per_part: int = 1_000_000,
                 name: str = "part") -> DataFrame:
    """Part number from 1 so that every part but the last has exactly ``rows_per_part`` rows."""
    size = max(1, int(rows_per_part))
    at = unused(df, "_at")[0]
    return row_index(df, order_by, at).withColumn(name, F.expr(f"`{at}` div {size} + 1")).drop(at)


SORTABLE = {"created_at", "name", "row_count"}


def paginate(df: DataFrame, q: str | None = None, sort: str = "created_at", direction: str = "desc",
             page: int = 1, page_size: int = 20, tie: str = "id", max_page_size: int = 100) -> DataFrame:
    """One page of a listing with the total number of matches on each row.

    Expects columns ``name``, ``created_at``, ``row_count`` and a unique ``tie``.
    Unknown sort columns fall back to created_at, unknown directions to desc, and sizes to 1 to ``max_page_size``.
    """
    sort, direction = (sort or "").strip().lower(), (direction or "").strip().lower()
    sort = sort if sort in SORTABLE else "created_at"
    direction = direction if direction in ("asc", "desc") else "desc"
    size = min(max(int(page_size), 1), max_page_size)
    page = max(int(page), 1)
    matches = df.filter(quoted("name").ilike(f"%{q}%")) if q else df
    total = matches.agg(F.count(F.lit(1)).alias("total"))
    rows = page_of(matches, [(sort, direction), tie], page, size)
    return rows.withColumn("total", total.scalar())


def page_of(df: DataFrame, order_by: Sequence[str | tuple[str, str]], page: int, page_size: int) -> DataFrame:
    """Rows of one page; a page far into the table is found by row index, not by sorting up to it in one task."""
    start = (page - 1) * page_size
    if start + page_size <= SMALL_LIMIT:
        return df.orderBy(*sort_columns(order_by), tie_break(df)).offset(start).limit(page_size)
    at = unused(df, "_at")[0]
    return row_index(df, order_by, at).filter(F.col(at).between(start, start + page_size - 1)).drop(at)


def latest_for_parent(df: DataFrame, parent: str, value, order_by: Sequence[str | tuple[str, str]],
                      page: int = 1, page_size: int = 20) -> DataFrame:
    """A page of one parent's entries in the given order, newest first as a rule."""
    return page_of(df.filter(quoted(parent) == F.lit(value)), order_by, max(page, 1), page_size)
