"""Whole-table tidying: trim, blanks, empty rows and columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwash.functions.text import WHITE_SPACE, collapse_spaces, trim_ws
from gridwash.operators.cells import quoted


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _has_value(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit("")) != ""


def _cleaned(name: str, trim: bool, collapse: bool) -> Column:
    cell = quoted(name)
    if trim:
        cell = trim_ws(cell)
    return collapse_spaces(cell) if collapse else cell


def clean_text(df: DataFrame, columns: Sequence[str] | None = None, trim: bool = True,
               collapse: bool = False) -> DataFrame:
    """Trim text cells and, on request, collapse runs of blanks."""
    names = list(columns) if columns is not None else text_columns(df)
    return df.withColumns({n: _cleaned(n, trim, collapse) for n in names})


def cleaned_header(name: str, trim: bool = True, collapse: bool = False) -> str:
    """A column name cleaned as a text cell is."""
    name = name.strip(WHITE_SPACE) if trim else name
    return re.sub(" {2,}", " ", name) if collapse else name


def clean_headers(df: DataFrame, trim: bool = True, collapse: bool = False) -> DataFrame:
    """Clean the column names like cells."""
    return df.toDF(*[cleaned_header(c, trim, collapse) for c in df.columns])


def drop_empty_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with at least one filled cell; NULL and empty text are both empty."""
    return df.filter(reduce(lambda a, b: a | b, [_has_value(c) for c in columns or df.columns]))


def filled_counts(df: DataFrame) -> DataFrame:
    """One row per column with its number of filled cells, from one scan."""
    one = df.agg(*[F.count_if(_has_value(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("filled_cells"))
                     for i, c in enumerate(df.columns)])
    return one.select(F.inline(rows))


def drop_empty_columns(df: DataFrame, ignore_header: bool = False) -> DataFrame:
    """Drop columns without a value in any row.

    A named column is kept even when empty unless ``ignore_header`` is set. Which
    columns stay decides the schema, so this runs one job for one row of counts.
    """
    candidates = [c for c in df.columns if ignore_header or not c.strip()]
    if not candidates:
        return df
    counts = df.agg(*[F.max(_has_value(c)).alias(f"c{i}") for i, c in enumerate(candidates)]).first()
    empty = [c for i, c in enumerate(candidates) if not counts[i]]
    return df.drop(*empty)


def clean_report(df: DataFrame, trim: bool = True, collapse: bool = False) -> DataFrame:
    """Cells touched (headers included), empty rows and columns removed by a cleaning run, in one scan."""
    names = text_columns(df)
    headers = sum(cleaned_header(c, trim, collapse) != c for c in df.columns)
    changed = [F.when(quoted(n) != _cleaned(n, trim, collapse), 1).otherwise(0) for n in names]
    touched = reduce(lambda a, b: a + b, changed, F.lit(0))
    after = [F.coalesce(_cleaned(c, trim, collapse) if c in names else quoted(c).cast("string"), F.lit("")) != ""
             for c in df.columns]
    filled = reduce(lambda a, b: a | b, after)
    blank_headers = [flag for c, flag in zip(df.columns, after) if not c.strip()]
    empty_columns = reduce(lambda a, b: a + b,
                           [F.when(F.coalesce(F.max(flag), F.lit(False)), 0).otherwise(1) for flag in blank_headers],
                           F.lit(0))
    return df.agg((F.coalesce(F.sum(touched), F.lit(0)) + headers).cast("bigint").alias("cells_touched"),
                  F.count_if(~filled).alias("rows_removed"),
                  empty_columns.cast("bigint").alias("columns_removed"))
