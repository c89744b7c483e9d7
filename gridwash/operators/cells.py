"""Projection, filtering and cell edits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwash.functions.text import change_case
from gridwash.functions.values import parse_number, standardize_date


def quoted(name: str) -> Column:
    """Column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def actual(df: DataFrame, name: str) -> str:
    """The column's name as the table spells it; names match in any case, as everywhere in Spark."""
    if name in df.columns:
        return name
    hits = [c for c in df.columns if c.lower() == name.lower()]
    if len(hits) == 1:
        return hits[0]
    df.select(quoted(name))  # fails with Spark's own message
    return name


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in columns])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns; unlike in Spark, one that is not there is an error."""
    return df.drop(*[actual(df, c) for c in columns])


def rename_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """New names in place; order and other columns stay. A name that is not there is an error, as in ``drop_columns``."""
    return df.withColumnsRenamed({actual(df, old): new for old, new in columns.items()})


def add_columns(df: DataFrame, columns: Sequence[Mapping[str, str]]) -> DataFrame:
    """Computed columns, in order. An existing name is overwritten where it stands."""
    for item in columns:
        df = df.withColumn(item["name"], F.expr(item["expr"]))
    return df


def filter_rows(df: DataFrame, where: str | Sequence[str]) -> DataFrame:
    """Rows for which every predicate holds."""
    for predicate in [where] if isinstance(where, str) else where:
        df = df.filter(F.expr(predicate))
    return df


def filter_text(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Case-insensitive LIKE."""
    return df.filter(quoted(column).ilike(pattern))


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL in the named columns, by default in any column."""
    names = list(columns) if columns else df.columns
    condition = F.lit(True)
    for name in names:
        condition = condition & quoted(name).isNotNull()
    return df.filter(condition)


def _with_value(cell: Column, kind: T.DataType, value: Any) -> tuple[Column, Column]:
    """Cell and value brought to one type that loses nothing of either.

    A value that the column's type holds takes that type. A number it cannot hold, such as 0.9 among whole numbers, widens
    the column to double, or a decimal column to one with more digits while 38 are enough; a text that spells no number does
    not fit a column of numbers and is an error.
    """
    if value is None or not isinstance(kind, T.NumericType):
        return cell, F.lit(value).cast(kind)
    if isinstance(value, str):
        try:
            value = int(value)
        except ValueError:
            value = float(value)
    whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
    if isinstance(kind, T.DecimalType) and math.isfinite(value):
        exact = Decimal(repr(value) if isinstance(value, float) else value)
        _, digits, exponent = exact.normalize().as_tuple()
        scale = max(kind.scale, -exponent)
        wider = T.DecimalType(max(kind.precision - kind.scale, len(digits) + exponent) + scale, scale) if (
            max(kind.precision - kind.scale, len(digits) + exponent) + scale <= 38) else T.DoubleType()
        return cell.cast(wider), F.lit(str(exact)).cast(wider)
    if isinstance(kind, T.DecimalType):
        return cell.cast("double"), F.lit(value)
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}.get(type(kind))
    if bits is None or whole and -(1 << bits - 1) <= value < 1 << bits - 1:
        return cell, F.lit(value).cast(kind)
    return cell.cast("double"), F.lit(float(value))


def fill_nulls(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Replace NULL in a column, keeping its type where that holds the value."""
    column = actual(df, column)
    return df.withColumn(column, F.coalesce(*_with_value(quoted(column), df.schema[column].dataType, value)))


def update_cells(df: DataFrame, values: Mapping[str, Any], where: str | Sequence[str] | None = None) -> DataFrame:
    """Set cells on matching rows and return all rows; an unknown predicate changes nothing."""
    predicates = [where] if isinstance(where, str) else list(where or [])
    matches = F.lit(True)
    for predicate in predicates:
        matches = matches & F.expr(predicate)
    named = {actual(df, name): value for name, value in values.items()}
    edits = {}
    for name, value in named.items():
        cell, new = _with_value(quoted(name), df.schema[name].dataType, value)
        edits[name] = F.when(matches, new).otherwise(cell)
    return df.withColumns(edits)


def concat_columns(df: DataFrame, columns: Sequence[str], name: str, separator: str = "") -> DataFrame:
    """Joined text; NULL if any part is NULL."""
    parts: list[Column] = []
    for i, column in enumerate(columns):
        if i and separator:
            parts.append(F.lit(separator))
        parts.append(quoted(column).cast("string"))
    return df.withColumn(name, F.concat(*parts))


def round_columns(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(quoted(c), digits) for c in [actual(df, n) for n in columns]})


def cast_column(df: DataFrame, column: str, dtype: str, lenient: bool = False) -> DataFrame:
    """Strict casts fail the job on a bad value; lenient ones give NULL."""
    column = actual(df, column)
    cell = quoted(column)
    return df.withColumn(column, cell.try_cast(dtype) if lenient else cell.cast(dtype))


def cast_failures(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """How many values a lenient cast would lose, without showing any of them."""
    cell = quoted(column)
    lost = cell.isNotNull() & cell.try_cast(dtype).isNull()
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(lost).alias("failed_rows"))


def normalize_case(df: DataFrame, columns: Sequence[str], style: str) -> DataFrame:
    return df.withColumns({c: change_case(quoted(c), style) for c in [actual(df, n) for n in columns]})


def standardize_dates(df: DataFrame, column: str, formats: Sequence[str], name: str | None = None) -> DataFrame:
    return df.withColumn(name or actual(df, column), standardize_date(quoted(column), formats))


def unparsed_dates(df: DataFrame, column: str, formats: Sequence[str]) -> DataFrame:
    """How many filled cells no format fits."""
    cell = quoted(column)
    lost = (F.coalesce(cell, F.lit("")) != "") & standardize_date(cell, formats).isNull()
    return df.agg(F.count(cell).alias("filled_rows"), F.count_if(lost).alias("unparsed_rows"))


def parse_numbers(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or actual(df, column), parse_number(quoted(column)))


def numeric_share(df: DataFrame) -> DataFrame:
    """Share of the filled cells of each column that read as numbers, over the whole table."""
    from gridwash.functions.values import numeric_like
    cells = []
    for i, name in enumerate(df.columns):
        cells += [F.count_if(numeric_like(quoted(name))).alias(f"n{i}"), F.count(quoted(name)).alias(f"c{i}")]
    one = df.agg(*cells)
    rows = F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"n{i}").alias("numeric_cells"),
                              F.col(f"c{i}").alias("filled_cells")) for i, name in enumerate(df.columns)])
    return (one.select(F.inline(rows))
               .withColumn("numeric_share", F.round(F.try_divide(F.col("numeric_cells").cast("double"),
                                                                  F.col("filled_cells").cast("double")), 4)))
