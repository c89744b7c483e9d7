"""Duplicate removal and counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwash.operators.cells import quoted
from gridwash.operators.naming import unused
from gridwash.operators.segments import sort_columns


def distinct_rows(df: DataFrame) -> DataFrame:
    """One copy of each row. Copies are removed before the shuffle as well as after it."""
    return df.distinct()


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | tuple[str, str]],
                  blank_is_null: bool = False) -> DataFrame:
    """The first full row per key.

    Spark keeps one row per key in every map task before the shuffle
    (WindowGroupLimit), so a key with very many rows sends one row per task.
    """
    if not keys:
        raise ValueError("first_per_key needs at least one key")
    if not order_by:
        raise ValueError("first_per_key needs an order; a table has none of its own")
    parts = [F.coalesce(quoted(k).cast("string"), F.lit("")) if blank_is_null else quoted(k) for k in keys]
    window = Window.partitionBy(*parts).orderBy(*sort_columns(order_by))
    nth = unused(df, "_rn")[0]
    return df.withColumn(nth, F.row_number().over(window)).filter(F.col(nth) == 1).drop(nth)


def keep_first(df: DataFrame, order_by: Sequence[str | tuple[str, str]],
               keys: Sequence[str] | None = None) -> DataFrame:
    """First row of each group of equal keys in file order; a missing cell equals empty text.

    Without keys the whole row counts, apart from the columns that carry the order.
    """
    ordering = [o if isinstance(o, str) else o[0] for o in order_by]
    names = list(keys) if keys else [c for c in df.columns if c not in ordering]
    return first_per_key(df, names, order_by, blank_is_null=True)


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows kept and removed by :func:`keep_first`."""
    groups = (df.groupBy(*[F.coalesce(quoted(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)])
                .agg(F.count(F.lit(1)).alias("_n")))
    return groups.agg(F.count(F.lit(1)).alias("kept"),
                      (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("removed"))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows; NULLs compare equal."""
    groups = df.groupBy(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(df.columns)]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg((F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_rows"))
