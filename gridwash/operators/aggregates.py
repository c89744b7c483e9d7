"""Grouping, pivoting and chart series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwash.functions.values import percent
from gridwash.operators.cells import quoted
from gridwash.operators.segments import exact_median, join_same

_FUNCTIONS = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max,
    "count_distinct": F.count_distinct, "nunique": F.count_distinct,
}


def group_agg(df: DataFrame, by: Sequence[str], aggs: Sequence[Mapping[str, str]]) -> DataFrame:
    """Keys, then one ``<col>_<fn>`` column per request, in request order.

    ``median`` goes through the exact median that splits large groups; an
    ``as`` entry overrides the name and ``*`` counts rows.
    """
    plain: list[Column] = []
    medians: list[tuple[str, str]] = []
    names: list[str] = []
    for item in aggs:
        column, fn = item["col"], item["fn"].lower()
        name = item.get("as") or f"{'rows' if column == '*' else column}_{fn}"
        names.append(name)
        if fn == "median":
            medians.append((column, name))
        elif fn in _FUNCTIONS:
            plain.append(_FUNCTIONS[fn](F.lit(1) if column == "*" else quoted(column)).alias(name))
        else:
            raise ValueError(f"unknown aggregate {fn!r}")
    out = df.groupBy(*[quoted(b) for b in by]).agg(*(plain or [F.count(F.lit(1)).alias("_rows")]))
    for column, name in medians:
        values = exact_median(df, by, column, name)
        out = join_same(out, values, by, "left") if by else out.withColumn(name, values.scalar())
    return out.select(*[quoted(c) for c in [*by, *names]])


def filled_percentages(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL count and percentage of each column, from one scan."""
    one = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_count"))
                     for i, c in enumerate(columns)])
    return (one.select("rows", F.inline(rows))
               .select("column", "null_count",
                       F.when(F.col("rows") > 0, percent(F.col("null_count"), F.col("rows"))).alias("null_pct")))


def pivot_table(df: DataFrame, by: Sequence[str], on: str, values: Sequence, agg: Column,
                prefix: str = "") -> DataFrame:
    """One column per listed value; rows with another or no value add nothing.

    The value list is part of the step, so no extra job looks for it.
    """
    wide = (df.filter(quoted(on).isNotNull())
              .groupBy(*[quoted(b) for b in by]).pivot(on, list(values)).agg(agg))
    return wide.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values}) if prefix else wide


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> list:
    """Pivot values when the caller has none, so as many as the result gets columns; refuses more than ``limit``."""
    values = df.select(quoted(column)).filter(quoted(column).isNotNull()).distinct()
    rows = (values if limit is None else values.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values; a table may not have that many columns")
    return sorted(r[0] for r in rows)


def chart_series(df: DataFrame, x: str, y: str, mode: str, order_by: str,
                 limit: int | None = None) -> DataFrame:
    """Label and value of all groups, or the first ``limit`` in row order; text that is no number counts as 0."""
    number = F.coalesce(F.nanvl(quoted(y).cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0))
    modes = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}
    groups = (df.groupBy(F.coalesce(quoted(x).cast("string"), F.lit("null")).alias("label"))
                .agg(F.round(modes[mode](number).cast("double"), 2).alias("value"), F.min(order_by).alias("_first")))
    ordered = groups.orderBy("_first", "label")
    return (ordered if limit is None else ordered.limit(limit)).drop("_first")
