"""Column profiles, data-quality findings and schema cards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridwash.functions.values import percent
from gridwash.operators.aggregates import filled_percentages
from gridwash.operators.cells import quoted
from gridwash.operators.duplicates import duplicate_row_count

SUGGEST_ABOVE_PCT = 10
SAMPLE_VALUES = 5
PREVIEW_ROWS = 500


def _text(name: str, kind: T.DataType) -> Column:
    """A cell as text, so that values of all columns fit one column."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(quoted(name))
    return quoted(name).cast("string")


def melted(df: DataFrame) -> DataFrame:
    """One row per cell: column position and text."""
    cells = F.array(*[F.struct(F.lit(i).alias("position"), _text(f.name, f.dataType).alias("value"))
                      for i, f in enumerate(df.schema.fields)])
    return df.select(F.inline(cells))


def value_counts(df: DataFrame) -> DataFrame:
    """How often each value occurs in each column; counted before the shuffle as well as after it."""
    return melted(df).groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))


def _names(df: DataFrame) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"),
                              F.lit(f.dataType.simpleString()).alias("dtype"))
                     for i, f in enumerate(df.schema.fields)])


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Name, type, share of NULLs, distinct values and, if exact, the first sample values per column.

    Exact: one scan feeds one count per (column, value), which yields every
    figure. ``approx`` needs no shuffle of values (HyperLogLog) and no samples.
    """
    if approx:
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, field in enumerate(df.schema.fields):
            cell = quoted(field.name) if isinstance(field.dataType, T.AtomicType) else _text(field.name, field.dataType)
            aggs += [F.count_if(cell.isNull()).alias(f"n{i}"), F.approx_count_distinct(cell).alias(f"u{i}")]
        one = df.agg(*aggs)
        rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"),
                                  F.lit(f.dataType.simpleString()).alias("dtype"),
                                  F.when(F.col("rows") > 0, percent(F.col(f"n{i}"), F.col("rows"))).alias("null_pct"),
                                  F.col(f"u{i}").alias("unique_count"))
                         for i, f in enumerate(df.schema.fields)])
        return one.select(F.inline(rows))

    counts = value_counts(df)
    first = Window.partitionBy("position").orderBy(F.col("value").asc_nulls_last())
    figures = counts.groupBy("position").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("unique_count"))
    samples = (counts.filter("value IS NOT NULL")
                     .withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= SAMPLE_VALUES)
                     .groupBy("position").agg(F.array_sort(F.collect_list("value")).alias("sample_values")))
    names = df.sparkSession.range(1).select(F.inline(_names(df)))
    return (names.join(figures, "position", "left").join(samples, "position", "left")
                 .select("position", "name", "dtype", percent(F.col("nulls"), F.col("rows")).alias("null_pct"),
                         F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
                         F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values")))


def sample_values(df: DataFrame) -> DataFrame:
    """Up to five different values per column as text, smallest first."""
    counts = melted(df).filter("value IS NOT NULL").distinct()
    first = Window.partitionBy("position").orderBy("value")
    names = df.sparkSession.range(1).select(F.inline(_names(df)))
    picked = counts.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= SAMPLE_VALUES)
    return names.join(picked, "position").select("name", F.col("rn").cast("bigint").alias("rn"), "value")


def sample_rows(df: DataFrame, order_by: Sequence[str], k: int = 3) -> DataFrame:
    """First k rows as text, NULL kept."""
    from gridwash.operators.ordering import top_n
    return top_n(df, order_by, k).select(*[_text(f.name, f.dataType).alias(f.name) for f in df.schema.fields])


def null_columns(df: DataFrame) -> DataFrame:
    """Columns that have NULLs, with count and percentage."""
    return filled_percentages(df, df.columns).filter("null_count > 0")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# Ranks, as shares, that a sketch of this accuracy puts around the middle: both middle ranks lie between its two values.
BAND, ACCURACY = (0.4998, 0.5002), 10_000


def numeric_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """Min, max, mean and median of each numeric column that has a value.

    Columns are aggregated side by side. For exact medians one job finds two values around the middle of each column; the
    result then counts what lies below, and shuffles only the few values between.
    """
    cells = {n: quoted(n).cast("double") for n in numeric_columns(df)}
    schema = "column string, min double, max double, avg double, median double"
    if not cells:
        return df.sparkSession.createDataFrame([], schema)

    def stats(more: list[Column]) -> DataFrame:
        """One row per column from one row of aggregates, with ``more`` as ``x``."""
        aggs = []
        for i, (cell, extra) in enumerate(zip(cells.values(), more)):
            aggs += [F.min(cell).alias(f"lo{i}"), F.max(cell).alias(f"hi{i}"), F.avg(cell).alias(f"av{i}"),
                     F.count(cell).alias(f"n{i}"), extra.alias(f"x{i}")]
        return df.agg(*aggs).select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("column"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
                     F.round(f"av{i}", 2).alias("avg"), F.col(f"n{i}").alias("n"), F.col(f"x{i}").alias("x"))
            for i, name in enumerate(cells)]))).filter("n > 0")

    if approx:
        rows = stats([F.percentile_approx(c, 0.5) for c in cells.values()])
        return rows.select("column", "min", "max", "avg", F.round("x", 2).alias("median"))
    found = df.agg(*[F.percentile_approx(c, list(BAND), ACCURACY).alias(f"b{i}") for i, c in enumerate(cells.values())]).first()
    bands = {n: found[i] for i, n in enumerate(cells) if found[i]}
    below = [F.count_if(c < bands[n][0]) if n in bands else F.lit(0).cast("bigint") for n, c in cells.items()]
    # A row gives a value for each of its columns that is in the band, so most rows give none.
    between = F.array_compact(F.array(*[
        F.when(cells[n].between(*band), F.struct(F.lit(n).alias("column"), cells[n].alias("v"))) for n, band in bands.items()]))
    counted = (df.select(F.inline(between)).groupBy("column", "v").agg(F.count(F.lit(1)).alias("rows")) if bands
               else df.sparkSession.createDataFrame([], "column string, v double, rows long"))
    upto = Window.partitionBy("column").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = stats(below)
    ranked = counted.withColumn("upto", F.sum("rows").over(upto)).join(rows, "column").withColumn("upto", F.col("upto") + F.col("x"))
    middle = [F.min(F.when(F.col("upto") >= rank, F.col("v"))) for rank in (F.expr("(n + 1) div 2"), F.expr("n div 2 + 1"))]
    return ranked.groupBy("column", "min", "max", "avg").agg(
        F.round(middle[0] + (middle[1] - middle[0]) / 2, 2).alias("median"))


def suggestions(df: DataFrame, most_columns: int | None = None) -> DataFrame:
    """What to clean first: duplicates, then the columns with many NULLs, all or the first ``most_columns``."""
    order = {c: i for i, c in enumerate(df.columns)}
    dup = (duplicate_row_count(df).filter("duplicate_rows > 0")
           .select(F.lit(0).cast("bigint").alias("rank"),
                   F.concat(F.lit("Remove "), F.col("duplicate_rows").cast("string"), F.lit(" duplicate row"),
                            F.when(F.col("duplicate_rows") == 1, "").otherwise("s")).alias("text"),
                   F.lit("remove duplicate rows").alias("instruction")))
    place = F.element_at(F.create_map(*[F.lit(x) for c, i in order.items() for x in (c, i)]), F.col("column"))
    # One row per column of the table, so this window is as small as the schema.
    high = (null_columns(df).filter(F.col("null_pct") > SUGGEST_ABOVE_PCT)
            .withColumn("rank", F.row_number().over(Window.orderBy(place)).cast("bigint"))
            .filter(F.lit(True) if most_columns is None else F.col("rank") <= most_columns)
            .select("rank",
                    F.concat(F.lit("Column '"), F.col("column"), F.lit("' has "),
                             F.col("null_pct").cast("string"), F.lit("% null values")).alias("text"),
                    F.concat(F.lit("drop rows where "), F.col("column"), F.lit(" is null")).alias("instruction")))
    return dup.unionByName(high)


def most_null_column(df: DataFrame) -> DataFrame:
    """The column with the highest share of NULLs; the first name wins a tie."""
    stats = filled_percentages(df, df.columns)
    return stats.orderBy(F.col("null_count").desc(), "column").limit(1)


def insights(df: DataFrame) -> dict[str, DataFrame]:
    """The findings of one table; an empty table has counts only."""
    counts = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))
    return {"counts": counts, "null_columns": null_columns(df), "duplicate_rows": duplicate_row_count(df),
            "numeric_stats": numeric_stats(df), "suggestions": suggestions(df)}


def findings(df: DataFrame) -> DataFrame:
    """All findings of one table as rows of ``finding, column, value``; those of the whole table have no column."""
    parts = insights(df)
    none = F.lit(None).cast("string")

    def rows(frame: DataFrame, names: Sequence[str], column) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(n).alias("finding"), column.alias("column"), F.col(n).cast("double").alias("value"))
                          for n in names])
        return frame.select(F.inline(cells))

    found = [rows(parts["counts"], ["row_count", "column_count"], none), rows(parts["duplicate_rows"], ["duplicate_rows"], none),
             rows(parts["null_columns"], ["null_count", "null_pct"], F.col("column")),
             rows(parts["numeric_stats"], ["min", "max", "avg", "median"], F.col("column"))]
    return reduce(lambda a, b: a.unionByName(b), found)


def schema_card(df: DataFrame, privacy: bool = False) -> DataFrame:
    """One line of text per column; privacy mode leaves every cell value out."""
    stats = profile(df)
    line = F.concat(F.lit("  - "), F.col("name"), F.lit(" ("), F.col("dtype"), F.lit(")"),
                    F.coalesce(F.concat(F.lit(" — "), F.col("null_pct").cast("string"), F.lit("% nulls")), F.lit("")),
                    F.lit(", "), F.col("unique_count").cast("string"), F.lit(" unique values"))
    if not privacy:
        line = F.concat(line, F.when(F.size("sample_values") > 0,
                                     F.concat(F.lit(", e.g.: "), F.array_join("sample_values", ", ")))
                               .otherwise(F.lit("")))
    return stats.select(F.col("position").cast("bigint").alias("position"), line.alias("line"))


def sample_lines(df: DataFrame, order_by: Sequence[str], k: int = 3) -> DataFrame:
    """First k rows as ``a=1, b=x`` lines, for display next to a card that is not private."""
    texts = sample_rows(df, order_by, k)
    pairs = [F.concat(F.lit(f"{c}="), F.coalesce(quoted(c), F.lit("None"))) for c in texts.columns]
    return texts.select(F.concat(F.lit("  "), F.concat_ws(", ", *pairs)).alias("line"))


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order_by: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """First rows for display, in an order if one is given, and exact counts as a second table.

    Only the rows shown reach the driver.
    """
    totals = df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("total_columns", F.lit(len(df.columns)))
    from gridwash.operators.ordering import top_n
    return (top_n(df, order_by, n) if order_by else df.limit(n)), totals
