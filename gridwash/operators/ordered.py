"""As-of joins, carried values, ranks and shifts per key, for keys of any size.

Spark has no as-of join, and a window over a key runs in one task. Here both sides are put into one order over the cluster
(``segments``), so a key that holds a third of all rows spreads over many tasks, and what is carried from one segment to
the next is one row per border. Ranks and shifts need no window over rows at all: ranks are running sums over the counts
of different values, shifts an equi-join on key and row number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwash.operators.naming import unused
from gridwash.operators.segments import (HELPERS, POS, SEG, _set_apart, join_same, row_numbers, running_total, segmented)


def _carried(seg: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the last ``value`` that is not NULL up to and including each row of a key, over all segments."""
    cells = [F.col(f"`{k}`") for k in keys]
    local = Window.partitionBy(*cells, SEG).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    per = seg.groupBy(*cells, SEG).agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(POS))).alias("_sum"))
    # One row per key and segment; only keys that reach over a border have something before them, at most one per border.
    earlier = Window.partitionBy(*cells).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = (per.withColumn("_carry", F.last("_sum", ignorenulls=True).over(earlier))
                .filter("_carry IS NOT NULL").drop("_sum"))
    here = seg.withColumn(name, F.last(value, ignorenulls=True).over(local))
    joined = join_same(here, F.broadcast(carry), [*keys, SEG], "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.col("_carry"))).drop("_carry")


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str | tuple[str, str]], column: str,
                 name: str) -> DataFrame:
    """The last value of ``column`` that is not NULL, up to and including each row of its key; NULL before the first."""
    df, back, (keys, order, (column,)) = _set_apart(df, keys, order, [column])
    value = unused([*df.columns, *HELPERS, name], "_value")[0]
    seg = segmented(df.withColumn(value, F.col(f"`{column}`")), keys, order)
    return _carried(seg, keys, value, name).drop(value, SEG, POS).withColumnsRenamed(back)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str,
              columns: Sequence[str], ties: Sequence[str | tuple[str, str]] = (), forward: bool = False,
              strict: bool = False, within: Column | int | float | None = None) -> DataFrame:
    """Each row of ``left`` once, with ``columns`` of the latest row of ``right`` of its keys that is not later.

    ``forward`` takes the earliest one that is not earlier, ``strict`` leaves out equal times, and ``within`` (an interval,
    or a number for numeric times) leaves out rows that are further away. Of rows at one time the last by ``ties`` is taken
    (by ``forward`` too), and among those one that is the same in every run. Rows whose keys or time are NULL match nothing.
    A row of ``right`` whose columns are all NULL is a match like any other. Column names of the result must differ.
    """
    taken = [c.lower() for c in left.columns]
    if any(c.lower() in taken for c in columns):
        raise ValueError("columns of both sides have one name")
    names = [f"k{i}" for i in range(len(keys))]
    order = [c for c, *_ in ([t] if isinstance(t, str) else t for t in ties)]
    held = F.struct(F.col(f"`{right_at}`").alias("at"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    known = [F.col(f"`{k}`").isNotNull() for k in keys]
    here = left.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(f"`{left_at}`").alias("at"),
                       F.struct(*[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(left.columns)]).alias("row"))
    there = right.filter(F.col(f"`{right_at}`").isNotNull())
    for k in known:
        there = there.filter(k)
    there = there.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(f"`{right_at}`").alias("at"),
                         *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(order)], held.alias("match"))
    # At equal times rows of the right come first, so that they are found; if strict, last.
    both = (here.withColumn("side", F.lit(0 if strict else 1)).unionByName(there.withColumn("side", F.lit(1 if strict else 0)),
                                                                          allowMissingColumns=True))
    directions = ["asc" if isinstance(t, str) else t[1] for t in ties]
    seg = segmented(both, names, [("at", "desc" if forward else "asc"), "side",
                                  *[(f"t{i}", d) for i, d in enumerate(directions)]])
    found = _carried(seg, names, "match", "found").filter("row IS NOT NULL")
    usable = F.col("at").isNotNull()
    for n in names:
        usable = usable & F.col(n).isNotNull()
    if within is not None:
        limit = within if isinstance(within, Column) else F.lit(within)
        usable = usable & (F.col("found.at") - limit <= F.col("at") if forward else F.col("found.at") + limit >= F.col("at"))
    return found.select(*[F.col(f"row.l{i}").alias(c) for i, c in enumerate(left.columns)],
                        *[F.when(usable, F.col(f"found.c{i}")).alias(c) for i, c in enumerate(columns)])


def ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str | tuple[str, str]], name: str = "rank",
          dense: bool = False) -> DataFrame:
    """rank() or dense_rank() per key. Equal rows are counted before the shuffle; NULLs are last and equal to each other."""
    columns = list(dict.fromkeys([*keys, *[o if isinstance(o, str) else o[0] for o in order]]))
    n, upto = unused([*df.columns, *HELPERS, name], "_n", "_upto")
    values = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias(n))
    summed = running_total(values, keys, order, F.lit(1).cast("bigint") if dense else F.col(n), upto)
    ranked = summed.withColumn(name, F.col(upto) if dense else F.col(upto) - F.col(n) + 1).drop(n, upto)
    return join_same(df, ranked, columns).select(*[F.col(f"`{c}`") for c in df.columns], name)


def shifted(df: DataFrame, keys: Sequence[str], order: Sequence[str | tuple[str, str]], column: str, by: int,
            name: str) -> DataFrame:
    """lag (``by`` > 0) or lead (``by`` < 0) of a column over any number of rows of a key, by key and row number."""
    at = unused([*df.columns, name], "_at")[0]
    numbered = row_numbers(df, keys, order, at)
    other = numbered.select(*[F.col(f"`{k}`") for k in keys], (F.col(at) + by).alias(at), F.col(f"`{column}`").alias(name))
    return join_same(numbered, other, [*keys, at], "left").drop(at)
