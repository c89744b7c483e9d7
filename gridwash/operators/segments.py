"""Ordered work that does not put a whole key, or the whole table, into one task.

A window over a key runs in one task per key, and a window without a key in one
task at all. These operators sort the table across the cluster by key and order
together, so one large key spreads over many range partitions ("segments"), then
stitch the segments with a table that has at most two rows per segment.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwash.operators.naming import unused
from gridwash.session import frozen

SEG, POS = "_seg", "_pos"
HELPERS = (SEG, POS, "_mid", "_amount", "_start", "_local", "_first", "_carry", "_sum", "_rows")
_POS_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Join condition that also matches NULL with NULL."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def join_same(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal names, NULL keys included, keeping one copy of the keys."""
    marked = right.select(*[F.col(n).alias(f"_r{i}") for i, n in enumerate(names)],
                          *[c for c in right.columns if c not in names])
    condition = reduce(lambda a, b: a & b, [left[n].eqNullSafe(F.col(f"_r{i}")) for i, n in enumerate(names)])
    return left.join(marked, condition, how).drop(*[f"_r{i}" for i in range(len(names))])


def sort_columns(order: Sequence[str | tuple[str, str]]) -> list[Column]:
    """NULLs last in both directions."""
    out = []
    for item in order:
        name, direction = (item, "asc") if isinstance(item, str) else item
        column = F.col(f"`{name}`")
        out.append(column.desc_nulls_last() if direction.lower() == "desc" else column.asc_nulls_last())
    return out


def tie_break(df: DataFrame) -> Column:
    """A last sort term that spreads rows with equal sort keys over range partitions."""
    return F.xxhash64(*hashable(df))


def hashable(df: DataFrame) -> list[Column]:
    """The columns in a form Spark can hash: maps and variants as JSON text."""
    return [F.to_json(F.col(f"`{c}`")) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in df.dtypes]


def segmented(df: DataFrame, keys: Sequence[str], order: Sequence[str | tuple[str, str]]) -> DataFrame:
    """The table sorted by keys and order over the cluster, with segment number and position."""
    return _placed(df.orderBy(*sort_columns(list(keys) + list(order)), tie_break(df)))


def _placed(df: DataFrame) -> DataFrame:
    pinned = frozen(df.withColumn("_mid", F.monotonically_increasing_id()), "segments")
    return (pinned.withColumn(SEG, F.shiftright("_mid", _POS_BITS))
                  .withColumn(POS, F.col("_mid").bitwiseAND((1 << _POS_BITS) - 1))
                  .drop("_mid"))


def _before(per_segment: DataFrame, keys: Sequence[str], amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` in earlier segments of the key; one input row per key and segment."""
    earlier = (Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(SEG)
               .rowsBetween(Window.unboundedPreceding, -1))
    return per_segment.withColumn(out, F.sum(amount).over(earlier))


def _set_apart(df: DataFrame, *named: Sequence) -> tuple[DataFrame, dict[str, str], list[list]]:
    """The table with its own columns out of the way of helper names, the way back, and lists of names or orders to match."""
    own = [c for c in df.columns if c.lower() in HELPERS]
    away = dict(zip(own, unused([*df.columns, *HELPERS], *own)))
    by_lower = {c.lower(): new for c, new in away.items()}

    def new(item):
        name = item if isinstance(item, str) else item[0]
        found = by_lower.get(name.lower(), name)
        return found if isinstance(item, str) else (found, *item[1:])

    return df.withColumnsRenamed(away), {v: k for k, v in away.items()}, [[new(i) for i in items] for items in named]


def row_index(df: DataFrame, order: Sequence[str | tuple[str, str]], name: str = "row_index") -> DataFrame:
    """Exact 0-based position of each row in the given order over the whole table."""
    df, back, (order,) = _set_apart(df, order)
    return _positions(segmented(df, [], order), name).withColumnsRenamed(back)


def any_rows(df: DataFrame, n: int) -> DataFrame:
    """Some n rows, or all if there are fewer: whole partitions as they lie, and a part of one, without a sort or one task."""
    df, back, _ = _set_apart(df)
    at = unused(df, "_at")[0]
    placed = _positions(_placed(df), at)
    return placed.filter(F.col(at) < n).drop(at).withColumnsRenamed(back)


def _positions(seg: DataFrame, name: str) -> DataFrame:
    counts = seg.groupBy(SEG).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per segment, so as many as the sort has partitions.
    offsets = _before(counts, [], "_rows", "_start").select(SEG, F.coalesce("_start", F.lit(0)).alias("_start"))
    return (seg.join(F.broadcast(offsets), SEG)
               .withColumn(name, F.col("_start") + F.col(POS))
               .drop(SEG, POS, "_start"))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str | tuple[str, str]],
                  amount: Column, name: str) -> DataFrame:
    """Sum of ``amount`` up to and including each row, per key."""
    summed = unused([*df.columns, *HELPERS], "_summed")[0]
    df, back, (keys, order) = _set_apart(df.withColumn(summed, amount), keys, order)
    seg = segmented(df.withColumnRenamed(summed, "_amount"), keys, order)
    cells = [F.col(f"`{k}`") for k in keys]
    local = Window.partitionBy(*cells, SEG).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    per = seg.groupBy(*cells, SEG).agg(F.sum("_amount").alias("_sum"))
    # Only keys that reach over a segment border have something before them: at most one per border.
    carried = _before(per, keys, "_sum", "_start").filter("_start IS NOT NULL").drop("_sum")
    joined = join_same(seg.withColumn(name, F.sum("_amount").over(local)), F.broadcast(carried), [*keys, SEG], "left")
    return (joined.withColumn(name, F.col(name) + F.coalesce("_start", F.lit(0)))
                  .drop(SEG, POS, "_start", "_amount").withColumnsRenamed(back))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str | tuple[str, str]],
                name: str = "row_number") -> DataFrame:
    """row_number() per key, exact for keys of any size."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), name)


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str | tuple[str, str]],
                   column: str, name: str) -> DataFrame:
    """lag(column) per key, exact for keys of any size."""
    df, back, (keys, order, (column,)) = _set_apart(df, keys, order, [column])
    seg = segmented(df, keys, order)
    cells = [F.col(f"`{k}`") for k in keys]
    local = Window.partitionBy(*cells, SEG).orderBy(POS)
    # A key that goes on in the next segment owns the last row of this one: one row per segment is carried over.
    ends = seg.groupBy(SEG).agg(F.max(POS).alias(POS))
    carry = (join_same(seg, F.broadcast(ends), [SEG, POS])
             .select(*cells, SEG, F.struct(F.col(column).alias("v")).alias("_carry"))
             .withColumn(SEG, F.lead(SEG).over(Window.orderBy(SEG))))
    rows = (seg.withColumn("_local", F.lag(column).over(local))
               .withColumn("_first", F.row_number().over(local) == 1))
    joined = join_same(rows, F.broadcast(carry), [*keys, SEG], "left")
    return (joined.withColumn(name, F.when(F.col("_first"), F.col("_carry.v")).otherwise(F.col("_local")))
                  .drop(SEG, POS, "_local", "_first", "_carry").withColumnsRenamed(back))


# Large keys that are handled by sketch and band; with more of them, all keys go by rank.
MAX_LARGE_KEYS = 1_000
# Counted band values that one window task may walk; beyond it the band is split into segments.
BAND_ROWS = 2_000_000


def exact_median(df: DataFrame, keys: Sequence[str], column: str, name: str = "median",
                 in_memory_rows: int = 500_000, max_large_keys: int = MAX_LARGE_KEYS) -> DataFrame:
    """Interpolated median per key; NULLs ignored, keys without a value absent.

    The built-in median holds the values of a key in memory, so keys are counted
    first and it only gets those with up to ``in_memory_rows`` rows. For larger
    keys a sketch gives a narrow band around the median; rows outside it are
    counted, rows inside it are ranked, and the result is exact.
    """
    names, keys = list(keys), [f"key{i}" for i in range(len(keys))]
    filled = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, keys)],
                       F.col(f"`{column}`").cast("double").alias("_v")).filter("_v IS NOT NULL")
    return _exact_median(filled, keys, in_memory_rows, max_large_keys).toDF(*names, name)


def _exact_median(filled: DataFrame, keys: Sequence[str], in_memory_rows: int, max_large_keys: int) -> DataFrame:
    cells, name, spark = [F.col(k) for k in keys], "middle", filled.sparkSession
    large = filled.groupBy(*cells).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > in_memory_rows)
    # One small row per large key, and never more than the limit of them.
    bands = large.limit(max_large_keys + 1).collect()
    if len(bands) > max_large_keys:
        return _median_by_rank(filled, keys, name)
    if not bands:
        picked = filled.groupBy(*cells).agg(F.median("_v").alias(name))
        return picked if keys else picked.filter(F.col(name).isNotNull())
    listed = F.broadcast(spark.createDataFrame(bands, large.schema).drop("_rows"))
    hot = join_same(filled, listed, keys) if keys else filled
    found = _median_in_band(hot, keys, _bands(hot, keys), name)
    missed = [r for r in found if r[name] is None]
    hit = spark.createDataFrame([r for r in found if r[name] is not None],
                                filled.select(*cells, F.col("_v").alias(name)).schema)
    if missed:  # the sketch promises this does not happen; the result stays right if it does
        names = spark.createDataFrame([tuple(r[k] for k in keys) + (0,) for r in missed],
                                      filled.select(*cells, F.lit(0).alias("_m")).schema)
        rows = join_same(filled, F.broadcast(names), keys).drop("_m") if keys else filled
        hit = hit.unionByName(_median_by_rank(rows, keys, name))
    if not keys:
        return hit
    others = join_same(filled, listed, keys, "left_anti")
    return others.groupBy(*cells).agg(F.median("_v").alias(name)).unionByName(hit)


def _bands(filled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two approximate quantiles close to the middle per key, a few bytes each."""
    sketch = filled.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.percentile_approx("_v", [0.4998, 0.5002], 10_000).alias("_b"))
    bands = sketch.select(*[F.col(f"`{k}`") for k in keys], F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high"))
    return filled.sparkSession.createDataFrame(bands.collect(), bands.schema)


def _ranked(counts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``_upto``, the rank of the last of the ``_n`` equal rows, to a table of counts."""
    if counts.count() > BAND_ROWS:
        return running_total(counts, keys, order, F.col("_n"), "_upto")
    upto = (Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_upto", F.sum("_n").over(upto))


def _middle(ranked: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Mean of the values at ranks ``_lo`` and ``_hi``."""
    def at(rank: str) -> Column:
        here = (F.col("_upto") >= F.col(rank)) & (F.col("_upto") - F.col("_n") < F.col(rank))
        return F.max(F.when(here, F.col("_v")))

    return (ranked.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(at("_lo").alias("_a"), at("_hi").alias("_b"))
                  .withColumn(name, F.col("_a") + (F.col("_b") - F.col("_a")) / 2).drop("_a", "_b"))


def _median_in_band(filled: DataFrame, keys: Sequence[str], bands: DataFrame, name: str) -> list:
    """One row per key of ``bands``, NULL where the median lies outside the band."""
    cells = [F.col(f"`{k}`") for k in keys]
    if keys:
        rows = join_same(filled, F.broadcast(bands), keys)
    else:
        low, high = bands.first()
        rows = filled.withColumns({"_low": F.lit(low), "_high": F.lit(high)})
    side = F.when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), 1).otherwise(0)
    counts = frozen(rows.groupBy(*cells, side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_v"))
                        .agg(F.count(F.lit(1)).alias("_n")), "band")
    totals = counts.groupBy(*cells).agg(F.sum("_n").alias("_total"))
    ranked = _ranked(counts, keys, ["_side", "_v"])
    both = join_same(ranked, F.broadcast(totals), keys) if keys else ranked.withColumn("_total", totals.scalar())
    both = both.withColumn("_lo", F.expr("(_total + 1) div 2")).withColumn("_hi", F.expr("_total div 2 + 1"))
    return _middle(both, keys, name).collect()


def _median_by_rank(filled: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Count equal values, sort them over the cluster and read the one or two segments that hold the middle."""
    cells = [F.col(f"`{k}`") for k in keys]
    counts = filled.groupBy(*cells, "_v").agg(F.count(F.lit(1)).alias("_n"))
    seg = segmented(counts, keys, ["_v"])
    per = _before(seg.groupBy(*cells, SEG).agg(F.sum("_n").alias("_in")), keys, "_in", "_start")
    per = (per.withColumn("_start", F.coalesce("_start", F.lit(0)))
              .withColumn("_total", F.sum("_in").over(Window.partitionBy(*cells)))
              .withColumn("_lo", F.expr("(_total + 1) div 2"))
              .withColumn("_hi", F.expr("_total div 2 + 1")))
    wanted = per.filter("_start < _hi AND _start + _in >= _lo").select(*cells, SEG, "_start", "_lo", "_hi")
    local = Window.partitionBy(*cells, SEG).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (join_same(seg, wanted, [*keys, SEG])
              .withColumn("_upto", F.col("_start") + F.sum("_n").over(local)))
    return _middle(ranked, keys, name)
