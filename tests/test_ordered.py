"""As-of joins, carried values, ranks and shifts against brute force and plain windows, with one key holding most rows."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwash.operators import ordered as ops


@pytest.fixture(scope="module", autouse=True)
def many_segments(spark):
    """Small tables would otherwise be merged into one segment."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def drawn(rng, n, sparse):
    """Rows of id, key, at, v; NULLs everywhere, one key with most rows, times that repeat."""
    return [(i, None if rng.random() < 0.05 else "hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}",
             None if rng.random() < 0.03 else rng.randrange(400), None if rng.random() < sparse else rng.randrange(50))
            for i in range(n)]


SCHEMA = "id long, key string, at long, v long"


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(11)
    left, right = drawn(rng, 3_000, 0.2), drawn(rng, 500, 0.2)
    return left, right, spark.createDataFrame(left, SCHEMA).repartition(5), spark.createDataFrame(right, SCHEMA)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("within", [None, 5])
def test_asof_join(sides, forward, strict, within):
    left, right, a, b = sides
    named = b.select("key", F.col("at").alias("seen"), F.col("id").alias("found"), F.col("v").alias("w"))
    got = ops.asof_join(a, named, ["key"], "at", "seen", ["found", "w"], ["found"], forward, strict, within)
    want = []
    for i, key, at, v in left:
        best = None
        for j, other, seen, w in right:
            if None in (key, at, seen) or other != key:
                continue
            gap = seen - at if forward else at - seen
            if gap < 0 or strict and not gap or within is not None and gap > within:
                continue
            if best is None or (-gap, j) > best[:2]:
                best = (-gap, j, w)
        want.append((i, best and best[1], best and best[2]))
    assert sorted(rows(got, "id", "found", "w")) == sorted(want, key=lambda r: r[0])
    assert got.columns == ["id", "key", "at", "v", "found", "w"]


def test_asof_join_corner_cases(spark, sides):
    _, _, a, b = sides
    right = b.select("key", "at", F.col("id").alias("found"))
    none = ops.asof_join(a, right.limit(0), ["key"], "at", "at", ["found"])
    assert none.count() == a.count() and none.filter("found IS NOT NULL").count() == 0
    assert ops.asof_join(a.limit(0), right, ["key"], "at", "at", ["found"]).count() == 0
    twice = ops.asof_join(a.unionAll(a), right, ["key"], "at", "at", ["found"], ["found"])
    assert twice.count() == 2 * a.count() and twice.distinct().count() == a.count()
    clash = a.select("id", F.col("at").alias("side"), F.col("key").alias("k0"), F.lit(1).alias("_seg"), F.lit(2).alias("row"))
    by_two = right.withColumnsRenamed({"key": "k0", "at": "side"})
    named = ops.asof_join(clash, by_two, ["k0"], "side", "side", ["found"], ["found"])
    assert sorted(rows(named, "id", "found")) == sorted(rows(ops.asof_join(a, right, ["key"], "at", "at", ["found"], ["found"]), "id", "found"))
    assert named.columns == ["id", "side", "k0", "_seg", "row", "found"]
    with pytest.raises(ValueError):
        ops.asof_join(a, b, ["key"], "at", "at", ["ID"])


def test_fill_forward(sides):
    a = sides[2].withColumn("rare", F.expr("CASE WHEN id % 400 = 7 THEN v END"))  # over many segments without a value
    for column in ("v", "rare"):
        window = Window.partitionBy("key").orderBy(F.col("at").asc_nulls_last(), "id")
        want = a.withColumn("f", F.last(column, ignorenulls=True).over(window))
        got = ops.fill_forward(a, ["key"], ["at", "id"], column, "f")
        assert sorted(rows(got, "id", "f")) == sorted(rows(want, "id", "f"))
    named = ops.fill_forward(a.withColumnRenamed("v", "_carry"), ["key"], ["at", "id"], "_carry", "f")
    assert "_carry" in named.columns and "f" in named.columns
    assert ops.fill_forward(a.limit(0), ["key"], ["at"], "v", "f").count() == 0


def test_ranks(sides):
    a = sides[2]
    window = Window.partitionBy("key").orderBy(F.col("v").desc_nulls_last(), F.col("at").asc_nulls_last())
    order = [("v", "desc"), "at"]
    for dense, plain in ((False, F.rank()), (True, F.dense_rank())):
        got = ops.ranks(a, ["key"], order, "r", dense)
        assert sorted(rows(got, "id", "r")) == sorted(rows(a.withColumn("r", plain.over(window)), "id", "r"))
    assert got.columns == [*a.columns, "r"]


@pytest.mark.parametrize("by", [1, 40, -3, 0])
def test_shifted(sides, by):
    a = sides[2]
    window = Window.partitionBy("key").orderBy(F.col("at").asc_nulls_last(), "id")
    want = a.withColumn("s", F.lag("v", by).over(window) if by else F.col("v"))
    got = ops.shifted(a, ["key"], ["at", "id"], "v", by, "s")
    assert sorted(rows(got, "id", "s")) == sorted(rows(want, "id", "s"))
