"""Ordered operators against plain windows and brute force, with one key holding most rows."""

import random
import statistics

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwash.operators import segments as ops
from gridwash.operators.duplicates import first_per_key
from gridwash.operators.ordering import cap_rows, number_parts, page_of


@pytest.fixture(scope="module", autouse=True)
def many_segments(spark):
    """Small tables would otherwise be merged into one segment."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    data = [(i, None if i % 50 == 0 else "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}",
             rng.randrange(300), rng.randrange(10)) for i in range(6000)]
    return spark.createDataFrame(data, "id long, key string, at long, v long").repartition(6).cache()


def by_key():
    return Window.partitionBy("key").orderBy("at", "id")


def test_row_numbers(skewed):
    want = skewed.withColumn("rn", F.row_number().over(by_key()))
    got = ops.row_numbers(skewed, ["key"], ["at", "id"], "rn")
    assert sorted(rows(got, "id", "rn")) == sorted(rows(want, "id", "rn"))


def test_running_total(skewed):
    want = skewed.withColumn("s", F.sum("v").over(by_key().rowsBetween(Window.unboundedPreceding, 0)))
    got = ops.running_total(skewed, ["key"], ["at", "id"], F.col("v"), "s")
    assert sorted(rows(got, "id", "s")) == sorted(rows(want, "id", "s"))


def test_previous_value(skewed):
    want = skewed.withColumn("p", F.lag("v").over(by_key()))
    got = ops.previous_value(skewed, ["key"], ["at", "id"], "v", "p")
    key = lambda r: r[0]
    assert sorted(rows(got, "id", "p"), key=key) == sorted(rows(want, "id", "p"), key=key)


def test_hot_key_spreads_over_segments(skewed):
    seg = ops.segmented(skewed, ["key"], ["at", "id"])
    assert seg.filter("key = 'hot'").select(ops.SEG).distinct().count() > 1


def test_row_index_is_dense_and_ordered(skewed):
    got = sorted(rows(ops.row_index(skewed, [("at", "desc"), "id"]), "row_index", "at", "id"))
    assert [g[0] for g in got] == list(range(6000))
    assert [(-g[1], g[2]) for g in got] == sorted((-g[1], g[2]) for g in got)


@pytest.mark.parametrize("limits", [{}, {"in_memory_rows": 0}, {"in_memory_rows": 0, "max_large_keys": 0},
                                    {"in_memory_rows": 100}])
def test_exact_median(skewed, limits):
    want = {}
    for key, at in rows(skewed, "key", "at"):
        want.setdefault(key, []).append(at)
    got = dict(rows(ops.exact_median(skewed, ["key"], "at", "m", **limits), "key", "m"))
    assert got == {k: statistics.median(v) for k, v in want.items()}
    assert rows(ops.exact_median(skewed, [], "at", "m", **limits)) == [(statistics.median(r[0] for r in rows(skewed, "at")),)]


def test_median_outside_the_band_is_still_found(skewed, spark):
    bands = spark.createDataFrame([("hot", 0.0, 1.0)], "key string, _low double, _high double")
    filled = skewed.select("key", F.col("at").cast("double").alias("_v"))
    assert [r["m"] for r in ops._median_in_band(filled, ["key"], bands, "m")] == [None]
    want = statistics.median(at for key, at in rows(skewed, "key", "at") if key == "hot")
    assert dict(rows(ops._median_by_rank(filled, ["key"], "m"), "key", "m"))["hot"] == want


def test_median_ignores_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", 3.0)], "k string, v double")
    assert rows(ops.exact_median(df, ["k"], "v", "m")) == [("b", 2.5)]
    assert rows(ops.exact_median(df.filter("k = 'a'"), [], "v", "m")) == []


def test_parts_pages_and_caps(skewed, monkeypatch):
    parts = dict(rows(number_parts(skewed, ["id"], 2500).groupBy("part").count()))
    assert parts == {1: 2500, 2: 2500, 3: 1000}
    monkeypatch.setattr("gridwash.operators.ordering.SMALL_LIMIT", 10)
    assert sorted(rows(cap_rows(skewed, 100, ["id"]), "id")) == [(i,) for i in range(100)]
    assert sorted(rows(page_of(skewed, ["id"], 4, 7), "id")) == [(i,) for i in range(21, 28)]
    assert cap_rows(skewed, 100).count() == 100


def test_any_type_can_be_sorted_and_numbered(spark):
    df = spark.range(20).selectExpr("id", "map('a', id) AS m", "array(map(1, id)) AS am", "parse_json('{\"k\": 1}') AS v",
                                    "struct(id AS x) AS s", "cast('b' AS binary) AS b")
    assert sorted(rows(ops.row_index(df, ["id"]), "id", "row_index")) == [(i, i) for i in range(20)]


def test_first_per_key_cuts_before_the_shuffle(skewed):
    got = first_per_key(skewed, ["key"], ["at", "id"])
    text = plan(got)
    assert text.count("WindowGroupLimit") == 2
    assert sorted(rows(got, "id")) == sorted(rows(skewed.withColumn("r", F.row_number().over(by_key())).filter("r = 1"), "id"))
