"""Columns that are named like helpers keep their values; joins split at hot keys; decimals keep their digits."""

from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridwash.operators import cells, duplicates, ordering, relations, segments
from gridwash.operators.nested import flatten_json_text

NAMES = ["_rn", "_at", "_mid", "_seg", "_pos", "_amount", "_start", "_local", "_first", "_carry", "_sum", "_rows", "_k", "_n", "_v",
         "_hot", "_doc", "_SEG", "_summed"]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i % 3, i, f"t{i}") for i in range(12)], "k long, at long, own string").repartition(3)


@pytest.mark.parametrize("name", NAMES)
def test_a_column_named_like_a_helper_stays(name, odd, spark):
    df = odd.withColumnRenamed("own", name)
    values = {f"t{i}" for i in range(12)}

    def kept(out, n=12):
        assert out.columns[:3] == ["k", "at", name] and {r[name] for r in out.collect()} <= values and out.count() == n

    kept(duplicates.first_per_key(df, ["k"], ["at"]), 3)
    kept(duplicates.keep_first(df, ["at"], ["k"]), 3)
    kept(segments.row_index(df, ["at"]))
    kept(ordering.number_parts(df, ["at"], 5))
    kept(ordering.cap_rows(df, 7), 7)
    kept(segments.any_rows(df, 7), 7)
    kept(segments.running_total(df, ["k"], ["at"], F.col("at"), "total"))
    kept(relations.first_child(df, df, "k", "k", "at", "first_at"))
    # The column itself as key, order, amount and value.
    before = {r.at: r.prev for r in segments.previous_value(df, ["k"], ["at", name], name, "prev").collect()}
    assert before[11] == "t8" and before[1] is None
    numbers = df.select("k", F.col("at").alias(name))
    assert sorted(rows(segments.exact_median(numbers, [name], "k"))) == [(i, float(i % 3)) for i in range(12)]
    total = segments.running_total(numbers, ["k"], [name], F.col(name), "total")
    assert {r.total for r in total.filter("k = 0").collect()} == {0, 3, 9, 18}
    doc = spark.createDataFrame([('{"a": 1}', "x")], f"j string, `{name}` string")
    assert rows(flatten_json_text(doc, "j"), name, "`j.a`") == [("x", "1")]


def test_some_rows_of_many_partitions(spark):
    df = spark.range(1000).repartition(7)
    for n in (0, 1, 150, 999, 5_000):
        got = [r.id for r in segments.any_rows(df, n).collect()]
        assert len(got) == len(set(got)) == min(n, 1000)


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_outer", "full_outer", "left_semi", "left_anti"])
def test_hot_keys_apart_join_as_together(spark, how, unique):
    facts = spark.createDataFrame([(1, i) for i in range(12)] + [(2, i) for i in range(8)] + [(3, 1), (4, 1), (None, 1)], "k long, _hot long")
    lookup = spark.createDataFrame([(1, "a"), (3, "c"), (5, "e"), (None, "n")] + ([] if unique else [(1, "b"), (3, "d")]), "id long, name string")
    plain = relations.lookup_join(facts, lookup, "k", "id", how)
    apart = relations.lookup_join(facts, lookup, "k", "id", how, split_hot=True, hot_rows=5)
    assert plain.columns == apart.columns and sorted(rows(plain), key=str) == sorted(rows(apart), key=str)


def test_decimals_widen_instead_of_rounding(spark):
    df = spark.createDataFrame([(Decimal("1.25"),), (None,)], "d decimal(10,2)")
    for value, kind, want in ((0.999, "decimal(11,3)", Decimal("0.999")), ("0.999", "decimal(11,3)", Decimal("0.999")), (7, "decimal(10,2)", 7),
                              (2.5, "decimal(10,2)", Decimal("2.5")), (10**9, "decimal(12,2)", 10**9), (1e30, "decimal(33,2)", Decimal("1e30")),
                              (1e-37, "double", 1e-37), (10**40, "double", 1e40), (float("inf"), "double", float("inf"))):
        filled = cells.fill_nulls(df, "d", value)
        assert filled.schema[0].dataType.simpleString() == kind, value
        assert {r.d for r in filled.collect()} == {Decimal("1.25") if kind != "double" else 1.25, want}
        assert cells.update_cells(df, {"d": value}, "d > 1").schema[0].dataType.simpleString() == kind
