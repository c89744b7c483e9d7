import random
import string

import duckdb
import pytest
from conftest import plan, rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridwash.functions import replies, text, values
from gridwash.functions.similarity import jaro_winkler
from gridwash.operators import aggregates, cells, duplicates, nested, ordering, profile, relations, tidy, vocabulary


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c"))).first()[0]


def test_unknown_predicate_changes_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id long, v long")
    assert sorted(rows(cells.update_cells(df, {"id": 9}, "v > 1"))) == [(1, None), (9, 5)]
    assert sorted(rows(cells.update_cells(df, {"v": 7}, "v > 1"), "id")) == [(1,), (2,)]
    assert dict(rows(cells.update_cells(df, {"v": 7}, "v > 1"))) == {1: None, 2: 7}


def test_column_order_survives_edits(spark):
    df = spark.createDataFrame([(1, "a b", 2.0)], "`x y` long, name string, z double")
    assert cells.rename_columns(df, {"name": "n"}).columns == ["x y", "n", "z"]
    assert cells.fill_nulls(df, "name", "?").columns == df.columns
    assert cells.add_columns(df, [{"name": "name", "expr": "upper(name)"}]).columns == df.columns
    with pytest.raises(AnalysisException):
        cells.drop_columns(df, ["nope"])


def test_names_match_in_any_case_and_keep_their_spelling(spark):
    df = spark.createDataFrame([(1, None)], "`Review Rating` long, Name string")
    df = cells.fill_nulls(cells.update_cells(df, {"review rating": 2}), "NAME", "x")
    df = cells.normalize_case(cells.cast_column(df, "REVIEW RATING", "double"), ["name"], "upper")
    assert df.columns == ["Review Rating", "Name"] and rows(df) == [(2.0, "X")]
    assert cells.drop_columns(df, ["review rating"]).columns == ["Name"]
    assert rows(ordering.number_parts(df, ["Review Rating"], 5)) == [(2.0, "X", 1)]


def test_strict_cast_fails_lenient_gives_null(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "c string")
    assert [r[0] for r in rows(cells.cast_column(df, "c", "bigint", lenient=True))] == [1, None, None]
    assert rows(cells.cast_failures(df, "c", "bigint")) == [(3, 1)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cells.cast_column(df, "c", "bigint").collect()


def test_dates(spark):
    fmts = ["dd/MM/yyyy", "yyyy-MM-dd", "d MMM yyyy"]
    got = [str(one(spark, v, lambda c: values.standardize_date(c, fmts)))
           for v in ["03/02/2025", "2025-02-04", "5 Feb 2025", "12 March 2025", "31/31/2025", "", "soon"]]
    assert got == ["2025-02-03", "2025-02-04", "2025-02-05", "None", "None", "None", "None"]
    assert str(one(spark, "12 March 2025", lambda c: values.standardize_date(c, ["d MMMM yyyy"]))) == "2025-03-12"


def test_numbers_and_case(spark):
    assert one(spark, " 1,240.50 ", values.parse_number) == 1240.5
    assert one(spark, "n/a", values.parse_number) is None
    assert one(spark, "middle EAST", lambda c: text.change_case(c, "title")) == "Middle East"
    with pytest.raises(ValueError):
        text.change_case(F.lit("x"), "camel")


def test_trim_takes_every_white_space(spark):
    assert one(spark, "\t 　 a b ﻿\r\n\v", text.trim_ws) == "a b"


def test_redaction_before_cutting(spark):
    assert one(spark, "  \n ", text.redact_literals) == "execution failed"
    long_value = "x" * 900
    got = one(spark, f"Could not convert '{long_value}' to \"INT64\"\nLINE 1: secret", text.redact_literals)
    assert got == "Could not convert '<redacted>' to \"INT64\""
    assert one(spark, "bad 'it''s here' and 'b'", text.redact_literals) == "bad '<redacted>' and '<redacted>'"
    assert len(one(spark, "e" * 900, text.redact_literals)) == 500
    assert one(spark, "first 'a'\nsecond", lambda c: text.redact_literals(c, redact=False)) == "first 'a'"


def test_redaction_of_very_long_values(spark):
    got = one(spark, "bad '" + "word " * 40_000 + "' end", text.redact_literals)
    assert got == "bad '<redacted>' end"


@pytest.mark.parametrize("reply,kind", [
    ('{"needs_clarification": true}', "clarification"), (' {"needs_clarification": "no"} ', "clarification"),
    ('{"needs_clarification": false, "insight": "x"}', "insight"), ('{"insight": ""}', "sql"),
    ('{"insight": [], "needs_clarification": {}}', "sql"), ('{"insight": 0}', "sql"), ('{"insight": "false"}', "insight"),
    ('{"insight": "x"', "sql"), ("SELECT 1", "sql"), ('{"needs_clarification": 1, "insight": "x"}', "clarification"),
    ('{"insight": null}', "sql"), ('{"insight": [0]}', "insight"), ('["insight"]', "sql")])
def test_classify_reply(spark, reply, kind):
    assert one(spark, reply, replies.classify_reply) == kind


def test_paths(spark):
    assert one(spark, "a/b.tar.gz", text.base_name) == "a/b.tar"
    assert one(spark, "a.b/c", text.base_name) == "a.b/c"
    assert one(spark, "a/B.CSV", text.extension) == "csv"


def test_jaro_winkler_agrees_with_duckdb():
    rng, con = random.Random(3), duckdb.connect()
    words = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 12))) for _ in range(120)]
    words += ["".join(rng.choice(string.ascii_letters) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(1500)]
    con.execute("CREATE TABLE p (a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", pairs)
    for a, b, want in con.execute("SELECT a, b, jaro_winkler_similarity(a, b) FROM p").fetchall():
        assert jaro_winkler(a.encode(), b.encode()) == pytest.approx(want, abs=1e-12), (a, b)


def test_fuzzy_match_slices_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([("Revnue",), ("pric",), (None,), ("zzz",), ("Revnue",)], "c string")
    entries = ["revenue", "Revenue", "Price", "price", "Prize"]
    whole = rows(vocabulary.fuzzy_match(df, "c", entries))
    assert whole == [("Revnue", "Revenue"), ("pric", "price"), (None, None), ("zzz", None), ("Revnue", "Revenue")]
    monkeypatch.setattr(vocabulary, "SLICE", 2)
    assert rows(vocabulary.fuzzy_match(df, "c", entries)) == whole
    table = spark.createDataFrame([(e, i) for i, e in enumerate(entries)], "entry string, at long")
    assert sorted(rows(vocabulary.fuzzy_match(df, "c", table, order_by="at")), key=str) == sorted(whole, key=str)


def test_clean_tools(spark):
    df = spark.createDataFrame([(" a ", "", None), ("", " ", None), ("b  c", "x", None)], "k string, `` string, n string")
    cleaned = tidy.clean_text(df, collapse=True)
    assert rows(tidy.drop_empty_rows(cleaned)) == [("a", "", None), ("b c", "x", None)]
    assert rows(tidy.clean_report(df, collapse=True)) == [(3, 1, 0)]
    assert tidy.drop_empty_columns(df).columns == ["k", "", "n"]
    assert tidy.drop_empty_columns(df, ignore_header=True).columns == ["k", ""]
    assert tidy.clean_headers(df.toDF(" a", "b ", "c")).columns == ["a", "b", "c"]


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (2, "x"), (3, "y")], "a long, b string")
    assert rows(duplicates.duplicate_row_count(df)) == [(3,)]
    once = duplicates.keep_first(df.withColumn("id", F.monotonically_increasing_id()), ["id"])
    assert duplicates.keep_first(once, ["id"]).count() == once.count() == 3
    with pytest.raises(ValueError):
        duplicates.first_per_key(df, ["a"], [])


def test_null_order(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "v long")
    assert [r[0] for r in rows(ordering.sort_rows(df, ["v"]))] == [1, 2, None]
    assert [r[0] for r in rows(ordering.sort_rows(df, [("v", "desc")]))] == [2, 1, None]
    assert [r[0] for r in rows(ordering.grid_sort(df, "v", "desc"))] == [2, 1, None]


def test_grid_sort_by_locale(spark):
    df = spark.createDataFrame([("Z",), ("a",), ("é",), (None,), ("f",)], "v string")
    assert [r[0] for r in rows(ordering.grid_sort(df, "v", locale="fr"))] == ["a", "é", "f", "Z", None]


def test_group_agg_names_and_median(spark):
    df = spark.createDataFrame([("e", 1.0, 2), ("e", 3.0, 4), ("w", 5.0, 6)], "region string, price double, discount long")
    out = aggregates.group_agg(df, ["region"], [{"col": "discount", "fn": "mean"}, {"col": "price", "fn": "median"},
                                                {"col": "price", "fn": "sum"}])
    assert out.columns == ["region", "discount_mean", "price_median", "price_sum"]
    assert sorted(rows(out)) == [("e", 3.0, 2.0, 4.0), ("w", 6.0, 5.0, 5.0)]
    total = aggregates.group_agg(df, [], [{"col": "price", "fn": "median"}, {"col": "*", "fn": "count"}])
    assert rows(total) == [(3.0, 3)]
    with pytest.raises(ValueError):
        aggregates.group_agg(df, [], [{"col": "price", "fn": "mode"}])


def test_pivot_drops_null_and_needs_no_value_scan(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 5), ("b", "y", 2)], "g string, k string, v long")
    values_ = aggregates.distinct_values(df, "k")
    assert values_ == ["x", "y"]
    assert sorted(rows(aggregates.pivot_table(df, ["g"], "k", values_, F.sum("v"), "k_"), "g", "k_x", "k_y")) == [
        ("a", 1, None), ("b", None, 2)]
    with pytest.raises(ValueError):
        aggregates.distinct_values(df, "k", limit=1)


def test_chart_counts_text_as_zero(spark):
    df = spark.createDataFrame([(1, "b", "2"), (2, None, "x"), (3, "b", "3.5"), (4, None, None)], "id long, x string, y string")
    assert rows(aggregates.chart_series(df, "x", "y", "avg", "id")) == [("b", 2.75), ("null", 0.0)]


def test_nested(spark):
    df = spark.read.json(spark.sparkContext.parallelize(['{"a": {"b": {"c": 1}, "l": [1, 2]}, "d": null, "e": "x"}']))
    assert rows(nested.flatten_struct(df), "`a.b.c`", "`a.l`", "e") == [(1, "[1,2]", "x")]
    doc = spark.createDataFrame([(1, '{"k": 1.50, "u": {"v": true}}'), (2, '{"w w": [1, {"z": 2}]}'), (3, None)],
                                "id long, doc string")
    flat = nested.flatten_json_text(doc, "doc")
    assert sorted(flat.columns) == ["doc.k", "doc.u.v", "doc.w w", "id"]
    assert sorted(rows(flat, "id", "`doc.k`", "`doc.u.v`", "`doc.w w`")) == [
        (1, "1.5", "true", ""), (2, "", "", '[1,{"z":2}]'), (3, "", "", "")]
    with pytest.raises(ValueError):
        nested.flatten_json_text(spark.createDataFrame([("[1]",)], "doc string"), "doc")
    single = spark.createDataFrame([(1,)], "a long")
    assert nested.unwrap_array(single) is single


def test_profile_and_privacy(spark):
    df = spark.createDataFrame([("Alice", None, 30), ("Bob", "East", None), ("Charlie", "West", 35)],
                               "name string, region string, score long")
    got = {r.name: r for r in profile.profile(df).collect()}
    assert (got["region"].null_pct, got["region"].unique_count, got["region"].sample_values) == (33.3, 2, ["East", "West"])
    public = "\n".join(r[0] for r in rows(profile.schema_card(df), "line"))
    private = "\n".join(r[0] for r in rows(profile.schema_card(df, privacy=True), "line"))
    assert "Alice" in public and "e.g.: " in public
    assert "33.3% nulls" in private and not any(v in private for v in ["Alice", "East", "35", "e.g."])
    assert sorted(rows(profile.sample_rows(df, ["name"], 2))) == [("Alice", None, "30"), ("Bob", "East", None)]


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a long, b string")
    assert rows(profile.profile(df), "name", "null_pct", "unique_count") == [("a", None, 0), ("b", None, 0)]
    found = profile.insights(df)
    assert rows(found["counts"]) == [(0, 2)] and rows(found["duplicate_rows"]) == [(0,)]
    assert not rows(found["null_columns"]) and not rows(found["suggestions"]) and not rows(found["numeric_stats"])


def test_numeric_stats(spark):
    df = spark.range(1001).selectExpr("id % 100 AS few", "cast(id AS double) * 1.5 AS many", "'x' AS t", "cast(null AS int) AS e")
    want = {("few", 0.0, 99.0, 49.45, 49.0), ("many", 0.0, 1500.0, 750.0, 750.0)}
    for limit in (1, 7):
        assert set(rows(profile.numeric_stats(df.repartition(limit)))) == want
    assert {r[0] for r in rows(profile.numeric_stats(df, approx=True))} == {"few", "many"}


def test_hot_keys_and_lookup(spark):
    facts = spark.range(3000).selectExpr("id", "if(id % 3 = 0, id, 7) AS k")
    lookup = spark.range(3000).selectExpr("id AS key", "id * 10 AS v")
    assert rows(relations.hot_keys(facts, ["k"], share=0.1, at_least=10)) == [(7,)]
    plain = relations.lookup_join(facts, lookup, "k", "key")
    split = relations.lookup_join(facts, lookup, "k", "key", split_hot=True, hot_rows=100)
    assert sorted(rows(plain)) == sorted(rows(split))


def test_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    text_ = plan(cells.filter_rows(orders, ["o_totalprice > 1000"]).select("o_orderkey"))
    assert "GreaterThan(o_totalprice,1000.0)" in text_ and "o_orderpriority" not in text_.split("ReadSchema")[1]


def test_values_that_a_column_cannot_hold_widen_it(spark):
    df = spark.createDataFrame([(1, None), (None, "a")], "n int, t string")
    assert rows(cells.fill_nulls(df, "n", 0.9), "n") == [(1.0,), (0.9,)]
    assert cells.fill_nulls(df, "n", 7.0).dtypes[0] == ("n", "int") and cells.fill_nulls(df, "n", 2**40).dtypes[0] == ("n", "double")
    assert rows(cells.update_cells(df, {"n": 0.5, "t": 3}, "n = 1")) == [(0.5, "3"), (None, "a")]
    with pytest.raises(ValueError):
        cells.fill_nulls(df, "n", "none")


def test_codes_are_no_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ["5d", "12F", "1,240.5", " -3e2 ", ".5", "NaN", "", None, "1.2.3", "0x1F"]], "t string")
    assert rows(cells.parse_numbers(df, "t")) == [(x,) for x in [None, None, 1240.5, -300.0, 0.5, None, None, None, None, None]]
    assert cells.numeric_share(df).first().numeric_cells == 2


def test_renaming_a_missing_column_fails(spark, people):
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        cells.rename_columns(people, {"salary": "pay"})
    assert cells.rename_columns(people, {"NAME": "who"}).columns == ["who", "age", "city"]


def test_json_keys_named_like_types(spark):
    df = spark.createDataFrame([('{"AVOIDED": "x", "VOID": {"VARIANT s": [1, null]}, "n": null}',), ('{"OBJECTS": true}',)], "j string")
    got = nested.flatten_json_text(df, "j")
    assert sorted(got.columns) == ["j.AVOIDED", "j.OBJECTS", "j.VOID.VARIANT s", "j.n"]
    assert got.first()["j.AVOIDED"] == "x"


def test_records_without_elements_stay(spark):
    df = spark.createDataFrame([(["a"],), (None,), ([],)], "xs array<string>")
    assert rows(nested.unwrap_array(df)) == [("a",), ("",), ("",)]


def test_headers_are_cleaned_like_cells(spark):
    df = spark.createDataFrame([("x", "y")], ["a  b", " c"])
    assert tidy.clean_headers(df, collapse=True).columns == ["a b", "c"] and tidy.clean_headers(df).columns == ["a  b", "c"]
    assert tidy.clean_report(df, collapse=True).first().cells_touched == 2 and tidy.clean_report(df).first().cells_touched == 1


def test_ties_fall_alike_on_both_sides_of_the_border(spark, monkeypatch):
    df = spark.createDataFrame([(1, i) for i in range(20)], "k int, v long")
    got = []
    for border in (3, 100):
        monkeypatch.setattr("gridwash.operators.ordering.SMALL_LIMIT", border)
        pages = [rows(ordering.page_of(df, ["k"], p, 5), "v") for p in (1, 2, 3, 4)]
        assert sorted(r for page in pages for r in page) == [(i,) for i in range(20)]
        got.append([sorted(rows(ordering.top_n(df, ["k"], 5), "v")), *map(sorted, pages)])
    assert got[0] == got[1]
