import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridwash.plans import history
from gridwash.plans.recipes import (Recipe, RecipeError, apply_recipe, apply_recipe_many, renumber_after, require_steps,
                                    snapshot_steps)
from gridwash.plans.steps import Step, replay

OLDER = Step("filter", {"where": "age > 28"})
BY_AGE = Step("sort", {"sort": [{"col": "age", "dir": "desc"}]})


def plus(expr="a + 1"):
    return Step("add_columns", {"columns": [{"name": "a", "expr": expr}]})


def base(spark):
    return spark.createDataFrame([(i,) for i in range(1, 6)], "a long")


def test_filter_then_sort(people):
    assert {r[0] for r in rows(replay(people, [OLDER]))} == {"Alice", "Charlie"}
    assert [r[0] for r in rows(replay(people, [OLDER, BY_AGE]))] == ["Charlie", "Alice"]


def test_up_to(people):
    steps = [OLDER, BY_AGE]
    assert replay(people, steps, 0) is people
    assert rows(replay(people, steps, 2)) == rows(replay(people, steps))
    for k in (-1, 3):
        with pytest.raises(ValueError):
            replay(people, steps, k)


def test_schema_after_steps_needs_no_job(people):
    df = replay(people, [Step("select", {"columns": ["name", "age"]}),
                         Step("add_columns", {"columns": [{"name": "half", "expr": "age / 2"}]})])
    assert df.dtypes == [("name", "string"), ("age", "bigint"), ("half", "double")]


def test_recipe_on_next_export(spark, people):
    target = spark.createDataFrame([("Dana", 40, "SF"), ("Eve", 22, "NYC"), ("Frank", 31, "LA"), ("Grace", 29, "SEA")],
                                   people.schema)
    recipe = Recipe.of("older", people, [OLDER, BY_AGE])
    assert [r[0] for r in rows(apply_recipe(recipe, target))] == ["Dana", "Frank", "Grace"]
    existing = [Step("sql", {"query": "SELECT * FROM data WHERE city != 'SF'"})]
    assert [r[0] for r in rows(apply_recipe(recipe, target, existing))] == ["Frank", "Grace"]
    assert Recipe.from_json(recipe.to_json()) == recipe


def test_recipe_that_does_not_fit_names_the_columns(spark, people):
    recipe = Recipe.of("older", people.withColumnRenamed("city", "Revenue"),
                       [Step("filter", {"where": "revenue > 1"})])
    with pytest.raises(RecipeError, match="lacks Revenue"):
        apply_recipe(recipe, people)
    assert recipe.missing_in(spark.createDataFrame([], "AGE long, name string")) == ["Revenue"]


def test_stored_sql_is_checked_again(people):
    recipe = Recipe("bad", (OLDER, Step("sql", {"query": "SELECT 1; DROP TABLE data"})))
    with pytest.raises(RecipeError, match="step 2"):
        apply_recipe(recipe, people)


def test_recipe_needs_steps():
    with pytest.raises(RecipeError):
        Recipe("none", ())


def test_snapshot_renumbers_from_one(spark):
    log = spark.createDataFrame([(1, 7, " b ", "B", "x"), (1, 3, None, "A", "y"), (2, 1, "c", "C", "z")],
                                "file_id long, step_number long, instruction string, sql_query string, row_count string")
    snap = snapshot_steps(log)
    assert snap.columns == ["file_id", "step_number", "instruction", "sql_query"]
    assert sorted(rows(snap)) == [(1, 1, "", "A"), (1, 2, "b", "B"), (2, 1, "c", "C")]
    after = renumber_after(snap, log.filter("file_id = 2"))
    assert sorted(rows(after, "file_id", "step_number")) == [(1, 1), (1, 2), (2, 2)]
    files = spark.createDataFrame([(1,), (2,), (3,)], "file_id long")
    assert rows(require_steps(files, log)) == [(3,)]


def test_sql_step_binds_every_data_to_the_current_table(people):
    steps = [OLDER, Step("sql", {"query": "SELECT x.name FROM data x JOIN data y ON x.age < y.age -- the older one"})]
    assert rows(replay(people, steps)) == [("Alice",)]


def test_many_exports_stay_apart(spark):
    df = spark.createDataFrame([("jan", "x", 1), ("jan", "x", 2), ("feb", "x", 5)], "month string, k string, v long")
    recipe = Recipe.of("sum", df, [Step("groupby", {"by": ["k"], "aggs": [{"col": "v", "fn": "sum"}]})])
    assert sorted(rows(apply_recipe_many(recipe, df, "month"))) == [("feb", "x", 5), ("jan", "x", 3)]


ALONE = [
    [Step("limit", {"n": 1, "sort": [{"col": "v", "dir": "desc"}]})], [Step("drop_empty_rows")], [Step("dropna")],
    [Step("clean_text")], [Step("distinct")], [Step("keep_first", {"keys": ["k"], "order_by": ["v"]})],
    [Step("add_columns", {"columns": [{"name": "share", "expr": "v / sum(v) over ()"}]})],
    [Step("filter", {"where": "v > 1"})], [Step("filter", {"where": "v = (select 2)"})],
    [Step("update", {"set": {"v": 0.5}, "where": "v = 2"})],
    [Step("sql", {"query": "SELECT k, count(*) n, max(v) m FROM data GROUP BY k"}), Step("filter", {"where": "n > 1"})],
    [Step("groupby", {"by": ["k"], "aggs": [{"col": "v", "fn": "sum"}]})], [Step("drop_empty_columns", {"ignore_header": True})],
    [Step("select", {"columns": ["v"]})], [Step("sort", {"sort": [{"col": "v", "dir": "asc"}]})],
]


@pytest.mark.parametrize("steps", ALONE, ids=lambda s: s[0].op)
def test_many_exports_equal_each_alone(spark, steps):
    df = spark.createDataFrame([(" jan", "x", 1), (" jan", " x ", 2), (" jan", None, None), ("feb", "x", 5), ("feb", "", None),
                                ("feb", "x", 5), (None, "y", 2)], "month string, k string, v long")
    recipe = Recipe.of("r", df, steps)
    got = apply_recipe_many(recipe, df, "month")
    want = []
    for month in (" jan", "feb", None):
        alone = apply_recipe(recipe, df.filter(F.col("month").eqNullSafe(F.lit(month))).drop("month"))
        want += [{"month": month, **{c: None for c in got.columns if c != "month"}, **r.asDict()} for r in alone.collect()]
    assert sorted(map(str, (dict(sorted(r.asDict().items())) for r in got.collect()))) == sorted(
        str(dict(sorted(w.items()))) for w in want)


def test_recipe_from_stored_rows(people):
    stored = [{"step_number": 2, "instruction": " by age ", "sql_query": "SELECT name FROM data ORDER BY age DESC"},
              {"step_number": 1, "instruction": None, "sql_query": "SELECT * FROM data WHERE age > 28;"}]
    recipe = Recipe.from_rows("older", stored)
    assert [s.instruction for s in recipe.steps] == ["", "by age"]
    assert rows(apply_recipe(recipe, people)) == [("Charlie",), ("Alice",)]
    for bad in ([], [{"step_number": 1, "instruction": "", "sql_query": "DROP TABLE data"}]):
        with pytest.raises(RecipeError):
            Recipe.from_rows("bad", bad)


def test_stored_chains_change_no_result(spark):
    df = base(spark)
    for n in (1, 4, 5, 6, 11):
        steps = [plus()] * n
        for _ in range(2):
            assert sorted(rows(history.replay_checkpointed("same", df, steps, every=5))) == [(i + n,) for i in range(1, 6)]


def test_longer_chains_go_on_from_the_longest_stored_beginning(spark):
    nothing, steps = base(spark).limit(0), [plus()] * 9
    history.replay_checkpointed("grow", base(spark), steps[:4], every=4)
    history.replay_checkpointed("grow", base(spark), steps[:8], every=4)
    # Without any row in the table itself, what comes out was stored.
    assert len(rows(history.replay_checkpointed("grow", nothing, steps, every=4))) == 5
    assert len(rows(history.replay_checkpointed("grow", nothing, steps[:5], every=4))) == 5
    assert rows(history.replay_checkpointed("grow", nothing, steps[:3], every=4)) == []
    assert rows(history.replay_checkpointed("grow", nothing, [*steps[:3], plus("a * 2"), steps[4]], every=4)) == []
    assert rows(history.replay_checkpointed("another", nothing, steps, every=4)) == []


def test_only_the_folder_is_forgiven(spark, monkeypatch, caplog):
    df, steps = base(spark), [plus()] * 6

    def full(*_):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(history.ChainStore, "write", full)
        assert sorted(rows(history.replay_checkpointed("full", df, steps, every=3)))[0] == (7,)
        m.setattr(history.ChainStore, "finished", full)
        assert sorted(rows(history.replay_checkpointed("full", df, steps, every=3)))[0] == (7,)
    assert sum("no space" in r.getMessage() for r in caplog.records) == 2
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|CAST_INVALID_INPUT"):
        history.replay_checkpointed("broken", df, [*steps, plus("cast('x' as bigint)")], every=3)
    monkeypatch.setattr(history, "ChainStore", lambda *a: pytest.fail("must not look for stored chains"))
    assert sorted(rows(history.replay_checkpointed("off", df, steps, every=0)))[0] == (7,)


def test_sql_steps_read_data_alone(spark, people):
    people.createOrReplaceTempView("secret")
    people.limit(0).createOrReplaceTempView("data")
    for sql in ("SELECT * FROM secret", "SELECT (SELECT max(age) FROM secret) FROM data", "SELECT * FROM default.secret",
                "WITH x AS (WITH secret AS (SELECT 1) SELECT * FROM secret) SELECT * FROM secret"):
        with pytest.raises(ValueError, match="another table"):
            replay(people, [Step("sql", {"query": sql})])
    views = {t.name for t in spark.catalog.listTables()}
    got = replay(people, [Step("sql", {"query": "WITH data AS (SELECT * FROM data WHERE age > 28) SELECT name FROM data -- end"})])
    assert sorted(rows(got)) == [("Alice",), ("Charlie",)]
    assert {t.name for t in spark.catalog.listTables()} == views and spark.table("data").count() == 0
    for name in ("secret", "data"):
        spark.catalog.dropTempView(name)


def test_fingerprint(spark, people):
    first = history.table_fingerprint(people).first()
    assert history.table_fingerprint(people.orderBy("age").repartition(3)).first() == first
    assert history.table_fingerprint(replay(people, [Step("update", {"set": {"city": "X"}, "where": "age > 99"})])).first() == first
    assert history.table_fingerprint(people.unionAll(people)).first() != first
    nulls = spark.createDataFrame([(None, "")], "a string, b string")
    blanks = spark.createDataFrame([("", None)], "a string, b string")
    for portable in (True, False):
        assert (history.table_fingerprint(nulls, portable).first()
                != history.table_fingerprint(blanks, portable).first())
        assert (history.table_fingerprint(people.repartition(3), portable).first()
                == history.table_fingerprint(people, portable).first())


def test_step_audit(people):
    audit = history.step_audit(people, [OLDER, Step("drop_columns", {"columns": ["city"]})]).collect()
    assert [(a.rows_before, a.rows_after) for a in audit] == [(3, 2), (2, 2)]
    assert audit[1].columns_after == ["name", "age"]
    assert audit[0].fingerprint_after == audit[1].fingerprint_before


def test_schema_drift_refuses_unknown_baseline(spark):
    catalog = spark.createDataFrame([("jan", "A", "int"), ("feb", "a", "string"), ("feb", "b", "int")],
                                    "export string, name string, dtype string")
    drift = {r.export: r for r in history.schema_drift(catalog, "jan").collect()}
    assert (drift["feb"].new_columns, drift["feb"].retyped_columns, drift["feb"].missing_columns) == (1, 1, 0)
    with pytest.raises(ValueError):
        history.schema_drift(catalog, "mar")
