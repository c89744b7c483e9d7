"""What a SQL step may read, wherever it tries."""

import pytest
from conftest import rows

from gridwash.plans import guard
from gridwash.plans.policy import BLOCKED_CALL, PolicyError
from gridwash.plans.steps import Step, replay

PASS = [
    "SELECT * FROM data", "SELECT * FROM `data` d JOIN DATA e USING (name)", "SELECT 1 AS one", "SELECT * FROM (TABLE data)",
    "WITH a AS (SELECT * FROM data), b AS (SELECT * FROM a) SELECT * FROM b, a",
    "WITH a AS (SELECT 1 AS x) SELECT (SELECT max(x) FROM a), (WITH b AS (SELECT * FROM a) SELECT max(x) FROM b) FROM data",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT * FROM t",
    "WITH data AS (SELECT * FROM data WHERE age > 1) SELECT * FROM data",
    "SELECT * FROM data |> WHERE age > 1 |> SELECT name", "SELECT name, x FROM data LATERAL VIEW explode(array(1, 2)) AS x",
    "SELECT * FROM data d, LATERAL (SELECT d.age + 1 AS next)", "SELECT * FROM VALUES (1), (2) AS v(x) JOIN data ON age > x",
    "SELECT /*+ BROADCAST(data) */ sum(age) OVER w FROM data WINDOW w AS (PARTITION BY city ORDER BY age)",
    "SELECT city FROM data GROUP BY city HAVING count(*) > (SELECT 0) ORDER BY city LIMIT 3 OFFSET 1",
    "SELECT * FROM data PIVOT (sum(age) FOR city IN ('LA', 'NYC'))", "SELECT * FROM data TABLESAMPLE (50 PERCENT)",
    "SELECT EXTRACT(DAY FROM to_date('2024-01-01')), trim(BOTH FROM (' a ')), substring('abc' FROM abs(-2)) FROM data",
    "SELECT 'FROM secret', \"name\" FROM data -- FROM secret", "SELECT * FROM data UNION SELECT * FROM data EXCEPT SELECT * FROM data",
    "SELECT transform(array(age), y -> y + 1), age IN (SELECT age FROM data) FROM data", "SELECT count(*) FROM data GROUP BY ALL",
]
REFUSED = {
    "SELECT * FROM secret": "secret", "SELECT * FROM default.secret": "default.secret", "SELECT * FROM spark_catalog.default.data":
    "spark_catalog.default.data", "SELECT * FROM IDENTIFIER('secret')": "IDENTIFIER", "SELECT * FROM IDENTIFIER('sec' || 'ret')": "IDENTIFIER",
    "SELECT * FROM IDENTIFIER('data')": "IDENTIFIER", "SELECT IDENTIFIER('abs')(age) FROM data": "IDENTIFIER",
    "SELECT 1 FROM data WHERE EXISTS (SELECT 1 FROM IDENTIFIER('secret'))": "IDENTIFIER",
    "WITH x AS (SELECT * FROM IDENTIFIER('secret')) SELECT * FROM x": "IDENTIFIER",
    "SELECT (SELECT max(age) FROM secret) FROM data": "secret", "SELECT age IN (SELECT age FROM secret) FROM data": "secret",
    "SELECT sum(age) OVER w FROM data WINDOW w AS (PARTITION BY (SELECT 1 FROM secret))": "secret",
    "SELECT count(*) FILTER (WHERE age IN (SELECT age FROM secret)) FROM data": "secret",
    "SELECT name FROM data ORDER BY (SELECT max(age) FROM secret)": "secret",
    "SELECT * FROM data d JOIN data e ON d.age = (SELECT max(age) FROM secret)": "secret",
    "SELECT * FROM data, LATERAL (SELECT * FROM secret)": "secret", "SELECT * FROM data, secret": "secret",
    "SELECT * FROM data |> UNION ALL (SELECT * FROM secret)": "secret",
    "WITH x AS (WITH secret AS (SELECT 1) SELECT * FROM secret) SELECT * FROM secret": "secret",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a": "b", "WITH a AS (SELECT * FROM a) SELECT * FROM a": "a",
    "SELECT (WITH secret AS (SELECT 1 AS x) SELECT x FROM secret), (SELECT max(age) FROM secret) FROM data": "secret",
    "SELECT * FROM data VERSION AS OF 3": "AS OF", "SELECT * FROM data TIMESTAMP AS OF '2024-01-01'": "AS OF",
    "SELECT * FROM range(3)": "range", "SELECT * FROM explode(array(1))": "explode", "SELECT * FROM data JOIN range(3) r ON true": "range",
    "SELECT 1 FROM data WHERE EXISTS (SELECT 1 FROM range(3))": "range", "SELECT * FROM STREAM data": "data",
    "SELECT * FROM data WITH (`path` = '/tmp/x')": "data", "SELECT `reflect`('java.lang.Math', 'abs', -5)": "REFLECT",
    "SELECT * FROM default.`secret`": "default.secret",
}


@pytest.fixture
def secret(spark, people):
    people.selectExpr("age AS secret", "*").createOrReplaceTempView("secret")
    yield
    spark.catalog.dropTempView("secret")


@pytest.mark.parametrize("sql", PASS)
def test_passes_and_runs(sql, people, secret):
    replay(people, [Step("sql", {"query": sql})]).collect()


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(sql, people, secret):
    with pytest.raises(PolicyError) as exc:
        replay(people, [Step("sql", {"query": sql})])
    assert exc.value.verdict == (BLOCKED_CALL if REFUSED[sql] == "REFLECT" else guard.OTHER_TABLE)
    assert exc.value.blocked == REFUSED[sql]


def test_not_a_query(people):
    for sql in ("SELECT 1) UNION (SELECT 2", "SELECT 1 +", "SELECT 1 /* open", "SELECT * FROM data WHERE ("):
        with pytest.raises(PolicyError) as exc:
            replay(people, [Step("sql", {"query": sql})])
        assert exc.value.verdict == guard.NOT_QUERY


def test_names_differ_in_case_where_the_session_says_so(spark, people):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(PolicyError, match="another table: Data"):
            replay(people, [Step("sql", {"query": "SELECT * FROM Data"})])
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_a_scan_says_what_a_step_does(spark, people, monkeypatch):
    monkeypatch.setattr(guard, "SHAPES_AT_ONCE", 7)
    texts = [*PASS, *REFUSED, "SELECT 1) UNION (SELECT 2", "drop table x", None, "select 'a' from `x``'y` where b = 12.5e3", "SELECT r'\\' FROM b"]
    frame = spark.createDataFrame([(t, "x", 1) for t in texts for _ in range(3)], "q string, shape string, SHAPE_verdict long")
    found = guard.policy_scan(frame, "q")
    assert found.columns == ["q", "shape", "SHAPE_verdict", "cleaned_sql", "verdict", "blocked_keyword"] and found.count() == 3 * len(texts)
    for text, verdict, blocked in set(rows(found, "q", "verdict", "blocked_keyword")):
        try:
            guard.checked_query(spark, text)
            assert (verdict, blocked) == ("ok", None), text
        except PolicyError as exc:
            assert verdict == exc.verdict and blocked == (None if verdict == guard.NOT_QUERY else exc.blocked), text


def test_texts_of_one_pattern_have_one_shape(spark):
    texts = [f"SELECT * FROM data WHERE a = 'it''s {i}' AND b > {i * 10} -- {i}\n AND \"c 1\" = r'{i}\\'" for i in range(20)]
    assert spark.createDataFrame([(t,) for t in texts], "q string").select(guard.shape("q")).distinct().count() == 1
    names = spark.createDataFrame([("SELECT * FROM `x 11`",), ("SELECT * FROM `x 21`",), ('SELECT * FROM "x 31"',)], "q string")
    assert names.select(guard.shape("q")).distinct().count() == 3
