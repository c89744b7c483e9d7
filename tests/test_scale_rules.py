"""What must hold however large a table is."""

import pathlib

import pytest
from pyspark.sql import functions as F

from gridwash.session import new_path, shared_folder

ROOT = pathlib.Path(__file__).parent.parent


def test_no_local_checkpoints_or_cross_joins():
    for path in (ROOT / "gridwash").rglob("*.py"):
        text = path.read_text()
        for word in ("localCheckpoint", "crossJoin", ".toPandas(", ".rdd", "F.udf("):
            assert word not in text, (path, word)


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        shared_folder(Cluster())
    assert new_path(spark, "x") != new_path(spark, "x")


def test_session_settings(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_sql_steps_leave_the_session_as_it_was(spark, people):
    from gridwash.plans.steps import sql_step
    before = spark.conf.get("spark.sql.runSQLOnFiles"), spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
    assert sql_step(people, 'SELECT "name" FROM data WHERE city = \'LA\'').collect()[0][0] == "Bob"
    assert before == (spark.conf.get("spark.sql.runSQLOnFiles"), spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers"))
    assert people.filter(F.expr('city == "LA"')).count() == 1
