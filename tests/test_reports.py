import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridwash.operators import ordering
from gridwash.plans import reports

LIMITS = {"free": {"uploads": 2, "transforms": 0}, "pro": {"uploads": 100}}


def test_limits_block_at_the_limit(spark):
    users = spark.createDataFrame([(1, "free"), (2, "pro"), (3, "gold"), (4, "free")], "user_id long, tier string")
    usage = spark.createDataFrame([(1, 2, 999, 5), (2, 2, 0, 0), (3, 2, 0, 0)],
                                  "user_id long, uploads long, transforms long, chat_requests long")
    got = {(u, a): b for u, a, b in rows(reports.usage_status(users, usage, LIMITS), "user_id", "action", "blocked")}
    assert got[1, "uploads"] and got[3, "uploads"]
    assert not got[2, "uploads"] and not got[4, "uploads"]
    assert not got[1, "transforms"] and not got[1, "chat_requests"]


def test_increments_equal_one_rollup(spark):
    data = [(u, f"2024-0{m}-01 00:00:00", a, r) for u in (1, 2) for m in (1, 2) for a in ("upload", "transform") for r in (3, 4)]
    df = spark.createDataFrame(data, "user_id long, ts string, action string, rows long").withColumn("ts", F.to_timestamp("ts"))
    whole = reports.usage_rollup(df)
    parts = reports.usage_increment(reports.usage_rollup(df.filter("rows = 3")), reports.usage_rollup(df.filter("rows = 4")))
    assert sorted(rows(whole)) == sorted(rows(parts.select(*whole.columns)))


def test_renewals_do_not_count(spark):
    df = spark.createDataFrame([(1, 1, 1, "active"), (1, 2, 2, "charged"), (1, 3, 3, "halted"), (1, 4, 4, "resumed"),
                                (2, 1, 5, "created")], "user_id long, ts long, event_id long, status string")
    assert sorted(rows(reports.tier_transitions(df), "event_id")) == [(1,), (4,)]


def test_activation_ignores_anonymous_and_negative_waits(spark):
    files = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-02 00:00:00"),
                                   (3, "anonymous", "2024-01-02 00:00:00"), (4, "c", "2024-01-05 00:00:00")],
                                  "id long, user_id string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    moves = spark.createDataFrame([(1, "2024-01-01 00:30:00"), (1, "2024-01-01 02:00:00"), (4, "2024-01-04 00:00:00")],
                                  "file_id long, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    assert rows(reports.activation_report(files, moves)) == [("2024-01", 3, 3, 2, 66.7, 30.0)]


def test_context_takes_the_last_turns(spark):
    talk = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}", "SELECT 1" if i == 13 else None)
                                  for i in range(15)], "conv_id long, turn long, role string, text string, sql string")
    lines = rows(reports.conversation_context(talk))[0][1].split("\n")
    assert len(lines) == 10 and lines[0] == "Assistant: t5" and lines[-2:] == ["Assistant: [executed SQL: SELECT 1]", "User: t14"]


def test_stalled_and_retention(spark):
    jobs = spark.createDataFrame([(1, "processing", "2024-01-01 00:00:00"), (2, "processing", "2024-01-01 00:00:00"),
                                  (3, "failed", "2024-01-01 00:00:00"), (4, "completed", "2024-01-02 12:00:00")],
                                 "id long, status string, updated_at string").withColumn("updated_at", F.to_timestamp("updated_at"))
    live = spark.createDataFrame([(2,), (2,)], "id long")
    assert sorted(rows(reports.stalled_work(jobs, live), "id", "status")) == [
        (1, "failed"), (2, "processing"), (3, "failed"), (4, "completed")]
    kept = reports.retention_prune(jobs, F.lit("2024-01-03 00:00:00").cast("timestamp"))
    assert sorted(rows(kept, "id")) == [(1,), (2,), (4,)]


@pytest.mark.parametrize("page,size,want", [(1, 2, ["f9", "f8"]), (2, 2, ["f7", "f6"]), (1, 500, 10)])
def test_paging(spark, page, size, want):
    df = spark.createDataFrame([(i, f"f{i}", i, i) for i in range(10)], "id long, name string, created_at long, row_count long")
    got = rows(ordering.paginate(df, page=page, page_size=size, sort="size", direction="up"), "name", "total")
    assert len(got) == want if isinstance(want, int) else [g[0] for g in got] == want
    assert {g[1] for g in got} == {10}
