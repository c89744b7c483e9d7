import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridwash.plans.limits import rate_limit
from gridwash.plans.steps import Step
from gridwash.session import new_path
from gridwash.streaming import jobs
from test_limits import brute_force, traffic


def land(spark, folder, data):
    (spark.createDataFrame(data, "user_id long, ts string, action string").withColumn("ts", F.to_timestamp("ts"))
          .coalesce(1).write.mode("append").parquet(folder))


SCHEMA = "user_id long, ts timestamp, action string"


def test_new_files_are_picked_up_once(spark):
    folder, out, state = (new_path(spark, n) for n in ("land", "out", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for day in (1, 2):
        land(spark, folder, [(day, f"2024-01-0{day} 00:00:00", "upload")])
        jobs.stream_ingest(spark, folder, schema, out, state).awaitTermination()
    assert sorted(rows(spark.read.parquet(out), "user_id")) == [(1,), (2,)]


def test_late_rows_are_dropped(spark):
    folder, out = new_path(spark, "land"), new_path(spark, "out")
    schema = spark.createDataFrame([], SCHEMA).schema
    for row in [(1, "2024-01-01 10:00:00", "upload"), (1, "2024-01-10 10:00:00", "upload"),
                (1, "2024-01-10 11:00:00", "upload"),
                (1, "2024-01-01 11:00:00", "upload"), (1, "2024-01-20 00:00:00", "upload")]:
        land(spark, folder, [row])
    stream = jobs.landing_stream(spark, folder, schema, files_per_trigger=1)
    jobs.write_stream(jobs.stream_usage(stream), out, new_path(spark, "state")).awaitTermination()
    got = dict(rows(spark.read.parquet(out).withColumn("day", F.to_date("window_start").cast("string")), "day", "uploads"))
    assert got == {"2024-01-01": 1, "2024-01-10": 2}


def test_whole_table_steps_are_refused_on_streams(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="sort"):
        jobs.stream_recipe(stream, [Step("sort", {"sort": ["value"]})])
    assert jobs.stream_recipe(stream, [Step("filter", {"where": "value > 1"})]).isStreaming


def test_request_limit_walks_a_user_across_batches(spark):
    folder, out = new_path(spark, "land"), new_path(spark, "out")
    requests = traffic(3, 2_000)
    cuts = [0, 40_000_000, 400_000_000, 10**15]  # equal times on both sides of a border belong to one file
    for low, high in zip(cuts, cuts[1:]):
        (spark.createDataFrame([r for r in requests if low <= r[1] < high], "user_id long, at long, request_id long")
              .coalesce(1).write.mode("append").parquet(folder))
    stream = jobs.landing_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
    jobs.stream_rate_limit(stream, out, new_path(spark, "state"), 5, 60).awaitTermination()
    got = {r.request_id: (r.accepted, r.retry_after) for r in spark.read.parquet(out).collect()}
    assert got == brute_force(requests, 5, 60)


def test_request_limit_keeps_what_a_batch_accepted(spark):
    """Accepted requests of an earlier batch come first at an equal time, and no row goes through state of a stream."""
    earlier = spark.createDataFrame([(1, 5, 9)], "user_id long, at long, request_id long")
    asked = spark.createDataFrame([(1, 5, 1)], "user_id long, at long, request_id long")
    assert rows(rate_limit(asked, 1, 60, earlier), "request_id", "accepted") == [(1, False)]


def test_open_windows_are_counted_and_go_on(spark):
    folder, out, state = (new_path(spark, n) for n in ("land", "out", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for hours, want in (((1, 2), 2), ((3,), 3)):
        land(spark, folder, [(1, f"2024-01-05 0{h}:00:00", "upload") for h in hours])
        jobs.stream_usage_now(jobs.landing_stream(spark, folder, schema), out, state).awaitTermination()
        assert rows(jobs.read_usage(spark, out), "user_id", "uploads", "actions") == [(1, want, want)]
