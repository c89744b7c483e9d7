"""Streams over the events as exports that land one after the other."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridwash.catalog.registry import Tables, query
from gridwash.catalog.reports import DAY, EXACT_LIMIT
from gridwash.plans.steps import Step
from gridwash.session import new_path
from gridwash.sources.ingest import sanitize_columns
from gridwash.streaming import jobs

CUTS = ["2024-01-11", "2024-01-21"]


def over_exports(t: Tables, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """All events land as three exports of many files each: before the first cut, before the second, and the rest, those
    without a time included. After each landing the stream is started on the folder and takes what is new as one batch."""
    folder, ev = new_path(t.spark, "landing"), t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    export = F.lit(len(CUTS))
    for i, cut in reversed(list(enumerate(CUTS))):
        export = F.when(F.col("ts") < F.lit(cut).cast("timestamp"), i).otherwise(export)
    for i in range(len(CUTS) + 1):
        ev.filter(export == i).write.mode("append").parquet(folder)
        start(jobs.landing_stream(t.spark, folder, ev.schema)).awaitTermination()


def _result(t: Tables, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    path, state, schemas = new_path(t.spark, "stream-out"), new_path(t.spark, "stream-state"), []

    def start(stream: DataFrame) -> StreamingQuery:
        built = build(stream)
        schemas.append(built.schema)
        return jobs.write_stream(built, path, state)

    over_exports(t, start)
    return t.spark.read.schema(schemas[0]).parquet(path)


@query("a15_stream_ingest", "SELECT event_id, user_id, event_type, value, props FROM events")
def a15(t: Tables):
    """Three exports, and a last run with nothing new: each file is taken once."""
    path, state, seen = new_path(t.spark, "ingested"), new_path(t.spark, "ingest-state"), []

    def start(stream: DataFrame) -> StreamingQuery:
        seen.append(stream)
        return jobs.write_stream(sanitize_columns(stream), path, state)

    over_exports(t, start)
    start(seen[-1]).awaitTermination()
    return t.spark.read.schema(seen[-1].schema).parquet(path).drop("ts")


@query("v1_stream_recipe", """
SELECT event_id, user_id, upper(event_type) AS event_type, CASE WHEN value > 50 THEN 50 ELSE value END AS value
FROM events WHERE event_type <> 'error'""")
def v1(t: Tables):
    steps = [Step("filter", {"where": "event_type <> 'error'"}),
             Step("normalize_case", {"columns": ["event_type"], "style": "upper"}),
             Step("update", {"set": {"value": 50}, "where": "value > 50"}),
             Step("drop_columns", {"columns": ["props", "ts"]})]
    return _result(t, lambda stream: jobs.stream_recipe(stream, steps))


@query("v1_recipe_per_batch", """
SELECT CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS export,
       event_type, MAX(value) AS value_max, COUNT(event_id) AS event_id_count FROM events GROUP BY 1, 2""")
def v1_batches(t: Tables):
    path, state = new_path(t.spark, "batches"), new_path(t.spark, "batch-state")
    steps = [Step("groupby", {"by": ["event_type"], "aggs": [{"col": "value", "fn": "max"},
                                                             {"col": "event_id", "fn": "count"}]})]
    over_exports(t, lambda stream: jobs.recipe_per_batch(stream, steps, path, state))
    return t.spark.read.parquet(path).withColumnRenamed("batch", "export")


def _actions(stream: DataFrame) -> DataFrame:
    return stream.withColumn("action", F.expr(
        "CASE event_type WHEN 'view' THEN 'upload' WHEN 'click' THEN 'transform' WHEN 'purchase' THEN 'chat_request' END"))


@query("v2_stream_usage", """
SELECT CAST(ts AS DATE) AS day, user_id, COUNT(*) FILTER (WHERE event_type = 'view') AS uploads,
       COUNT(*) FILTER (WHERE event_type = 'click') AS transforms,
       COUNT(*) FILTER (WHERE event_type = 'purchase') AS chat_requests, COUNT(*) AS actions
FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")
def v2(t: Tables):
    """Days the watermark has closed; v2_stream_usage_now has all days."""
    return _result(t, lambda stream: jobs.stream_usage(_actions(stream))).withColumn("day", F.to_date("window_start")).drop("window_start")


@query("v2_stream_usage_now", """
SELECT CAST(ts AS DATE) AS day, user_id, COUNT(*) FILTER (WHERE event_type = 'view') AS uploads,
       COUNT(*) FILTER (WHERE event_type = 'click') AS transforms,
       COUNT(*) FILTER (WHERE event_type = 'purchase') AS chat_requests, COUNT(*) AS actions
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def v2_now(t: Tables):
    """All days, the newest included; an event without a time is in no window."""
    path, state = new_path(t.spark, "usage"), new_path(t.spark, "usage-state")
    over_exports(t, lambda stream: jobs.stream_usage_now(_actions(stream), path, state))
    return jobs.read_usage(t.spark, path).withColumn("day", F.to_date("window_start")).drop("window_start")


@query("v3_stream_dedupe", "SELECT event_id, user_id, event_type FROM events")
def v3(t: Tables):
    """Every event lands twice within a day."""
    def first(stream: DataFrame) -> DataFrame:
        twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
        return jobs.stream_keep_first(twice, ["event_id"])

    return _result(t, first).select("event_id", "user_id", "event_type")


@query("v4_stream_rate_limit", EXACT_LIMIT)
def v4(t: Tables):
    path, state = new_path(t.spark, "stream-out"), new_path(t.spark, "stream-state")

    def start(stream: DataFrame) -> StreamingQuery:
        requests = stream.select("user_id", F.unix_micros("ts").alias("at"), F.col("event_id").alias("request_id"))
        return jobs.stream_rate_limit(requests, path, state, 3, DAY)

    over_exports(t, start)
    return t.spark.read.parquet(path).select(
        "user_id", "request_id", "accepted", F.round("retry_after", 3).alias("retry_after"))
