"""Streams over landing folders: ingest, recipes, usage counters, first occurrences, request limits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gridwash.plans.limits import rate_limit
from gridwash.plans.steps import ROW_WISE, Step, replay
from gridwash.sources.ingest import sanitize_columns


def landing_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                   files_per_trigger: int | None = None, **options) -> DataFrame:
    """Each file that lands in a folder, once. Streams take a fixed schema."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now and stop; run again for what lands later."""
    return (df.writeStream.format("parquet").outputMode(mode).option("path", path)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_ingest(spark: SparkSession, folder: str, schema: T.StructType, path: str, checkpoint: str,
                  fmt: str = "parquet", **options) -> StreamingQuery:
    return write_stream(sanitize_columns(landing_stream(spark, folder, schema, fmt, **options)), path, checkpoint)


def stream_recipe(stream: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """The row-wise steps of a recipe over a stream; other steps are refused before it starts."""
    others = [s.op for s in steps if s.op not in ROW_WISE]
    if others:
        raise ValueError(f"steps {others} need whole tables; use recipe_per_batch")
    return replay(stream, steps)


def recipe_per_batch(stream: DataFrame, steps: Sequence[Step], path: str, checkpoint: str) -> StreamingQuery:
    """Any recipe, applied to each micro-batch as a table of its own, under a batch number.

    A batch that is run again replaces its own folder, so nothing is written twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        replay(batch, steps).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())


def stream_usage(events: DataFrame, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """Counters per user and tumbling window from ``(user_id, ts, action)``; late rows are dropped."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", window), "user_id")
                  .agg(F.count_if(F.col("action") == "upload").alias("uploads"),
                       F.count_if(F.col("action") == "transform").alias("transforms"),
                       F.count_if(F.col("action") == "chat_request").alias("chat_requests"),
                       F.count(F.lit(1)).alias("actions"))
                  .select(F.col("window.start").alias("window_start"), "user_id", "uploads", "transforms",
                          "chat_requests", "actions"))


def stream_usage_now(events: DataFrame, path: str, checkpoint: str, delay: str = "1 day",
                     window: str = "1 day") -> StreamingQuery:
    """The counters of ``stream_usage`` with the windows that are still open, for ``read_usage``.

    Each micro-batch writes the counters it has changed; a batch that is run again replaces its own folder.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (stream_usage(events, delay, window).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The latest counters of each user and window."""
    written = spark.read.parquet(path)
    counters = [c for c in written.columns if c not in ("window_start", "user_id", "batch")]
    return (written.groupBy("window_start", "user_id").agg(F.max_by(F.struct(*counters), "batch").alias("latest"))
                   .select("window_start", "user_id", "latest.*"))


def stream_keep_first(events: DataFrame, keys: Sequence[str], delay: str = "1 day",
                      thin_first: bool = False) -> DataFrame:
    """First occurrence of each key; a key is forgotten once the watermark passes it by the delay.

    Streaming deduplication sends all copies of a key to one task. Where single keys have very many copies, ``thin_first``
    drops the later ones within each Arrow batch where they are read, at the price of every row passing through Python.
    """
    names = list(keys)

    def thin(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            yield batch.drop_duplicates(names)

    source = events.mapInPandas(thin, events.schema) if thin_first else events
    return source.withWatermark("ts", delay).dropDuplicatesWithinWatermark(names)


def stream_rate_limit(requests: DataFrame, path: str, checkpoint: str, max_requests: int = 30, window_seconds: int = 60,
                      delay_seconds: int = 60) -> StreamingQuery:
    """The exact request limit over a stream of ``(user_id, at, request_id)``, decisions by micro-batch.

    Files must land in time order. Each micro-batch is decided as a table, so no task holds the rows of a user. What it
    needs of earlier ones are the accepted requests of the last window and ``delay_seconds``, a few per user, which are
    written beside the checkpoint. A batch that is run again replaces its own folders.
    """
    kept_us = (window_seconds + delay_seconds) * 1_000_000

    def decide(batch: DataFrame, number: int) -> None:
        spark, names = batch.sparkSession, ["user_id", "at", "request_id"]
        earlier = spark.read.parquet(f"{checkpoint}-accepted/{number - 1}") if number else None
        out = f"{path}/batch={number}"
        rate_limit(batch.select(names), max_requests, window_seconds, earlier).write.mode("overwrite").parquet(out)
        decided = spark.read.parquet(out)
        last = decided.agg(F.max("at")).first()[0]
        accepted = decided.filter("accepted").select(names)
        if earlier is not None:
            accepted = accepted.unionByName(earlier)
        if last is not None:
            accepted = accepted.filter(F.col("at") > last - kept_us)
        accepted.write.mode("overwrite").parquet(f"{checkpoint}-accepted/{number}")

    return (requests.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
                    .trigger(availableNow=True).start())
