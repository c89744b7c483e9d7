"""Sliding-window request limits.

A request is accepted while fewer than ``max_requests`` accepted requests of the
user lie in the window before it; rejected ones do not count. Each decision
depends on earlier ones, so the rule is sequential, but only where a user comes
near the limit. Everywhere else plain counts prove that all requests pass.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwash.session import frozen

# Fixed values: (requests, seconds) of the limited actions.
BUCKETS = {"default": (30, 60), "download": (10, 60), "feedback": (5, 3600)}


def _slot(window_us: int) -> Column:
    return F.expr(f"(at - pmod(at, {window_us}L)) div {window_us}L")


def _decide(max_requests: int, window_us: int):
    """Walk sorted rows batch by batch; memory holds at most ``max_requests`` times."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, deque()
        for batch in batches:
            ok, wait = [], []
            for user, run_no, at in zip(batch["user_id"], batch["run"], batch["at"]):
                if (user, run_no) != current:
                    current, accepted = (user, run_no), deque()
                while accepted and accepted[0] <= at - window_us:
                    accepted.popleft()
                if len(accepted) >= max_requests:
                    ok.append(False)
                    wait.append(accepted[0] + window_us - at)
                else:
                    accepted.append(at)
                    ok.append(True)
                    wait.append(0)
            out = batch.assign(accepted=ok, wait_us=wait)
            yield out.loc[~(out["carried"] | out["earlier"]), ["user_id", "at", "request_id", "accepted", "wait_us"]]
    return run


def with_retry_after(decided: DataFrame) -> DataFrame:
    """Seconds until the next request would pass, NULL for accepted ones."""
    wait = F.when(~F.col("accepted"), F.col("wait_us") / F.lit(1e6))
    return decided.withColumn("retry_after", wait).drop("wait_us")


def rate_limit(requests: DataFrame, max_requests: int = 30, window_seconds: int = 60,
               earlier: DataFrame | None = None) -> DataFrame:
    """Decision and wait for each request of ``(user_id, at, request_id)``, ``at`` in microseconds.

    Time is cut into slots of one window length. If a slot and the one before it
    hold no more requests than the limit, everything in the slot passes; such
    slots also show the exact state at their end. Runs of the other slots are
    independent, so a user with very many requests spreads over as many tasks as
    there are busy runs; only within a run are rows walked in order, as a stream.

    ``earlier`` are requests that were accepted before all of these. They count and come first at equal times, but are
    not decided again.
    """
    window_us = window_seconds * 1_000_000
    rows = requests.select("user_id", "at", "request_id", F.lit(False).alias("earlier"))
    if earlier is not None:
        rows = rows.unionByName(earlier.select("user_id", "at", "request_id", F.lit(True).alias("earlier")))
    rows = rows.withColumn("slot", _slot(window_us))
    counts = rows.groupBy("user_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    # Each slot counts for itself and for the slot after it.
    shares = F.array(F.struct(F.col("slot").alias("slot"), F.col("n").alias("own"), F.lit(0).cast("bigint").alias("before")),
                     F.struct((F.col("slot") + 1).alias("slot"), F.lit(0).cast("bigint").alias("own"),
                              F.col("n").alias("before")))
    busy = (counts.select("user_id", F.inline(shares)).groupBy("user_id", "slot")
                  .agg(F.sum("own").alias("own"), F.sum("before").alias("before"))
                  .filter((F.col("own") > 0) & (F.col("own") + F.col("before") > max_requests)))
    # One row per user and window length at most, whatever the number of requests.
    by_user = Window.partitionBy("user_id").orderBy("slot")
    runs = (busy.withColumn("run", F.col("slot") - F.row_number().over(by_user))
                .select("user_id", "slot", "run"))
    starts = runs.groupBy("user_id", "run").agg((F.min("slot") - 1).alias("slot"))
    places = frozen(runs.withColumn("carried", F.lit(False))
                    .unionByName(starts.select("user_id", "slot", "run", F.lit(True).alias("carried"))), "busy-slots")
    placed = rows.join(places, ["user_id", "slot"], "left")
    passed = (placed.filter("(run IS NULL OR carried) AND NOT earlier")
                    .select("user_id", "at", "request_id", F.lit(True).alias("accepted"),
                            F.lit(None).cast("double").alias("retry_after")))
    kind = dict(requests.dtypes)
    decided = (placed.filter("run IS NOT NULL").select("user_id", "run", "at", "request_id", "carried",
                                                      "earlier")
                     .repartition("user_id", "run")
                     .sortWithinPartitions("user_id", "run", "at", F.desc("earlier"), "request_id")
                     .mapInPandas(_decide(max_requests, window_us),
                                  f"user_id {kind['user_id']}, at bigint, request_id {kind['request_id']}, "
                                  "accepted boolean, wait_us bigint"))
    return passed.unionByName(with_retry_after(decided))


def requests_in_window(requests: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Requests of the same user in the window before each one: an upper bound on the accepted ones.

    The window frame runs per user and slot, with the slot before it for context,
    so no task holds a user's whole history.
    """
    window_us = window_seconds * 1_000_000
    rows = requests.withColumn("slot", _slot(window_us))
    both = rows.withColumn("for_slot", F.explode(F.array(F.col("slot"), F.col("slot") + 1)))
    frame = Window.partitionBy("user_id", "for_slot").orderBy("at").rangeBetween(-window_us + 1, -1)
    return (both.withColumn("requests_before", F.count(F.lit(1)).over(frame))
                .filter("slot = for_slot").drop("slot", "for_slot"))
