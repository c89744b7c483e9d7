"""Time operators on copies of the tables with one key holding a third of all rows.

usage: python tools/scale.py COPIES FOLDER [name ...]   (FOLDER: where the enlarged tables go; made once)
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from gridwash.operators import aggregates, duplicates, ordering, profile, relations, segments  # noqa: E402
from gridwash.plans import history, limits, reports  # noqa: E402
from gridwash.session import configure  # noqa: E402

SOURCE = "/root/testdata/sf0.1"


def enlarge(spark, copies: int, folder: str) -> None:
    """Every third row of lineitem goes to supplier 0, every third event to user 0."""
    times = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    items = (spark.read.parquet(f"{SOURCE}/lineitem.parquet").withColumn("copy", times)
             .withColumn("l_orderkey", F.col("l_orderkey") * copies + F.col("copy"))
             .withColumn("l_suppkey", F.when(F.xxhash64("l_partkey", "l_orderkey") % 3 == 0, 0).otherwise(F.col("l_suppkey"))))
    items.drop("copy").repartition(16).write.parquet(f"{folder}/lineitem.parquet")
    events = (spark.read.parquet(f"{SOURCE}/events.parquet").withColumn("copy", times)
              .withColumn("event_id", F.col("event_id") * copies + F.col("copy"))
              .withColumn("ts", F.expr("ts + make_dt_interval(0, 0, copy)"))
              .withColumn("user_id", F.when(F.xxhash64("event_id") % 3 == 0, 0).otherwise(F.col("user_id"))))
    events.drop("copy").repartition(8).write.parquet(f"{folder}/events.parquet")


def trials(items, events):
    requests = events.select("user_id", reports.micros(F.col("ts")).alias("at"), F.col("event_id").alias("request_id"))
    states = events.selectExpr("user_id", "ts", "event_id", "if(event_type = 'view', 'active', 'halted') AS status")
    return {
        "group_agg": lambda: aggregates.group_agg(items, ["l_suppkey"], [{"col": "l_extendedprice", "fn": "sum"}]),
        "median_per_supplier": lambda: segments.exact_median(items, ["l_suppkey"], "l_extendedprice"),
        "first_per_supplier": lambda: duplicates.first_per_key(items, ["l_suppkey"], ["l_shipdate", "l_orderkey"]),
        "distinct": lambda: duplicates.distinct_rows(items.select("l_suppkey", "l_partkey", "l_returnflag")),
        "number_parts": lambda: ordering.number_parts(items.select("l_orderkey", "l_linenumber"), ["l_orderkey"]),
        "row_numbers_per_supplier": lambda: segments.row_numbers(items.select("l_suppkey", "l_orderkey", "l_linenumber"),
                                                                 ["l_suppkey"], ["l_orderkey", "l_linenumber"]),
        "lookup_hot_key": lambda: relations.lookup_join(
            items.select("l_suppkey", "l_orderkey"), items.groupBy(F.col("l_suppkey").alias("k")).count(), "l_suppkey", "k"),
        "profile_approx": lambda: profile.profile(items, approx=True),
        "numeric_stats": lambda: profile.numeric_stats(items),
        "fingerprint": lambda: history.table_fingerprint(items),
        "tier_transitions": lambda: reports.tier_transitions(states),
        "rate_limit": lambda: limits.rate_limit(requests, 30, 60),
    }


def main() -> None:
    copies, folder, names = int(sys.argv[1]), sys.argv[2], sys.argv[3:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate())
    configure(spark).sparkContext.setLogLevel("ERROR")
    if not os.path.exists(f"{folder}/events.parquet/_SUCCESS"):
        enlarge(spark, copies, folder)
    items, events = spark.read.parquet(f"{folder}/lineitem.parquet"), spark.read.parquet(f"{folder}/events.parquet")
    print(f"{items.count()} line items, {events.count()} events")
    for name, run in trials(items, events).items():
        if names and name not in names:
            continue
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        print(f"{name:28} {time.perf_counter() - began:7.2f}s", flush=True)


if __name__ == "__main__":
    main()
