"""Vectors packed into blocks, and blocks of queries that meet every block once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwash.llm.common import bounded_batches

QUERY_BLOCK = 256
BUCKETS_PER_PARTITION = 4


def usable(column: str, zero: bool) -> Column:
    """Vectors that can be compared: not NULL or empty, every component finite, and not all zero unless ``zero``."""
    v = F.col(f"`{column}`").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (F.lit(zero) | F.exists(v, lambda x: x != 0)), F.lit(False))


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """``block, dims, ids, values`` from rows of ``id long, v array<double>``: up to ``rows`` vectors of one length each.

    Rows are packed where they are, without a shuffle.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, nth, held = TaskContext.get().partitionId() << 32, 0, {}

        def block(dims: int, ids: list, parts: list) -> pd.DataFrame:
            return pd.DataFrame({"block": [first + nth], "dims": [dims], "ids": [np.concatenate(ids).tobytes()],
                                 "values": [np.concatenate(parts).tobytes()]})

        for batch in batches:
            lengths = batch["v"].map(len).to_numpy()
            for dims in np.unique(lengths):
                here = batch[lengths == dims]
                ids, values = held.setdefault(int(dims), ([], []))
                ids.append(here["id"].to_numpy(np.int64))
                values.append(np.stack(here["v"].to_numpy()).astype(np.float64))
                whole_ids, whole = np.concatenate(ids), np.concatenate(values)
                while len(whole_ids) >= rows:
                    yield block(int(dims), [whole_ids[:rows]], [whole[:rows]])
                    nth += 1
                    whole_ids, whole = whole_ids[rows:], whole[rows:]
                held[int(dims)] = ([whole_ids], [whole])
        for dims, (ids, values) in held.items():
            if len(ids[0]):
                yield block(dims, ids, values)
                nth += 1

    bounded_batches(vectors.sparkSession, rows=4_096)
    return vectors.mapInPandas(pack, "block long, dims int, ids binary, values binary")


def unpacked(dims: int, ids: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(values, dtype=np.float64).reshape(-1, dims)


def meet(queries: DataFrame, blocks: DataFrame, compare: Callable) -> DataFrame:
    """``query_id, vec_id, score`` of each block of queries with each block of vectors of the same length.

    Blocks are dealt into buckets, a few per partition, and every query block goes to every bucket once, so a pair meets in
    one place and only query blocks are copied. ``compare`` takes two rows as dicts and gives three arrays.
    """
    spark = blocks.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = blocks.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int"))
    right = queries.select(F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"),
                           F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("q_bucket"))
    # Spark would judge the copies by the size of what they are copied from, so no side is left to be broadcast.
    pairs = left.hint("merge").join(right.hint("merge"),
                                    (F.col("bucket") == F.col("q_bucket")) & (F.col("dims") == F.col("q_dims")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query, vec, score = compare(row)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()),
                                                  pa.array(score)], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(compared, f"query_id long, vec_id long, score {compare.score_type}")


def ranked(found: DataFrame, k: int, best: Column) -> DataFrame:
    """The ``k`` best rows of each query, ties to the smaller id, with their rank."""
    # Spark cuts to k rows per query in every map task already.
    order = Window.partitionBy("query_id").orderBy(best, "vec_id")
    return (found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
