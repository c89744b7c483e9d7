"""Centroid clustering of whole-number vectors, exact, with heap-ordered bounds.

Vectors lie in blocks. A block keeps one heap for each cluster: its vectors there, ordered by their gap, the distance to the
second nearest centroid less the distance to their own. When centroids move, no vector is touched: the gap of every vector
of a cluster shrinks by at most the way of its own centroid plus the longest way of another one, and the cluster adds that
to its drift. A gap is stored together with the drift at its time, so those whose gap has expired are on top of the heap;
only they are popped, compared with all centroids in whole numbers, and pushed onto the heap of their cluster.

A round reads the blocks of the round before and writes the next ones, with the sums of each block beside them, so a lost
executor costs a re-read. Centroids, drifts and ways are some kilobytes and travel with the task; sums are added by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwash.llm.common import bounded_batches
from gridwash.llm.vectors import packed, usable
from gridwash.session import frozen

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64.0
SEED = 1
BLOCK = 4_096
EXACT = 2.0 ** 52  # whole numbers below are exact in floating point
SLACK = 1e-9  # relative; bounds are computed in floating point
STATE = ("block long, dims int, ids binary, values binary, kind string, own binary, keys binary, members binary, "
         "sizes array<long>, sums array<decimal(38,0)>")


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number rows to each centroid, exact; objects where a double could not hold them."""
    most = max(np.abs(x.astype(np.float64)).max(initial=0), np.abs(centroids.astype(np.float64)).max(initial=0))
    if 4 * most * most * max(1, x.shape[1]) < EXACT:
        x, c = x.astype(np.float64), centroids.astype(np.float64)
        return (x ** 2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c ** 2).sum(axis=1)[None, :]
    c = np.array([[int(v) for v in row] for row in centroids], dtype=object)
    x = np.array([[int(v) for v in row] for row in x], dtype=object)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


class Heaps:
    """One heap of ``(gap + drift then, row)`` for each cluster of a block."""

    def __init__(self, heaps: list[list[tuple[float, int]]]):
        self.heaps = heaps

    @classmethod
    def read(cls, keys: bytes, members: bytes, sizes: list[int]) -> Heaps:
        pairs = list(zip(np.frombuffer(keys, dtype=np.float64).tolist(), np.frombuffer(members, dtype=np.int32).tolist()))
        ends = np.cumsum([0, *sizes]).tolist()
        return cls([pairs[a:b] for a, b in zip(ends, ends[1:])])  # a heap written in its order still is one

    def written(self) -> dict:
        pairs = [p for h in self.heaps for p in h]
        return {"keys": np.array([p[0] for p in pairs], dtype=np.float64).tobytes(),
                "members": np.array([p[1] for p in pairs], dtype=np.int32).tobytes(), "sizes": [len(h) for h in self.heaps]}

    def expired(self, drift: np.ndarray, slack: float) -> list[int]:
        """Pops every row whose gap no longer shows that its centroid is the nearest."""
        popped = []
        for heap, gone in zip(self.heaps, drift.tolist()):
            while heap and heap[0][0] <= gone + slack:
                popped.append(heappop(heap)[1])
        return popped


def rescan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, ties to the smaller number, and the gap to the second nearest."""
    square = squared_distances(x, centroids)
    own = np.argmin(square, axis=1) if len(x) else np.empty(0, dtype=np.int64)
    away = np.sqrt(square.astype(np.float64))
    rows = np.arange(len(x))
    nearest = away[rows, own]
    away[rows, own] = np.inf
    return own.astype(np.int64), away.min(axis=1) - nearest if len(x) else np.empty(0)


def slack_of(x: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> float:
    """More than rounding can have added to a bound."""
    most = max(np.abs(x.astype(np.float64)).max(initial=1), np.abs(centroids.astype(np.float64)).max(initial=1))
    return SLACK * (most * np.sqrt(x.shape[1]) * 4 + drift.max(initial=0))


def advance(x: np.ndarray, own: np.ndarray, heaps: Heaps, centroids: np.ndarray, drift: np.ndarray) -> int:
    """Brings the assignment of a block to the centroids given; the number of rows that were looked at."""
    popped = heaps.expired(drift, slack_of(x, centroids, drift))
    if popped:
        at = np.array(popped, dtype=np.int64)
        nearest, gap = rescan(x[at], centroids)
        own[at] = nearest
        for row, cluster, key in zip(popped, nearest.tolist(), (gap + drift[nearest]).tolist()):
            heappush(heaps.heaps[cluster], (key, row))
    return len(popped)


def first_state(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, Heaps]:
    own, gap = rescan(x, centroids)
    heaps = [[] for _ in centroids]
    for row, (cluster, key) in enumerate(zip(own.tolist(), gap.tolist())):
        heaps[cluster].append((key, row))
    for heap in heaps:
        heapify(heap)
    return own, Heaps(heaps)


def narrow(values: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest type that holds them; as doubles, which they are, where none does."""
    for kind in ("int8", "int16", "int32"):
        limits = np.iinfo(kind)
        if not values.size or (values.min() >= limits.min and values.max() <= limits.max):
            return kind, values.astype(kind).tobytes()
    return "float64", values.astype(np.float64).tobytes()


def sums_of(x: np.ndarray, own: np.ndarray, clusters: int) -> list[int]:
    """Rows and component sums of each cluster, one after the other: exact."""
    out = []
    wide = x.astype(np.int64) if x.dtype.kind == "i" else None
    for c in range(clusters):
        rows = own == c
        if wide is not None:
            total = wide[rows].sum(axis=0).tolist()
        else:
            total = [sum(int(v) for v in x[rows, j]) for j in range(x.shape[1])]
        out += [int(rows.sum()), *total]
    return out


def _rounds(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray, label: str) -> DataFrame:
    """The state of all blocks after their rows are assigned to the centroids."""
    from decimal import Decimal

    first = "own" not in rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                kind = "float64" if first else row.kind
                x = np.frombuffer(row.values, dtype=kind).reshape(-1, row.dims)
                if first:
                    kind, values = narrow(x)
                    x = np.frombuffer(values, dtype=kind).reshape(-1, row.dims)
                    own, heaps = first_state(x, centroids)
                else:
                    values, own = row.values, np.frombuffer(row.own, dtype=np.int32).astype(np.int64)
                    heaps = Heaps.read(row.keys, row.members, list(row.sizes))
                    advance(x, own, heaps, centroids, drift)
                state = {"block": row.block, "dims": row.dims, "ids": row.ids, "values": values, "kind": kind,
                         "own": own.astype(np.int32).tobytes(), **heaps.written(),
                         "sums": [Decimal(v) for v in sums_of(x, own, len(centroids))]}
                yield pd.DataFrame({k: [v] for k, v in state.items()})

    bounded_batches(rows.sparkSession, rows=16)
    return frozen(rows.mapInPandas(run, STATE), label)


def moved(centroids: np.ndarray, state: DataFrame) -> np.ndarray:
    """Every centroid that has rows at the floor of their mean; exact. Only one row per cluster and component arrives."""
    found = state.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("total")).collect()
    k, dims = centroids.shape
    totals = {r["at"]: int(r["total"]) for r in found}
    out = centroids.copy()
    for c in range(k):
        count = totals.get(c * (dims + 1), 0)
        if count:
            out[c] = [totals[c * (dims + 1) + 1 + j] // count for j in range(dims)]
    return out


def seeds(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """Vectors of the ids with the smallest SHA-256, in that order; NULL ids come last, equal ids by their vectors."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = vectors.select(drawn.alias("drawn"), "v").orderBy(F.col("drawn").asc_nulls_last(), "v").limit(clusters)
    return np.array([[int(c) for c in r["v"]] for r in first.collect()], dtype=object)


def small(values: np.ndarray) -> np.ndarray:
    """As longs where they fit."""
    return values.astype(np.int64) if values.size and max(abs(int(v)) for v in values.ravel()) < 2 ** 62 else values


def clustered(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
              dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: float = SCALE,
              seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance`` for every vector, and the final centroids.

    Components become floor(scale * component). ``distance`` is the squared distance to the vector's centroid. Vectors that
    are NULL, hold NULL or non-finite components or have another length take no part; zero vectors and repeated rows do, and
    so do NULL ids, which seed a cluster only if there are too few others. With fewer vectors than clusters each is a seed.
    A distance that a long cannot hold is an error. Other columns, whatever their names, are not read. No vectors give no rows.
    """
    whole = F.transform(F.col(f"`{vector_column}`").cast("array<double>"), lambda c: F.floor(c * scale).cast("double"))
    exact = F.transform(F.col(f"`{vector_column}`").cast("array<double>"),
                        lambda c: F.floor(c * scale).cast("decimal(38,0)"))
    fine = vectors.filter(usable(vector_column, zero=True) & (F.size(f"`{vector_column}`") == dimensions))
    id_ = F.col(f"`{id_column}`").cast("long").alias("id")
    centroids = small(seeds(fine.select(id_, exact.alias("v")), clusters, seed))
    if not len(centroids):
        return fine.select(id_, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    # NULL ids travel as a number beside a mark, as blocks hold plain numbers.
    marked = fine.select(F.coalesce(id_, F.lit(0)).alias("id"), whole.alias("v"), F.col(f"`{id_column}`").isNull().alias("none"))
    blocks = packed(marked.filter("NOT none").select("id", "v"), block).withColumn("none", F.lit(False)).unionByName(
        packed(marked.filter("none").select("id", "v"), block).withColumn("none", F.lit(True)))
    return _clustered(blocks, centroids, rounds)


def _clustered(blocks: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    # A block of NULL ids is told by a negative number.
    numbered = blocks.select(F.when(F.col("none"), -F.col("block") - 1).otherwise(F.col("block")).alias("block"), "dims", "ids",
                             "values")
    drift = np.zeros(len(centroids))
    state = _rounds(numbered, centroids, drift, "clusters-0")
    for nth in range(rounds):
        after = small(moved(centroids, state))
        way = np.sqrt(((after.astype(np.float64) - centroids.astype(np.float64)) ** 2).sum(axis=1))
        others = np.array([np.delete(way, c).max(initial=0) for c in range(len(way))])
        drift, centroids = drift + way + others, after
        state = _rounds(state, centroids, drift, f"clusters-{nth + 1}")

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x = np.frombuffer(row.values, dtype=row.kind).reshape(-1, row.dims)
                own = np.frombuffer(row.own, dtype=np.int32)
                distance = np.zeros(len(x), dtype=np.int64)
                for c in np.unique(own):
                    distance[own == c] = squared_distances(x[own == c], centroids[c:c + 1])[:, 0].astype(np.int64)
                ids = pd.Series(np.frombuffer(row.ids, dtype=np.int64), dtype="Int64")
                if row.block < 0:
                    ids[:] = pd.NA
                yield pd.DataFrame({"id": ids, "cluster": own, "distance": distance})

    return state.mapInPandas(final, "id long, cluster int, distance long"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds what the distances sum up to in each cluster and in all, and the SHA-256 of the cluster's centroid."""
    found = frozen(found, "clustered")
    spark = found.sparkSession
    per = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # one row per cluster
    whole = sum(per.values())
    rows = [(c, per.get(c, 0), whole, hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest())
            for c, row in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster")  # one row per cluster
