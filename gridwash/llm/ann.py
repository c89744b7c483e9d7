"""Approximate nearest neighbours with robust-pruned directed graphs, one per shard.

Every vector is indexed: rows are packed into shards of bounded size where they are, and each shard gets a graph. Vectors
enter in batches that double in size; a greedy search of the graph so far proposes neighbours, and relaxed distance pruning
keeps those that no kept neighbour is much closer to, so edges stay few and go in all directions. Edges also run back, and
a node with too many is pruned again. Shards and graphs are a table in the shared folder, so a lost executor costs one shard.

Queries go to every shard in blocks and run a beam search; the best of all shards are kept per query, with distances
computed in double precision from the original vectors. Equal vectors of a shard are one node that lists its ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwash.llm.common import bounded_batches
from gridwash.llm.vectors import QUERY_BLOCK, meet, packed, ranked, unpacked, usable
from gridwash.session import frozen

SHARD = 4_096  # vectors
DEGREE = 32
BEAM = 64
RELAXED = 1.2  # a neighbour is dropped if a kept one is this much closer to it than the node is
AT_ONCE = 4  # nodes that a search opens in one step
BATCH = 256


def squared(nodes: np.ndarray, norms: np.ndarray, which: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances (b, c) of queries (b, d) to the nodes ``which`` (b, c)."""
    return np.maximum(norms[which] - 2 * np.einsum("bcd,bd->bc", nodes[which], q) + (q ** 2).sum(axis=1)[:, None], 0)


def beam_search(nodes: np.ndarray, norms: np.ndarray, edges: np.ndarray, q: np.ndarray, beam: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """Nearest nodes found for each query from node 0: ids (b, beam), -1 where none, and squared distances."""
    b = len(q)
    ids = np.full((b, beam), -1, dtype=np.int64)
    dist = np.full((b, beam), np.inf)
    opened = np.zeros((b, beam), dtype=bool)
    seen = np.zeros((b, len(nodes)), dtype=bool)
    ids[:, 0], seen[:, 0] = 0, True
    dist[:, 0] = squared(nodes, norms, ids[:, :1], q)[:, 0]
    rows = np.arange(b)
    while len(rows):
        open_dist = np.where(opened[rows], np.inf, dist[rows])
        take = np.argsort(open_dist, axis=1, kind="stable")[:, :AT_ONCE]
        usable_ = np.isfinite(np.take_along_axis(open_dist, take, axis=1))
        going = usable_[:, 0]
        rows, take, usable_ = rows[going], take[going], usable_[going]
        if not len(rows):
            break
        opened[rows[:, None], take] |= usable_
        chosen = np.where(usable_, ids[rows[:, None], take], 0)
        near = np.where(usable_[:, :, None], edges[chosen], -1).reshape(len(rows), -1)
        fresh = (near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)]
        near = np.where(fresh, near, 0)
        # The same node may come from two opened ones: the later copies go.
        order = np.argsort(np.where(fresh, near, len(nodes)), axis=1, kind="stable")
        near, fresh = np.take_along_axis(near, order, axis=1), np.take_along_axis(fresh, order, axis=1)
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        i, j = np.nonzero(fresh)
        seen[rows[i], near[i, j]] = True
        new = np.where(fresh, squared(nodes, norms, near, q[rows]), np.inf)
        all_dist = np.concatenate([dist[rows], new], axis=1)
        all_ids = np.concatenate([ids[rows], np.where(fresh, near, -1)], axis=1)
        all_opened = np.concatenate([opened[rows], np.zeros_like(fresh)], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        dist[rows] = np.take_along_axis(all_dist, best, axis=1)
        ids[rows] = np.where(np.isfinite(dist[rows]), np.take_along_axis(all_ids, best, axis=1), -1)
        opened[rows] = np.take_along_axis(all_opened, best, axis=1)
    return ids, dist


def robust_prune(nodes: np.ndarray, norms: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int,
                 relaxed: float) -> np.ndarray:
    """Edges (b, degree) of nodes ``points`` from candidates (b, c), -1 where there is none."""
    dist = squared(nodes, norms, np.maximum(candidates, 0), nodes[points])
    dist[(candidates < 0) | (candidates == points[:, None])] = np.inf
    order = np.argsort(dist, axis=1, kind="stable")
    candidates, dist = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(dist, order, axis=1)
    same = np.zeros_like(dist, dtype=bool)  # repeated candidates stand side by side, being as far
    same[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    dist[same] = np.inf
    safe = np.maximum(candidates, 0)
    x = nodes[safe]
    between = norms[safe][:, :, None] + norms[safe][:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    alive = np.isfinite(dist)
    out = np.full((len(points), degree), -1, dtype=np.int64)
    rows = np.arange(len(points))
    for slot in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = np.argmax(alive, axis=1)
        out[some, slot] = candidates[rows, first][some]
        alive[rows, first] = False
        alive &= relaxed * relaxed * between[rows, first] > dist
    return out


def build(nodes: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relaxed: float = RELAXED) -> np.ndarray:
    """Edges (n, degree) of a graph over distinct vectors, searched from node 0; -1 where there is none."""
    n = len(nodes)
    norms = (nodes ** 2).sum(axis=1)
    edges = np.full((n, degree), -1, dtype=np.int64)
    start = min(n, degree + 1)
    for i in range(start):
        edges[i, :start - 1] = [j for j in range(start) if j != i]
    done = start
    while done < n:
        new = np.arange(done, min(n, done + min(BATCH, done)))
        found, _ = beam_search(nodes[:done], norms[:done], edges[:done], nodes[new], beam)
        edges[new] = robust_prune(nodes, norms, new, found, degree, relaxed)
        source = np.repeat(new, degree)[edges[new].ravel() >= 0]
        target = edges[new].ravel()[edges[new].ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, first, counts = np.unique(target, return_index=True, return_counts=True)
        for most in np.unique(np.minimum(1 << np.ceil(np.log2(counts)).astype(int), BATCH * 2)):
            group = (counts <= most) & (counts > most // 2)
            for low in range(0, int(group.sum()), 128):  # few at once, as a hub may have many
                some = np.flatnonzero(group)[low:low + 128]
                width = int(counts[some].max())
                back = np.full((len(some), width), -1, dtype=np.int64)
                for k, g in enumerate(some):
                    back[k, :counts[g]] = source[first[g]:first[g] + counts[g]]
                both = np.concatenate([edges[touched[some]], back], axis=1)
                full = (both >= 0).sum(axis=1) > degree
                packed_left = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :degree]
                edges[touched[some]] = packed_left
                if full.any():
                    at = touched[some][full]
                    edges[at] = robust_prune(nodes, norms, at, both[full], degree, relaxed)
        done = int(new[-1]) + 1
    return edges


class Frame:
    """Coordinates of a shard for its graph: centred on its mean and scaled to at most 1 in double precision, then single.

    Distances keep their order, whatever the place and size of the vectors. Scores are computed on the original ones.
    """

    def __init__(self, nodes: np.ndarray):
        self.unit = np.abs(nodes).max(initial=0) or 1.0
        self.centre = (nodes / self.unit).mean(axis=0)
        self.spread = np.abs(nodes / self.unit - self.centre).max(initial=0) or 1.0

    def of(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            inside = (vectors / self.unit - self.centre) / self.spread
        return np.clip(inside, -1e15, 1e15).astype(np.float32)  # a query may lie far outside


def index(vectors: DataFrame, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, relaxed: float = RELAXED
          ) -> DataFrame:
    """Shards of ``id, v`` with their graphs: ``block, dims, ids, values, starts, edges``.

    Nodes are the distinct vectors of the shard, the one nearest to their mean first; ids are listed by node, and
    ``starts`` says where the list of each node begins.
    """
    shards = frozen(packed(vectors, shard), "shards")

    def connect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, values = unpacked(row.dims, row.ids, row.values)
                nodes, owner = np.unique(values, axis=0, return_inverse=True)
                owner = owner.ravel()
                # A fixed shuffle, as sorted vectors would enter the graph cluster by cluster.
                order = np.random.default_rng(0).permutation(len(nodes))
                centre = int(np.argmin(((nodes - nodes.mean(axis=0)) ** 2).sum(axis=1)))
                order = np.concatenate([[centre], order[order != centre]])
                place = np.empty(len(order), dtype=np.int64)
                place[order] = np.arange(len(order))
                by_node = np.lexsort((ids, place[owner]))
                starts = np.searchsorted(place[owner][by_node], np.arange(len(order) + 1))
                edges = build(Frame(nodes).of(nodes[order]), degree, beam, relaxed)
                yield pd.DataFrame({"block": [row.block], "dims": [row.dims], "ids": [ids[by_node].tobytes()],
                                    "values": [nodes[order].tobytes()], "starts": [starts.astype(np.int64).tobytes()],
                                    "edges": [edges.astype(np.int32).tobytes()]})

    bounded_batches(vectors.sparkSession, rows=16)
    spread = shards.repartition("block")  # building is the work here, so shards are dealt to all tasks
    return frozen(spread.mapInPandas(connect, "block long, dims int, ids binary, values binary, starts binary, edges binary"),
                  "graphs")


def search(queries: DataFrame, graphs: DataFrame, k: int, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found in all shards for queries of ``id, v``."""
    blocks = frozen(packed(queries, QUERY_BLOCK), "query-blocks")

    def compare(row: dict):
        query_ids, q = unpacked(row["q_dims"], row["q_ids"], row["q_values"])
        nodes = np.frombuffer(row["values"], dtype=np.float64).reshape(-1, row["dims"])
        ids, starts = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["starts"], dtype=np.int64)
        edges = np.frombuffer(row["edges"], dtype=np.int32).reshape(len(nodes), degree).astype(np.int64)
        frame = Frame(nodes)
        small = frame.of(nodes)
        found, _ = beam_search(small, (small ** 2).sum(axis=1), edges, frame.of(q), max(beam, k + 1))
        at, slot = np.nonzero(found >= 0)
        node = found[at, slot]
        exact = np.sqrt(((q[at] - nodes[node]) ** 2).sum(axis=1))
        # A node stands for all ids of its vector, the smallest first; more than k + 1 of them cannot be among the k best.
        many = np.minimum(starts[node + 1] - starts[node], k + 1)
        query = np.repeat(query_ids[at], many)
        vec = ids[np.repeat(starts[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        score = np.repeat(exact, many)
        own = np.repeat(at, many)
        other = query != vec
        query, vec, score, own = query[other], vec[other], score[other], own[other]
        order = np.lexsort((vec, score, own))
        query, vec, score, own = query[order], vec[order], score[order], own[order]
        keep = np.arange(len(own)) - np.searchsorted(own, own) < k
        return query[keep], vec[keep], score[keep]

    compare.score_type = "double"
    return ranked(meet(blocks, graphs, compare), k, F.col("score").asc())


def nearest(vectors: DataFrame, is_query, k: int, id_column: str = "vec_id", vector_column: str = "embedding",
            shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` its ``k`` nearest other rows by Euclidean distance.

    Ties go to the smaller id; fewer candidates give fewer rows. Vectors that are NULL, empty or zero, hold NULL or
    non-finite components or have no id take no part; vectors of different lengths do not meet. Rows with the query's id
    are its own. Vectors may lie anywhere and be of any size whose squares a double holds. Other columns, whatever their names,
    are not read. Each query visits every shard, so the work grows with queries times shards.
    """
    fine = vectors.filter(usable(vector_column, zero=False) & F.col(f"`{id_column}`").isNotNull()).select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asked"))
    graphs = index(fine.select("id", "v"), shard, degree, beam)
    return search(fine.filter("asked").select("id", "v"), graphs, k, degree, beam)
