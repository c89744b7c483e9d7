"""Exact search for the highest inner products of whole-number vectors by multi-resolution segment statistics.

The squared distance of two vectors is at least what their segments' means and deviations say: for a segment of n
components, n (difference of means)^2 + (difference of deviations)^2, where a deviation is the length of what is left when
the mean is taken off. With the lengths of the vectors a lower bound of the distance is an upper bound of the inner product
(|q|^2 + |x|^2 - d^2) / 2. Few long segments are tried first, more and shorter ones for what they leave, and only
survivors of all levels are multiplied out.

Queries are a stated set; they meet the vectors in blocks, and a pair of blocks gives the k best rows per query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwash.llm.vectors import QUERY_BLOCK, meet, packed, ranked, unpacked, usable
from gridwash.session import frozen

BLOCK = 2_048
LEVELS = (4, 16)  # segments, coarse to fine
EXACT = 2.0 ** 52  # whole numbers below are exact in floating point
PAIRS = 65_536  # pairs that are multiplied out at once
SLACK = 1e-9  # relative; bounds are computed in floating point


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means, scaled by the root of the segment's length, and deviations of each segment: inner products of these bound
    inner products of the vectors from above, which is the distance bound in another form."""
    borders = [vectors.shape[1] * i // segments for i in range(segments + 1)]
    out = []
    for a, b in zip(borders, borders[1:]):
        if a < b:
            part = vectors[:, a:b]
            mean = part.mean(axis=1)
            out += [mean * np.sqrt(b - a), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1)


def products(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of chosen pairs of rows, a slice of pairs at a time."""
    slices = [slice(a, a + PAIRS) for a in range(0, len(rows), PAIRS)]
    return np.concatenate([np.empty(0), *[np.einsum("ij,ij->i", q[rows[s]], x[columns[s]]) for s in slices]])


def exact_products(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The same for whole numbers of any size; an error where a long cannot hold a product."""
    limit = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if limit < EXACT:
        return products(q, x, rows, columns).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(q[i], x[j])) for i, j in zip(rows, columns)], dtype=np.int64)


def best_of_block(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int,
                  levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best candidates of each query in one block: query ids, vector ids, scores."""
    norms = np.sqrt((q ** 2).sum(axis=1))[:, None] * np.sqrt((x ** 2).sum(axis=1))[None, :]
    bound = statistics(q, levels[0]) @ statistics(x, levels[0]).T + SLACK * norms
    bound[query_ids[:, None] == ids[None, :]] = -np.inf
    # The k candidates with the highest bounds give a first score to beat.
    few = min(k, len(ids))
    first = np.argpartition(-bound, few - 1, axis=1)[:, :few]
    at = np.repeat(np.arange(len(q)), few)
    score = exact_products(q, x, at, first.ravel()).astype(np.float64)
    score[~np.isfinite(bound[at, first.ravel()])] = -np.inf
    beat = score.reshape(len(q), few).min(axis=1) if few == k else np.full(len(q), -np.inf)
    rows, columns = np.nonzero((bound >= beat[:, None]) & np.isfinite(bound))
    for segments in levels[1:]:
        fine_q, fine_x = statistics(q, segments), statistics(x, segments)
        finer = products(fine_q, fine_x, rows, columns) + SLACK * norms[rows, columns]
        keep = finer >= beat[rows]
        rows, columns = rows[keep], columns[keep]
    score = exact_products(q, x, rows, columns)
    order = np.lexsort((ids[columns], -score, rows))
    rows, columns, score = rows[order], columns[order], score[order]
    starts = np.searchsorted(rows, np.arange(len(q)))
    keep = np.arange(len(rows)) - starts[rows] < k
    return query_ids[rows[keep]], ids[columns[keep]], score[keep]


def top_k(vectors: DataFrame, is_query, k: int, id_column: str = "vec_id", vector_column: str = "embedding",
          scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the exact ``k`` highest inner products of floor(scale * component) vectors.

    Queries are the rows for which ``is_query`` holds; every other row is a candidate (all rows with the query's id are
    its own). Ties go to the smaller id; fewer candidates give fewer rows. Vectors that are NULL or empty, hold NULL or
    non-finite components or have no id take no part; vectors of different lengths do not meet. Other columns, whatever
    their names, are not read. A score that a long cannot hold is an error.
    """
    whole = F.transform(F.col(f"`{vector_column}`").cast("array<double>"), lambda c: F.floor(c * scale).cast("double"))
    fine = vectors.filter(usable(vector_column, zero=True)).withColumns({
        "id": F.col(f"`{id_column}`").cast("long"), "asked": F.coalesce(is_query, F.lit(False)), "v": whole})
    rows = fine.filter("id IS NOT NULL").select("id", "v", "asked")
    blocks = frozen(packed(rows.select("id", "v"), block), "vector-blocks")
    queries = frozen(packed(rows.filter("asked").select("id", "v"), QUERY_BLOCK), "query-blocks")

    def compare(row: dict):
        query_ids, q = unpacked(row["q_dims"], row["q_ids"], row["q_values"])
        ids, x = unpacked(row["dims"], row["ids"], row["values"])
        return best_of_block(query_ids, q, ids, x, k)

    compare.score_type = "long"
    return ranked(meet(queries, blocks, compare), k, F.col("score").desc())
