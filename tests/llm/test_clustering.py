"""Centroid clustering against Lloyd's rounds in plain whole numbers."""

import hashlib
import random

import numpy as np
import pytest

from gridwash.llm import clustering


def lloyd(rows, clusters, rounds, scale=64):
    kept = [(i, [int(np.floor(np.float64(c) * scale)) for c in v]) for i, v in rows
            if v is not None and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, own) in zip(kept, near) if own == k]
            if mine:
                centroids[k] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted(((str(i), k, d) for (i, _), (d, k) in zip(kept, assign()))), centroids


def vectors(kind):
    rnd = random.Random(kind)
    scale = {"plain": 1.0, "wide": 1e5, "ties": 1.0, "far": 30.0}[kind]
    rows = []
    for i in range(400):
        middle = rnd.choice([-2, 0, 2]) if kind == "far" else 0
        v = [rnd.choice([0.0, 1.0, -1.0]) if kind == "ties" else (middle + rnd.gauss(0, 1)) * scale for _ in range(4)]
        rows.append((i * 7 - 50, v))
    return rows + [(3, [0.0] * 4), (3, [0.0] * 4), (3, [1.0] * 4), (None, [0.5] * 4), (None, [0.25] * 4), (900, None), (901, []),
                   (902, [1.0, None, 0.0, 0.0]), (903, [1.0, float("nan"), 0.0, 0.0]), (904, [float("inf")] * 4), (905, [1.0] * 5)]


@pytest.mark.parametrize("kind", ["plain", "wide", "ties", "far"])
def test_clusters_are_those_of_plain_rounds(spark, kind):
    rows = vectors(kind)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    found, centroids = clustering.clustered(frame, dimensions=4, clusters=7, rounds=5, block=50)
    wanted, middle = lloyd(rows, 7, 5)
    assert sorted((str(r.id), r.cluster, r.distance) for r in found.collect()) == wanted
    assert centroids.tolist() == middle
    whole = clustering.with_inertia(found, centroids).collect()
    assert {r.inertia for r in whole} == {sum(d for _, _, d in wanted)}
    assert all(r.cluster_inertia == sum(d for _, k, d in wanted if k == r.cluster) for r in whole)


def test_few_none_and_huge(spark):
    schema = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], schema)
    found, centroids = clustering.clustered(few, dimensions=2)
    assert sorted(r.distance for r in found.collect()) == [0, 0] and len(centroids) == 2
    found, centroids = clustering.clustered(few.limit(0), dimensions=2)
    assert clustering.with_inertia(found, centroids).collect() == []
    big = [(i, [float(2 ** 29) * i, 1.0]) for i in range(1, 9)]  # products beyond what a double holds
    found, _ = clustering.clustered(spark.createDataFrame(big, schema), dimensions=2, clusters=2, scale=1.0, rounds=2)
    assert all(isinstance(r.distance, int) for r in found.collect())


def test_bounds_spare_most_rows():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-20, 20, (500, 4)) + 1000 * k for k in range(4)])
    centroids = np.array([[1000 * k] * 4 for k in range(4)])
    own, heaps = clustering.first_state(x, centroids)
    moved = centroids + 3
    drift = np.full(4, 2 * np.sqrt(4 * 9))
    looked = clustering.advance(x, own, heaps, moved, drift)
    assert looked == 0 and (own == np.repeat(np.arange(4), 500)).all()
    far = centroids[::-1].copy()
    way = np.sqrt(((far - moved) ** 2).sum(axis=1))
    drift = drift + way + way.max()
    assert clustering.advance(x, own, heaps, far, drift) == 2000
    assert (own == np.repeat(np.arange(4)[::-1], 500)).all()
    state = heaps.written()
    again = clustering.Heaps.read(state["keys"], state["members"], state["sizes"])
    assert again.heaps == heaps.heaps and sum(state["sizes"]) == 2000
