"""Clustering by pivots against a plain loop over all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from haulmark.llm.centroids import LEAST_MARGIN, cluster, nearest, pivot_distances, spread_out

SCHEMA = "vec_id long, embedding array<float>, cluster string, inertia double"


def brute_force(rows, dims, count, rounds):
    kept = []
    for key, vector, *_ in rows:
        if vector is not None and len(vector) == dims and all(x is not None and math.isfinite(x) and abs(x) < 131072 for x in vector):
            kept.append((key, [math.floor(1024 * float(np.float32(x))) for x in vector]))
    begin = sorted((hashlib.sha256(f"3:{k}".encode()).hexdigest(), v) for k, v in kept if k is not None)[:count]
    centroids = [v for _, v in begin]
    if not centroids:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        owners = [i for _, i in assign()]
        for c in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, owners) if o == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    last = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(k), i, d, sum(x for x, j in last if j == i), sum(x for x, _ in last), digest[i]) for (k, _), (d, i) in zip(kept, last))


def result(spark, rows, dims, **how):
    found = cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), dims, **how).collect()
    return sorted((str(r.vec_id), r["cluster"], r.distance, r.cluster_inertia, r["inertia"], r.centroid_sha256) for r in found)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_distances(spark, seed):
    dice = random.Random(seed)
    spots = [[dice.uniform(-2, 2) for _ in range(4)] for _ in range(5)]
    rows = [(i, [x + dice.gauss(0, 0.1 * seed) for x in dice.choice(spots)], "x", 1.0) for i in range(120)]
    rows += rows[:10] + [(None, spots[0], "x", 1.0)] * 4  # repeated rows, rows without a key
    rows += [(200, None, "x", 1.0), (201, [1.0], "x", 1.0), (202, [], "x", 1.0), (203, [None, 1.0, 1.0, 1.0], "x", 1.0), (204, [float("nan")] * 4, "x", 1.0),
             (205, [1.0, float("inf"), 1.0, 1.0], "x", 1.0), (206, [200000.0, 0.0, 0.0, 0.0], "x", 1.0), (207, [131071.0, -131071.0, 0.0, 0.5], None, None)]
    assert result(spark, rows, 4, rounds=4) == brute_force(rows, 4, 8, 4)


def test_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 2), 0.0], "x", 1.0) for i in range(5)]
    assert result(spark, rows, 2, rounds=3) == brute_force(rows, 2, 8, 3)
    same = [(i, [1.0, 2.0], "x", 1.0) for i in range(30)]
    assert result(spark, same, 2, rounds=2) == brute_force(same, 2, 8, 2)
    assert result(spark, rows[:1], 2, rounds=1) == brute_force(rows[:1], 2, 8, 1)


def test_nothing_to_cluster(spark):
    none = cluster(spark.createDataFrame([], SCHEMA), 2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert result(spark, [(1, [1.0], "x", 1.0), (None, [1.0, 1.0], "x", 1.0)], 2) == []


def test_bounds_spare_distances_and_lose_none():
    dice = np.random.default_rng(1)
    centroids = dice.integers(-40_000, 40_000, (8, 16))
    vectors = (centroids[dice.integers(0, 8, 5_000)] + dice.integers(-500, 500, (5_000, 16))).astype(np.int64)
    pivots = spread_out(vectors[:256], 8)
    owner, best, made = nearest(vectors, pivot_distances(vectors, pivots), centroids, pivots)
    every = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (owner == every.argmin(1)).all() and (best == every.min(1)).all()
    assert made < 2 * len(vectors)  # of eight for each


def test_large_components_are_exact():
    far = np.array([[2**27 - 1] * 64, [-(2**27)] * 64, [0] * 64], np.int64)
    owner, best, _ = nearest(far, pivot_distances(far, far[:1]), far[1:2], far[:1])
    assert best.tolist() == [sum((a - b) ** 2 for a, b in zip(v, [-(2**27)] * 64)) for v in far.tolist()]
    assert LEAST_MARGIN > 0 and owner.tolist() == [0, 0, 0]
