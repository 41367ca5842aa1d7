import hashlib
import math
import random

import numpy as np
import pytest

from shelfwise.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, parts string, cluster int"


def plain(rows, k, rounds, size):
    """Brute force: vectors as lists of integers, all distances."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(k)}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), names[c]) for i, c, d in found), key=str)


def spark_rows(spark, rows, k=8, rounds=10, size=6):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    found = clustering.cluster(frame, k=k, rounds=rounds, size=size)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_matches_brute_force_with_ties_and_odd_rows(spark):
    random.seed(4)
    rows = [(i, [random.randint(-3, 3) / 1024 for _ in range(6)]) for i in range(150)]  # small integers: many equal distances
    rows += [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(150, 250)]
    rows += [(7, rows[7][1]), (7, [0.0] * 6), (None, [0.5] * 6), (300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 5 + [None]), (304, [float("nan")] + [0.0] * 5), (305, [float("-inf")] * 6)]
    assert spark_rows(spark, rows) == plain(rows, 8, 10, 6)


def test_fewer_vectors_than_centroids_equal_ones_and_none(spark):
    rows = [(1, [0.1] * 6), (2, [0.1] * 6), (3, [-0.7] * 6)]
    assert spark_rows(spark, rows) == plain(rows, 8, 10, 6)
    same = [(i, [0.25] * 6) for i in range(40)]
    found = spark_rows(spark, same)
    assert found == plain(same, 8, 10, 6) and {r[1] for r in found} == {0}
    assert spark_rows(spark, []) == []
    assert spark_rows(spark, [(1, None)]) == []


def test_very_large_components_are_refused(spark):
    with pytest.raises(Exception, match="components must be under"):
        spark_rows(spark, [(1, [1e9] * 6)])


def test_search_measures_few_distances():
    rng = np.random.default_rng(1)
    middles = rng.integers(-5000, 5000, size=(64, 8))
    vectors = middles[rng.integers(0, 64, 3000)] + rng.integers(-40, 40, size=(3000, 8))
    at, distance, measured = clustering.Orchard(middles).nearest(vectors)
    full = ((vectors[:, None] - middles) ** 2).sum(axis=2)
    assert (at == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert measured < 3000 * 64 / 8  # of all distances
