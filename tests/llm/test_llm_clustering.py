"""Clustering against brute force; the bounds against sampled spheres."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from photarium.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, k, rounds, seed=2, dimensions=4, scale=256):
    """(vec_id, cluster, distance) and centroids in whole-number Python."""
    kept = [
        (i, tuple(math.floor(scale * float(v)) for v in e)) for i, e, _ in vectors
        if e is not None and len(e) == dimensions and all(v is not None and math.isfinite(v) for v in e)
    ]
    drawn = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    centers = [x for _, x in drawn[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for j, members in groups.items():
            centers[j] = tuple(sum(m[d] for m in members) // len(members) for d in range(dimensions))
    return Counter((i, *reversed(nearest(x))) for i, x in kept), centers


def found_of(spark, vectors, k, rounds, dimensions=4):
    df = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    assigned, centers, _ = clustering.cluster(df, "vec_id", k=k, rounds=rounds, dimensions=dimensions)
    rows = assigned.select(F.col("row.vec_id"), "cluster", "distance").collect()
    return Counter(tuple(r) for r in rows), [tuple(c) for c in centers.tolist()]


def normal(n, seed, spread=1.0, groups=6):
    rng = random.Random(seed)
    middles = [[rng.uniform(-3, 3) for _ in range(4)] for _ in range(groups)]
    return [(i, [float(np.float32(m + rng.gauss(0, spread))) for m in middles[i % groups]], 0) for i in range(n)]


@pytest.mark.parametrize("seed, spread, k, rounds", [(1, 0.1, 6, 5), (2, 1.0, 9, 4), (3, 0.5, 1, 2), (4, 0.02, 12, 6)])
def test_equals_brute_force(spark, seed, spread, k, rounds):
    vectors = normal(400, seed, spread)
    assert found_of(spark, vectors, k, rounds) == brute(vectors, k, rounds)


def test_odd_rows(spark):
    vectors = normal(60, 5) + [
        (100, None, 0), (101, [1.0], 0), (102, [1.0, 2.0, 3.0, None], 0), (103, [1.0, 2.0, 3.0, float("nan")], 0),
        (104, [1.0, float("inf"), 3.0, 4.0], 0), (None, [0.5, 0.5, 0.5, 0.5], None), (None, [0.25, 0.5, 0.5, 0.5], None),
        (105, [], 0), (106, [0.0, 0.0, 0.0, 0.0, 0.0], 0), (7, normal(60, 5)[7][1], 0),
    ] + [(200 + i, [1.0, -1.0, 1.0, -1.0], 0) for i in range(40)]
    assert found_of(spark, vectors, 8, 4) == brute(vectors, 8, 4)


def test_ties_go_to_the_smaller_number(spark):
    """Equal vectors under different ids start as equal centroids; all but the first stay empty and in place."""
    vectors = [(i, [1.0, 1.0, 1.0, 1.0], 0) for i in range(10)] + [(20 + i, [float(i), 0.0, 0.0, 0.0], 0) for i in range(6)]
    assert found_of(spark, vectors, 12, 3) == brute(vectors, 12, 3)


def test_fewer_vectors_than_clusters_and_none(spark):
    vectors = normal(3, 1)
    assert found_of(spark, vectors, 10, 2) == brute(vectors, 10, 2)
    assert found_of(spark, [(1, None, 0)], 10, 2) == (Counter(), [])
    assert found_of(spark, [], 10, 2) == (Counter(), [])


def test_large_components_stay_exact(spark):
    rng = random.Random(8)
    vectors = [(i, [float(np.float32(rng.uniform(-500_000, 500_000))) for _ in range(4)], 0) for i in range(80)]
    assert found_of(spark, vectors, 7, 3) == brute(vectors, 7, 3)
    with pytest.raises(Exception, match="a component beyond"):
        found_of(spark, [(1, [1e9, 0.0, 0.0, 0.0], 0)], 2, 1)


def test_digest_of_64_components(spark):
    rng = random.Random(3)
    vectors = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(64)], 0) for i in range(120)]
    rows, centers = brute(vectors, 40, 5, dimensions=64)
    found = clustering.digest(spark.createDataFrame(vectors, SCHEMA)).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in found) == rows
    sums = Counter()
    for (_, c, d), n in rows.items():
        sums[c] += d * n
    for r in found:
        assert r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centers[r["cluster"]])).encode()).hexdigest()


def test_clashing_columns(spark):
    df = spark.createDataFrame(normal(30, 2), SCHEMA).withColumns({n: F.lit(n) for n in ("row", "x", "cluster", "distance", "bound", "draw")})
    assigned, _, _ = clustering.cluster(df, "vec_id", k=3, rounds=2, dimensions=4)
    assert {r["row"]["bound"] for r in assigned.collect()} == {"bound"} and assigned.count() == 30


@pytest.mark.parametrize("seed", range(20))
def test_no_place_of_a_sphere_is_nearer_than_the_bound_says(seed):
    """``nearing`` against sampled places on and in the spheres, and it loosens less than full drift."""
    rng = np.random.default_rng(seed)
    old = rng.normal(0, 400, (5, 6)).round().astype(np.int64)
    new = old + rng.normal(0, 40, (5, 6)).round().astype(np.int64)
    radius = rng.uniform(0, 300, 5)
    loosened = clustering.nearing(old, new, radius)
    drift = np.sqrt(((new - old) ** 2).sum(1))
    for a in range(5):
        others = [j for j in range(5) if j != a]
        way = rng.normal(size=(4_000, 6))
        way /= np.linalg.norm(way, axis=1, keepdims=True)
        # Towards and away from the other centres, besides random directions.
        way = np.concatenate([way, *[s * (new[j] - old[j])[None] / max(drift[j], 1) for j in others for s in (1, -1)]])
        places = old[a] + way * radius[a] * np.append(rng.uniform(0, 1, 2_000), np.ones(len(way) - 2_000))[:, None]
        most = max(
            (np.linalg.norm(places - old[j], axis=1) - np.linalg.norm(places - new[j], axis=1)).max() for j in others
        )
        assert most <= loosened[a] <= drift[others].max() * (1 + 1e-5) + 1e-3


def test_bounds_spare_most_scans():
    """On clustered vectors few are ambiguous, and fewer than with full drift."""
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 300, (12, 16))
    x = np.round(middles[rng.integers(0, 12, 6_000)] + rng.normal(0, 40, (6_000, 16))).astype(np.int64)
    centers = x[rng.choice(len(x), 12, replace=False)]
    own, best, bound = clustering.scan(x, centers)
    full = bound.copy()
    scanned = spared_by_full = 0
    for _ in range(5):
        radius = np.zeros(len(centers))
        np.maximum.at(radius, own, np.sqrt(best))
        moved = np.array([x[own == j].sum(0) // max((own == j).sum(), 1) if (own == j).any() else c for j, c in enumerate(centers)])
        loosened, least = clustering.nearing(centers, moved, radius), clustering.half_way(moved)
        drift = np.sqrt(((moved - centers) ** 2).sum(1))
        full_drift = np.array([np.delete(drift, j).max() for j in range(len(drift))])
        bound, full, centers = bound - loosened[own], full - full_drift[own], moved
        best = clustering.squared_to_own(x, centers[own])
        ambiguous = np.sqrt(best) >= np.maximum(bound, least[own])
        spared_by_full += int((np.sqrt(best) >= np.maximum(full, least[own])).sum())
        scanned += int(ambiguous.sum())
        new_own, new_best, new_bound = clustering.scan(x, centers)
        assert (new_own == own)[~ambiguous].all()
        own, best = new_own, new_best
        bound = np.where(ambiguous, new_bound, bound)
        full = np.where(np.sqrt(best) >= np.maximum(full, least[own]), new_bound, full)
    assert scanned < 0.5 * 5 * len(x) and scanned <= spared_by_full
