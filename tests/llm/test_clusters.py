import hashlib
import math
import random

import numpy as np
import pytest

from quirebook.llm import clusters


def brute(rows, k=8, rounds=10, width=64, scale=1024, seed=3):
    """Lloyd's algorithm on Python's whole numbers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for i in range(rounds + 1):
        near = [min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c)) for _, v in kept]
        if i < rounds:
            for c in range(len(centroids)):
                if own := [v for (_, v), n in zip(kept, near) if n == c]:
                    centroids[c] = [sum(column) // len(own) for column in zip(*own)]
    return sorted(((i, c, away(v, centroids[c])) for (i, v), c in zip(kept, near)), key=str), centroids


def run(spark, rows, **more):
    got, centroids = clusters.kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **more)
    return sorted((tuple(r) for r in got.collect()), key=str), centroids.tolist()


def test_ties_copies_and_rows_left_out(spark):
    random.seed(5)
    # a coarse grid, so that many vectors lie as far from two centroids
    rows = [(i, [random.choice((-0.5, 0.0, 0.25, 0.5)) for _ in range(3)]) for i in range(400)]
    rows += [(7, [0.25, 0.25, 0.25])] * 150 + [(None, [0.5, 0.5, 0.0]), (None, None), (1, None), (2, [1.0, 2.0]), (3, [1.0, None, 2.0]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [])]
    random.shuffle(rows)
    got, centroids = run(spark, rows, width=3, rounds=6)
    assert (got, centroids) == brute(rows, width=3, rounds=6)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [2.0, 1.0])]
    assert run(spark, rows, width=2) == brute(rows, width=2)
    assert run(spark, [(1, [0.0])], width=2) == ([], [])
    assert clusters.query(spark, "/root/testdata/sf0.001").limit(0).count() == 0


def test_too_large_components_are_told(spark):
    with pytest.raises(OverflowError):
        run(spark, [(1, [3e8, 0.0]), (2, [0.0, 0.0])], width=2)


def test_bounds_leave_out_distances_and_lose_no_assignment():
    """Exponion against all distances, round by round, on whole numbers with many ties."""
    rng = np.random.default_rng(1)
    saved = 0
    for spread in (3, 50, 100_000):
        hubs = rng.integers(-spread, spread, (6, 4)) * 5
        vectors = hubs[rng.integers(0, 6, 3000)] + rng.integers(-spread, spread, (3000, 4))
        centroids = vectors[:10].copy()
        near = clusters.Centroids(centroids)
        state = near.assign(vectors, np.zeros(3000, np.int16), np.full(3000, np.inf), np.zeros(3000))
        for _ in range(8):
            all_squared = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
            assert (state[0] == all_squared.argmin(1)).all()
            after = np.array([vectors[state[0] == c].sum(0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else centroids[c] for c in range(10)])
            moved = np.sqrt(((after - centroids).astype(float) ** 2).sum(1)) * (1 + clusters.SLACK)
            others = np.array([np.delete(moved, i).max() for i in range(10)])
            cluster, upper, lower, _ = state
            centroids = after
            state = clusters.Centroids(after).assign(vectors, cluster, upper + moved[cluster], lower - others[cluster])
            saved += 1 - state[3] / (9 * 3000)
    assert saved / 24 > 0.5  # more than half of all distances to other centroids weren't worked out
