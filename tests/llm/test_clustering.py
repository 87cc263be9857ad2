"""Elkan's bounds against plain k-means, ties included; rows that are left out; equal rows and few rows."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from quarry.llm import clustering


def plain(rows, clusters=16, rounds=3, dimensions=64, scale=64):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and abs(scale * x) <= clustering.LARGEST for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    for r in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for _, v in kept]
        if r == rounds:
            break
        for k in range(len(centroids)):
            own = [v for (_, v), (_, at) in zip(kept, best, strict=True) if at == k]
            if own:
                centroids[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    inertia = Counter()
    for d, k in best:
        inertia[k] += d
    return Counter((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, best, strict=True))


def got(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, i, 0) for i, v in rows], "vec_id long, embedding array<float>, cluster long, distance int")
    return Counter(tuple(r) for r in clustering.with_inertia(*clustering.fitted(frame, **options)).collect())


def test_edges(spark):
    rng = np.random.default_rng(3)
    vector = lambda: [float(np.float32(x)) for x in rng.normal(0, 0.2, 64)]
    rows = [(i, vector()) for i in range(120)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (2, vector()), (None, vector()), (200, None), (201, []), (202, vector()[:63]), (203, [*vector(), 0.0])]
    rows += [(204 + n, [x, *vector()[1:]]) for n, x in enumerate((None, float("nan"), float("inf"), float("-inf"), 3e38, -3e38, -2.0**21, 0.0))]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_ties(spark, seed):
    """Components of few values: many vectors are as near to several centroids."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) / 64 for x in rng.integers(0, 2, 4)]) for i in range(60)]
    assert got(spark, rows, dimensions=4, clusters=7) == plain(rows, dimensions=4, clusters=7)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    rows = [(i, [i / 8.0] * 64) for i in range(n)]
    assert got(spark, rows) == plain(rows)


def test_bounds_skip_and_stay_exact():
    """Over rounds on clustered vectors most distances are not computed, and no nearest centroid is missed."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-60, 60, (16, 64))
    x = (centres[rng.integers(0, 16, 4000)] + rng.integers(-4, 5, (4000, 64))).astype(np.int64)
    now, before = x[rng.choice(4000, 16, replace=False)], None
    cluster, upper, lower = np.zeros(4000, np.int64), np.full(4000, np.inf, np.float32), np.zeros((4000, 16), np.float32)
    for r in range(5):
        cluster, _, upper, lower, computed = clustering.assign(x, cluster, upper, lower, clustering.Centroids(now, before))
        exact = ((x[:, None, :] - now[None, :, :]) ** 2).sum(2)
        assert (cluster == exact.argmin(1)).all()
        assert (upper.astype(float) ** 2 >= exact.min(1)).all() and (lower.astype(float) ** 2 <= exact).all()
        assert computed < len(x) * 16 / (1 if r == 0 else 3)
        before, now = now, np.array([x[cluster == k].sum(0) // max(1, (cluster == k).sum()) if (cluster == k).any() else now[k] for k in range(16)])
