"""Hard negatives against all pairs: ties, repeated rows, rows that take no part, several parts; and what the trees prune."""

import math
from collections import Counter

import numpy as np
import pytest

from quarry.llm import hardneg


def plain(rows, every, positives=5, negatives=10):
    kept = [(i, g, [math.floor(256 * float(x)) for x in v]) for i, g, v in rows if None not in (i, g, v) and v and all(x is not None and math.isfinite(x) and abs(x * 256) <= hardneg.LARGEST for x in v)]
    out = Counter()
    for i, g, v in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, h) for j, h, w in kept if len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == g and x[1] != i][:positives]:
            for rank, (t, n, _) in enumerate([x for x in scored if x[2] != g and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives], 1):
                out[i, p, rank, n, -s, -t] += 1
    return out


def got(spark, rows, **options):
    frame = spark.createDataFrame([(i, g, v, i, 0) for i, g, v in rows], "vec_id long, label int, embedding array<float>, query long, rank int")
    found = hardneg.hard_negatives(hardneg.rows_of(frame), **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("part", [hardneg.PART, 40])
def test_edges(spark, part):
    rng = np.random.default_rng(2)
    vector = lambda n=8: [float(np.float32(x)) for x in rng.normal(0.1, 0.3, n)]
    rows = [(i, int(rng.integers(0, 4)), vector()) for i in range(300)]
    rows += [(0, 1, rows[5][2]), (20, 2, rows[20][2]), (20, 2, rows[20][2]), (7, 3, rows[7][2]), (7, 3, rows[7][2])]
    rows += [(None, 1, vector()), (400, None, vector()), (401, 1, None), (402, 1, []), (420, 1, vector(9)), (421, 1, vector(9)), (422, 2, vector(9)), (-20, -1, vector()), (440, 99, vector())]
    rows += [(460 + k, 1, [x, *vector(7)]) for k, x in enumerate((None, float("nan"), float("inf"), float("-inf"), 3e38, -65536.0))]
    rows += [(480, 1, [0.0] * 8), (500, 2, [-x for x in rows[0][2]])]
    want = plain(rows, 20)
    assert want and got(spark, rows, every=20, part=part) == want


def test_ties(spark):
    """Components of two values: nearly all scores are shared by many rows, so ids decide."""
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in rng.integers(0, 2, 5)]) for i in rng.permutation(400)]
    assert got(spark, rows, every=25) == plain(rows, 25)


def test_no_anchors_and_no_rows(spark):
    assert not got(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) and not got(spark, [])


@pytest.mark.parametrize("same", [True, False])
def test_trees_prune_whole_groups(same):
    """Clustered vectors: most pairs are never scored, and nothing is missed."""
    rng = np.random.default_rng(6)
    centres = rng.integers(-90, 90, (40, 64))
    kind = rng.integers(0, 40, 9000)
    x = centres[kind] + rng.integers(-9, 10, (9000, 64))
    label, ids, a = kind % (10 if same else 40), np.arange(9000), np.arange(0, 9000, 20)
    low, high = np.full((len(a), 1), hardneg.LEAST + 1), np.full((len(a), 1), hardneg.MOST if same else 150_000)
    q = hardneg.Queries(a, a, label[a], x[a], low, high, same, 5)
    for part in np.array_split(np.arange(9000), 3):
        q.search(ids[part], label[part], x[part])
    assert q.scored < q.pairs * 0.6
    found = {(r.query, r.vec_id, r.score) for r in q.found().itertuples()}
    for i in a:
        s = x @ x[i]
        ok = (label == label[i]) & (ids != i) if same else (label != label[i]) & (s <= 150_000)
        want = sorted((-s[j], j) for j in np.flatnonzero(ok))[:5]
        assert {(i, j, -t) for t, j in want} <= found
    assert len(found) == 5 * len(a)


def test_whole_numbers_beyond_doubles():
    """Products over 2 ** 53 are summed in integers."""
    big = 1 << 24
    x = np.array([[big] * 64, [big] * 63 + [big - 1], [big - 1] * 64])
    q = hardneg.Queries(np.arange(1), np.arange(1), np.zeros(1, int), x[:1], np.full((1, 1), hardneg.LEAST + 1), np.full((1, 1), hardneg.MOST), True, 2)
    q.search(np.arange(3), np.zeros(3, int), x)
    assert [(r.vec_id, r.score) for r in q.found().itertuples()] == [(1, 64 * big * big - big), (2, 64 * big * (big - 1))]
