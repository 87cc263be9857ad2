"""Dense and sparse top-k against brute force: ties, blocks of queries, many tasks, rows and queries without a vector or a text."""

import math
import random
import re
from collections import Counter

import pytest

from quarry.operators import metrics
from quarry.operators import retrieval as R


def best(scores, k):
    """(id, score) of the k best: by score, ties by id."""
    return sorted(scores, key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("block", [2048, 3])
def test_dense(spark, block):
    rng = random.Random(1)
    vector = lambda: [float(rng.randrange(-2, 3)) for _ in range(4)]  # noqa: E731  few values, so many ties
    corpus = [(i, None if i % 50 == 7 else [0.0] * 4 if i % 50 == 8 else [1.0] if i % 50 == 9 else vector(), i % 3) for i in range(6000)]
    queries = [(i, None if i == 4 else [0.0] * 4 if i == 5 else vector()) for i in range(8)]
    c = spark.createDataFrame(corpus, "id long, vec array<float>, kind int").repartition(9)
    q = spark.createDataFrame(queries, "qid long, qvec array<double>")
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    for filters, kinds in ((None, (0, 1, 2)), ({"kind": 1}, (1,))):
        got = {}
        for r in R.dense_topk(q, c, 12, filters, block).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.id, r.score))
            assert r.rank == len(got[r.qid]) - 1
        want = {i: best([(d, round(sum(a * b for a, b in zip(v, w, strict=True)) / norm(v) / norm(w), 6)) for d, w, kind in corpus if w is not None and len(w) == 4 and kind in kinds], 12) for i, v in queries if v is not None}
        assert {i: [x for x, _ in rows] for i, rows in got.items()} == {i: [x for x, _ in rows] for i, rows in want.items()}
        assert all(abs(a[1] - b[1]) < 2e-6 for i in want for a, b in zip(got[i], want[i], strict=True))
    assert R.dense_topk(q.limit(0), c, 5).count() == R.dense_topk(q, c.limit(0), 5).count() == 0


@pytest.mark.parametrize("block", [2048, 2])
def test_sparse(spark, block):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["Red", "fox", "hen", "ÜBER", "x1", "the", "the", "a-b"]) for _ in range(rng.randrange(n)))
    corpus = [(i, None if i % 40 == 3 else text(12)) for i in range(3000)]
    queries = [(0, "red fox"), (1, ""), (2, None), (3, "The the a"), (4, "nothing of it"), (5, "X1 hen hen hen")]
    c, q = spark.createDataFrame(corpus, "id long, text string").repartition(7), spark.createDataFrame(queries, "qid long, qtext string")
    terms = lambda t: Counter(re.findall("[a-z0-9]+", (t or "").lower()))
    want = {}
    for i, t in queries:
        a = terms(t)
        rows = [(d, round(sum(math.log1p(a[w]) * math.log1p(n) for w, n in terms(x).items() if w in a), 4)) for d, x in corpus]
        if rows := best([r for r in rows if r[1] > 0], 15):
            want[i] = rows
    got = {}
    for r in R.sparse_topk(q, c, 15, block=block).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, round(r.score, 4)))
    assert got == want and set(got) == {0, 3, 4, 5} - ({4} if 4 not in want else set())


def test_metrics_count_queries_without_hits(spark):
    runs = spark.createDataFrame([("A", 1, 10, 0.9), ("B", 9, 1, 0.5)], "strategy string, qid long, id long, score double")
    qrels = spark.createDataFrame([(1, 10, 2), (2, 11, 1)], "qid long, id long, rel int")
    got = {r.strategy: (r.ndcg, r.recall, r.precision, r.mrr) for r in metrics.ir_metrics(runs, qrels).collect()}
    assert got == {"A": (0.5, 0.5, 0.1, 0.5), "B": (0.0, 0.0, 0.0, 0.0)}
    assert metrics.ir_metrics(runs, qrels.limit(0)).count() == 0


def test_metrics_by_class_are_those_of_all_pairs(spark):
    """Grades by class without the pairs, against the pairs: grades of 0 to 3, classes without rows, repeated rows, null classes."""
    rng = random.Random(8)
    rows = [(rng.randrange(80), rng.choice([None, 0, 1, 2, 7]), rng.randrange(4)) for _ in range(90)]
    asked = [(q, rng.choice([None, 0, 1, 2, 9])) for q in range(30)]
    hits = [(s, q, i, rng.randrange(6) / 4) for s in "AB" for q in range(30) if rng.random() < 0.8 for i in rng.sample(range(100), rng.randrange(1, 9))]
    r = spark.createDataFrame(rows, "id long, class int, rel int").dropDuplicates(["id"])
    q = spark.createDataFrame(asked, "qid long, class int")
    runs = spark.createDataFrame(hits, "strategy string, qid long, id long, score double")
    want = metrics.ir_metrics(runs, q.join(r, "class").select("qid", "id", "rel"))
    for k in (5, 2):
        want = metrics.ir_metrics(runs, q.join(r, "class").select("qid", "id", "rel"), k)
        got = metrics.ir_metrics_by_class(runs, q, r, k)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
