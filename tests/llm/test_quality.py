"""The quality classifier: the risk and its steps against a plain restatement, the prior without negatives, bounded learning."""

import numpy as np
import pytest

from quarry.llm import quality as Q


def risk(w, p, u, prior):
    """The unbiased risk's two parts, by its definition."""
    loss = lambda z: np.log1p(np.exp(-z))
    return prior * loss(p @ w).mean(), loss(-(u @ w)).mean() - prior * loss(-(p @ w)).mean()


def test_fit_takes_steps_down_the_non_negative_risk():
    """One batch an epoch: the first step goes along the sign of the numeric gradient, and the whole lowers the risk."""
    rng = np.random.default_rng(4)
    p, u = rng.normal(0.7, 1, (300, 4)), np.vstack([rng.normal(0.7, 1, (150, 4)), rng.normal(-0.9, 1, (150, 4))])
    mean, scale = u.mean(0), 1 / (u.std(0) + 1e-2)
    x, y = (np.hstack([(a - mean) * scale, np.ones((len(a), 1))]) for a in (p, u))
    whole = lambda w, prior: sum(risk(w, x, y, prior))
    for prior in (0.3, 0.5):
        zero = np.zeros(5)
        numeric = np.array([(whole(zero + e, prior) - whole(zero - e, prior)) / 2e-5 for e in np.eye(5) * 1e-5])
        one, _, _ = Q.fit(p, u, prior, epochs=1, l2=0.0)
        assert (np.sign(one) == -np.sign(numeric)).all()
        w, _, _ = Q.fit(p, u, prior, epochs=200)
        positive, negative = risk(w, x, y, prior)
        assert positive + max(0, negative) < whole(zero, prior) - 0.1 and negative > -0.05


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled_texts(prior):
    rng = np.random.default_rng(5)
    n = 4000
    k = int(n * prior)
    p, u = rng.normal(1.5, 1, (n, 6)), np.vstack([rng.normal(1.5, 1, (k, 6)), rng.normal(-1.5, 1, (n - k, 6))])
    assert abs(Q.class_prior(*Q.contrast(p, u, epochs=20)) - prior) < 0.06
    assert Q.class_prior(np.zeros(3), np.zeros(3)) == 0.5


def test_learning_never_reads_a_negative_label(spark):
    """Labels of 0 may be left out or be many: the model is the same."""
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["good", "fine", "prose"], 30)) if i % 3 else "BUY!! $$ " * int(rng.integers(3, 9))) for i in range(600)], "doc_id long, text string")
    ones = [(i, 1) for i in range(600) if i % 3 and i % 2]
    schema = "doc_id long, quality int"
    a = Q.learn(spark, docs, spark.createDataFrame(ones, schema))
    b = Q.learn(spark, docs, spark.createDataFrame(ones + [(i, 0) for i in range(0, 600, 3)], schema))
    assert np.array_equal(a["w"], b["w"]) and a["prior"] == b["prior"]
    got = Q.with_quality(docs, a).toPandas()
    assert ((got.score >= 0.5) == (got.doc_id % 3 != 0)).mean() > 0.97


def test_repeated_ids_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}", 0.1) for i in range(4000)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i % 40, 1) for i in range(400)], "doc_id long, quality int")
    model = Q.learn(spark, docs, labels, sample=10)
    assert model["w"] is not None
    out = Q.with_quality(docs, model)
    assert out.columns == ["doc_id", "text", "score"] and out.filter("score between 0 and 1").count() == 4000
