"""Positive-unlabelled quality classifier, trained by the non-negative unbiased risk.

Trusted positives are labelled rows of quality 1; the unlabelled set is a sample of all web text, of whatever quality. A
linear scorer over statistics of the whole text (shares of bytes, repeated words, word lengths) minimises

    prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]),      l(z) = log(1 + exp(-z)),

where a step whose second part falls below -beta goes back along that part alone. The class prior is estimated from the same
two sets, without any negative label: a scorer of positives against unlabelled texts is fitted on one half of both, and on
the other half the prior is the least ratio, over thresholds, of the share of unlabelled texts above it to that of positives
(each with its confidence bound; the best-bin estimate). Learning takes rows whose crc32(doc_id) mod 3 is not 1.

Bound: `sample` positives and as many unlabelled texts (chosen by a hash of the id, so reruns agree) are what learning
takes, whatever the size of the corpus, of rows with equal ids one; their features, not their texts, go to the driver.
Ids are thinned by their hash before any are ranked. Scoring covers every row.

Defined cases: a null text is empty; an empty text has features of zero and a score like any other; without any
positive the score is the prior 0.5 for all; repeated rows score alike; `with_quality` keeps further columns, and its own takes the place of one of the same name.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, fold, held_out, slices, unused, utf8

SAMPLE, EPOCHS, SEED = 8000, 40, 17


def features(text: str | None) -> np.ndarray:
    """270 numbers between 0 and about 1 from the whole text."""
    raw = utf8(text)
    n = len(raw) or 1
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    lower = raw.translate(LOWER_BYTES)
    words = lower.split()
    m = len(words) or 1
    again = sum(map(operator.eq, words, words[1:]))
    lines = lower.split(b"\n")
    upper, letters = shares[65:91].sum(), shares[65:91].sum() + shares[97:123].sum() + shares[128:].sum()
    signs = 1 - letters - shares[48:58].sum() - shares[9:14].sum() - shares[32]
    plain = shares[[33, 39, 44, 46, 63]].sum()
    more = np.array([upper, signs, max(signs - plain, 0), again / m, 1 - len(set(words)) / m, 1 - len(set(lines)) / len(lines), min(n / m / 50, 2), np.log1p(m) / 10, shares[33], shares[124], upper / (letters + 1e-9), shares[35] + shares[36] + shares[37] + shares[38] + shares[42], letters, float(m < 3)])
    return np.concatenate([np.sqrt(shares), np.sqrt(np.maximum(more, 0))]).astype(np.float32)


def fit(p: np.ndarray, u: np.ndarray, prior: float, epochs: int = EPOCHS, beta: float = 0.0, gamma: float = 1.0, rate: float = 0.02, l2: float = 1e-5, seed: int = SEED, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the bias last, mean, scale) of the linear scorer, by Adam on batches of the non-negative risk.

    plain: the unlabelled texts as if all were negative, which tells the two sets apart and no more.
    """
    mean = u.mean(0)
    scale = 1 / (u.std(0) + 1e-2)
    p, u = (np.hstack([(x - mean) * scale, np.ones((len(x), 1))]).astype(np.float32) for x in (p, u))
    w = np.zeros(p.shape[1])
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    rng = np.random.default_rng(seed)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    parts = max(1, min(len(p), len(u)) // 500)
    for epoch in range(epochs):
        for a, b in zip(np.array_split(rng.permutation(len(p)), parts), np.array_split(rng.permutation(len(u)), parts), strict=True):
            xp, xu = p[a], u[b]
            zp, zu = xp @ w, xu @ w
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g_positive = -prior * (xp.T @ sig(-zp)) / len(xp)
            g_negative = (xu.T @ sig(zu)) / len(xu) - (0 if plain else prior * (xp.T @ sig(zp)) / len(xp))
            g = g_positive + g_negative if negative >= -beta else -gamma * g_negative
            g = g + l2 * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w, mean, scale


def contrast(p: np.ndarray, u: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Held-out scores of positives and of unlabelled texts, by a logistic scorer that tells the two sets apart."""
    rng = np.random.default_rng(seed)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    half, other = len(p) // 2, len(u) // 2
    # With all weight on telling the sets apart, that is the risk of a prior of one half without its correction.
    w, mean, scale = fit(p[:half], u[:other], 0.5, epochs, beta=np.inf, seed=seed, plain=True)
    score = lambda x: ((x - mean) * scale) @ w[:-1] + w[-1]
    return score(p[half:]), score(u[other:])


def class_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1, slack: float = 0.01) -> float:
    """The best-bin estimate of the share of positives among u from held-out scores of both."""
    if len(p) < 20 or len(u) < 20:
        return 0.5
    cuts = np.unique(np.concatenate([p, u]))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    qp, qu = above(p), above(u)
    bound = np.sqrt(np.log(4 / delta) / 2 / len(u)) + (1 + slack) * np.sqrt(np.log(4 / delta) / 2 / len(p))
    ok = qp > 0
    best = np.argmin((qu[ok] + bound) / qp[ok])
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.01, 0.99))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model from the learning folds: docs (doc_id, text) and labels (doc_id, quality)."""
    ours = fold() != 1
    known = labels.select("doc_id", "quality").filter(ours & F.col("quality").isin(0, 1))
    # A label row counts once, and a document with both values is no trusted positive.
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def chosen(ids: DataFrame, seed: int, positive: int) -> DataFrame:
        """`sample` of ids (doc_id) by a hash, thinned to about four times as many first."""
        n = max(1, ids.agg(F.approx_count_distinct("doc_id")).first()[0])
        order = F.xxhash64(F.col("doc_id"), F.lit(seed))
        thin = ids.filter(F.pmod(order, F.lit(1 << 30)) < F.lit(int(min(1.0, 4 * sample / n) * (1 << 30))))
        return thin.distinct().orderBy(order, "doc_id").limit(sample).select("doc_id", F.lit(positive).alias("positive"))

    positives = chosen(known.filter("quality = 1").select("doc_id"), SEED, 1)
    others = chosen(docs.select("doc_id").filter(ours), SEED + 1, 0)
    # At most 2 * sample ids of two numbers each: a proven bound, so the text side of the join stays where it is.
    some = docs.select("doc_id", "text").join(F.broadcast(positives.unionByName(others)), "doc_id")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"positive": batch.positive, "doc_id": batch.doc_id, "x": [features(x).tobytes() for x in batch.text]})

    got = some.select("positive", "doc_id", "text").mapInPandas(rows, "positive int, doc_id long, x binary")
    got = got.groupBy("doc_id", "positive").agg(F.min("x").alias("x")).toPandas().sort_values(["doc_id", "positive"])
    x = np.vstack([np.frombuffer(b, np.float32) for b in got.x]) if len(got) else np.zeros((0, 1), np.float32)
    p, u = x[got.positive.to_numpy() == 1], x[got.positive.to_numpy() == 0]
    if not len(p) or not len(u):
        return {"w": None}
    prior = class_prior(*contrast(p, u))
    w, mean, scale = fit(p, u, prior)
    return {"w": (w[:-1] * scale).astype(np.float32), "b": float(w[-1] - (w[:-1] * scale) @ mean), "prior": prior}


def scorer(model: dict):
    """An Arrow UDF: text to score. Marked as not deterministic only so that Spark runs it once for each row."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (some for batch in batches for some in slices(batch)):
            if model["w"] is None:
                yield pa.array(np.full(len(texts), 0.5))
                continue
            z = np.array([features(t) @ model["w"] for t in texts], dtype=np.float64) + model["b"]
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return score.asNondeterministic()


def with_quality(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """docs with one more column, the score of its text."""
    return docs.drop(name).withColumn(name, scorer(model)(F.col("text")))


def predicted(score: Column) -> Column:
    return (score >= 0.5).cast("int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier takes for label 1; learnt from docs itself and the labels of sf_dir."""
    model = learn(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = unused(docs, "__score")
    return with_quality(docs, model, own).filter(F.col(own) >= 0.5).drop(own)
