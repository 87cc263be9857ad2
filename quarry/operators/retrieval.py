"""Dense and sparse top-k, fusion by reciprocal ranks, and reranking, for any number of queries at once.

Queries are the stated side: they are read once, in blocks of at most `BLOCK`, and a block is sent to the executors as a
matrix (dense) or as its terms' postings (sparse). A task scores a batch of rows against the whole block at once, by a matrix
product or one weighted count, and keeps only the best k of each query, whatever number of rows it sees; so what is shuffled
is k hits of each query and task. Hits carry ids and scores only until the last cut; payloads are joined to what is left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.text import strip
from quarry.sources.shared import written

RRF_K, WORD = 60, "[a-z0-9]+"
#: Queries of a block; rows scored at once; pairs of a row's term and a query's counted at once.
BLOCK, ROWS, PAIRS = 2048, 2048, 1 << 22


def blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[list]:
    """The query set in blocks, each read from the executors when it is asked for."""
    held = []
    for row in queries.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


class Best:
    """The k best (score, id) of each query so far: by score, ties by id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, scores: np.ndarray, candidate: np.ndarray | None = None, of: np.ndarray | None = None) -> None:
        """scores: rows by queries (by those of some, where `of` tells which); candidate: which of them count."""
        scores = np.where(np.isnan(scores) if candidate is None else ~candidate, -np.inf, scores)
        least = np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k] if len(ids) > self.k else np.full(scores.shape[1], -np.inf)
        row, query = np.nonzero((scores >= least) & (scores > -np.inf))
        query, score = query if of is None else of[query], scores[row, query]
        query, ids, score = (np.concatenate(x) for x in ((self.query, query), (self.id, ids[row]), (self.score, score)))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.searchsorted(query, np.arange(self.n))
        keep = np.arange(len(query)) - first[query] < self.k
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]

    def rows(self, qids: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"qid": pa.array(qids[self.query], pa.int64()), "id": pa.array(self.id, pa.int64()), "score": pa.array(self.score, pa.float64())})


HIT = "qid long, id long, score double"


def ranked(parts: list[DataFrame], queries: DataFrame, k: int) -> DataFrame:
    if not parts:
        return queries.sparkSession.createDataFrame([], HIT + ", rank int")
    return top(reduce(DataFrame.unionByName, parts), k, F.col("score").desc(), F.col("id"))


def must(rows: DataFrame, filters: dict | None) -> DataFrame:
    """Rows whose payload equals all of filters; applied before any ranking."""
    return rows if not filters else rows.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in filters.items()]))


def top(rows: DataFrame, k: int, *order: Column, by: str = "qid", name: str = "rank") -> DataFrame:
    """The first k of each query, with a rank from 0. Each partition keeps k before the shuffle."""
    ranked = rows.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col(name) <= k).withColumn(name, (F.col(name) - 1).cast("int"))


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 20, filters: dict | None = None, block: int = BLOCK) -> DataFrame:
    """(qid, id, score, rank) by cosine of queries (qid, qvec) and corpus (id, vec, payload...); ties by id.

    Scores have 6 places. A row or query without a vector, or of another length than the queries, has no hit; a vector of
    zeros scores 0.
    """
    rows = must(corpus, filters).select("id", "vec").filter(F.col("vec").isNotNull())
    parts = []
    for some in blocks(queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec")).filter("qvec IS NOT NULL AND qid IS NOT NULL"), block):
        for size in sorted({len(r.qvec) for r in some}):
            own = [r for r in some if len(r.qvec) == size]
            sent = queries.sparkSession.sparkContext.broadcast((np.array([r.qid for r in own], np.int64), unit(np.array([r.qvec for r in own], np.float64).reshape(len(own), size))))
            parts.append(rows.filter(F.size("vec") == size).mapInArrow(dense_scorer(sent, size, k), HIT))
    return ranked(parts, queries, k)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def dense_scorer(sent, size: int, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = sent.value
        best = Best(len(qids), k)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            for at in range(0, len(ids), ROWS):
                best.add(ids[at : at + ROWS], np.round(unit(vectors[at : at + ROWS]) @ q.T, 6))
        yield best.rows(qids)

    return score


def terms_of(text: str | None) -> Counter:
    """The lexical encoder used offline: how often each term occurs; its weight is ln(1 + count)."""
    return Counter(re.findall(WORD, text.lower())) if text else Counter()


def sparse_topk(queries: DataFrame, corpus: DataFrame, k: int = 20, filters: dict | None = None, block: int = BLOCK) -> DataFrame:
    """(qid, id, score, rank) by the dot product of term weights; a row that shares no term is no candidate; ties by id.

    Scores have 4 places. Terms that no query of the block has are dropped as they are counted.
    """
    rows = must(corpus, filters).select("id", "text").filter(F.col("text").isNotNull())
    parts = []
    for some in blocks(queries.select("qid", "qtext").filter("qid IS NOT NULL"), block):
        number: dict[str, int] = {}
        held = [(number.setdefault(term, len(number)), i, np.log1p(n)) for i, r in enumerate(some) for term, n in terms_of(r.qtext).items()]
        if not held:
            continue
        term, query, weight = (np.array(x) for x in zip(*sorted(held), strict=True))
        first = np.searchsorted(term, np.arange(len(number) + 1))
        sent = queries.sparkSession.sparkContext.broadcast((np.array([r.qid for r in some], np.int64), number, first, query, weight))
        parts.append(rows.mapInArrow(sparse_scorer(sent, k), HIT))
    return ranked(parts, queries, k)


def sparse_scorer(sent, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, number, first, query, weight = sent.value
        best, n = Best(len(qids), k), len(qids)
        ids, terms, counts, size, pairs = [], [], [], [], 0

        def flush() -> None:
            if not ids:
                return
            term, count, row = np.concatenate(terms), np.concatenate(counts), np.repeat(np.arange(len(ids)), size)
            many = first[term + 1] - first[term]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[term], many)
            cell = np.repeat(row, many) * n + query[at]
            total = np.bincount(cell, np.repeat(np.log1p(count), many) * weight[at], minlength=len(ids) * n).reshape(len(ids), n)
            best.add(np.array(ids, np.int64), np.round(total, 4), total > 0)

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [(number[t], c) for t, c in terms_of(text).items() if t in number]
                if not own:
                    continue
                term, count = (np.array(x, np.int64) for x in zip(*own, strict=True))
                ids.append(id_)
                terms.append(term)
                counts.append(count)
                size.append(len(own))
                pairs += int((first[term + 1] - first[term]).sum())
                if pairs >= PAIRS or len(ids) >= ROWS:
                    flush()
                    ids, terms, counts, size, pairs = [], [], [], [], 0
        flush()
        yield best.rows(qids)

    return score


def rrf(dense: DataFrame, sparse: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(qid, id, rrf_score, rank) of two ranked legs: sum of 1 / (rrf_k + rank), ranks from 0; ties: dense hits first, by rank."""
    one = lambda leg, name: leg.select("qid", "id", F.col("rank").alias(name))
    both = one(dense, "dr").join(one(sparse, "sr"), ["qid", "id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    fused = both.select("qid", "id", "dr", "sr", (part("dr") + part("sr")).alias("rrf_score"))
    return top(fused, k, F.col("rrf_score").desc(), F.col("dr").asc_nulls_last(), F.col("sr").asc_nulls_last())


def hybrid(queries: DataFrame, corpus: DataFrame, vectors: DataFrame, k: int = 20, filters: dict | None = None, depth: int | None = None) -> DataFrame:
    """Fusion of 2 * k dense and 2 * k sparse hits (or of `depth` each), cut to k."""
    n = depth or 2 * k
    return rrf(dense_topk(queries, vectors, n, filters), sparse_topk(queries, corpus, n, filters), k)


def words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0)))


def coverage(query_words: Column, text_words: Column) -> Column:
    """The offline pair scorer: the share of the query's distinct words that the text has."""
    return F.round(F.when(F.size(query_words) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query_words, text_words)) / F.size(query_words)), 6)


def rerank(hits: DataFrame, queries: DataFrame, corpus: DataFrame, n: int = 5) -> DataFrame:
    """hits (qid, id, rrf_score, rank) rescored by the pair scorer and cut to n; ties keep their order. Only hits are scored.

    Hits are written first, so that their true size decides how they meet the corpus: few are sent to where the texts are read.
    The words of a text that several queries hit, and those of a query, are worked out once. A hit without a text scores 0.
    """
    hits = written(hits.select("qid", "id", "rrf_score", "rank"), "hits")
    asked = queries.select("qid", words(F.col("qtext")).alias("qwords"))
    texts = corpus.select("id", "text").join(hits.select("id").distinct(), "id", "left_semi").select("id", words(F.col("text")).alias("twords"))
    found = hits.join(asked, "qid").join(texts, "id", "left")
    scored = found.select("qid", "id", "rrf_score", F.col("rank").alias("hybrid_rank"), coverage(F.col("qwords"), F.coalesce("twords", F.array().cast("array<string>"))).alias("rerank_score"))
    return top(scored, n, F.col("rerank_score").desc(), F.col("hybrid_rank"))


def search(queries: DataFrame, corpus: DataFrame, vectors: DataFrame, top_k: int = 20, top_n: int = 5, filters: dict | None = None) -> DataFrame:
    """Hybrid search, reranked. A blank query has no hits; top_n over top_k gives top_k at most."""
    asked = queries.filter(strip(F.coalesce("qtext", F.lit(""))) != "")
    return rerank(hybrid(asked, corpus, vectors, top_k, filters), asked, corpus, top_n)


def effective_score(*names: str) -> Column:
    return F.coalesce(*[F.col(n) for n in names], F.lit(0.0))


def preview(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """What an agent sees of a hit: score to 3 places, 150 characters of text."""
    text = F.col("text")
    found = hits.join(corpus, "id", "left")
    return found.select("qid", "id", "rank", F.coalesce("journal", F.lit("")).alias("journal"), F.coalesce("lang", F.lit("")).alias("lang"), F.round("rerank_score", 3).alias("score"), F.substring(F.coalesce(text, F.lit("")), 1, 150).alias("text"))
