"""Hard negatives by dual-tree search: for each anchor and positive, the best rows of another label in a band below the positive.

Two searches of one kind are made. Each query is an anchor with ranges of scores: first one open range over rows of its own
label (its positives), then a range for each positive over rows of other labels. A tree over the anchors and one over a
task's rows are walked together: from the centres and radii of two nodes follows an interval that holds the inner products
of all their pairs. A pair of nodes is dropped, with all its anchors at once, where the interval misses every range or ends
below what each anchor holds already, or where labels rule it out; pairs of leaves are scored exactly, in integers. Intervals
are rounded outwards and only what is strictly worse is dropped, so ties are decided by id alone.

Scale: the anchors are the stated query set; they go out in parts of about `PART` components, and rows stay where they are
read, in trees of about `CHUNK` components. A task holds k scores for each range of a part, whatever it reads. Before a search over all
rows one over a 64th of them, by a hash of the id, gives every range a score that its k best reach at least; so what tasks
send to be merged is about 64 k rows a range, however many tasks there are. Nothing but the anchors, their ranges and these
floors goes through the driver, a part at a time.

Defined cases: rows with a null label or id, a null vector, or a component that is null or not finite take no part, nor do
those with an integer component beyond +-2 ** 24 or over 2 ** 14 components, as their products need not fit a long; only rows of
equal length are compared; other rows are those with another id; a repeated row is a row of its own, as a candidate and as an
anchor; an empty table, or one without anchors, gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import deleted, fresh_path, written

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH, PER = 256, 100, 5, 10, 30, 90, 100
LARGEST, LONGEST, LEAF_ANCHORS, LEAF_ROWS, THIN = 1 << 24, 1 << 14, 16, 128, 64
#: Components of the anchors that are sent at once, and of the rows of a tree.
PART, CHUNK = 1 << 21, 1 << 21
LEAST, MOST = -(1 << 62), 1 << 62
FOUND = "query long, range int, vec_id long, score long"


def rows_of(table: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x) of the rows that take part, in integers; label as it is."""
    v = F.col(column)
    fits = (F.size(v) > 0) & (F.size(v) <= LONGEST) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) <= float(LARGEST)))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fits, F.lit(False))
    return table.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(v, lambda e: F.floor(e.cast("double") * scale).cast("int")).alias("x"))


class Tree:
    """A ball tree whose upper levels part the labels. order: the rows, leaf after leaf; first, last: a node's part of it."""

    def __init__(self, x: np.ndarray, label: np.ndarray, leaf: int):
        order = np.argsort(label, kind="stable")
        self.first, self.last, self.left, self.centre, self.radius, self.labels = [], [], [], [], [], []
        open_ = [(0, len(x))]
        for a, b in open_:  # grows on the way: children follow their parents
            own = order[a:b]
            labels, points = np.unique(label[own]), x[own].astype(np.float64)
            centre = points.mean(0)
            self.first.append(a)
            self.last.append(b)
            self.centre.append(centre)
            self.radius.append(float(np.sqrt(((points - centre) ** 2).sum(1).max())) * (1 + 1e-9) + 1e-6)
            self.labels.append(set(labels.tolist()))
            if b - a <= leaf:
                self.left.append(-1)
                continue
            if len(labels) > 1:
                cut = int(np.searchsorted(label[own], labels[len(labels) // 2]))
            else:
                cut = (b - a) // 2
                order[a:b] = own[np.argpartition(points[:, int(points.var(0).argmax())], cut)]
            self.left.append(len(open_))
            open_ += [(a, a + cut), (a + cut, b)]
        self.order, self.centre, self.radius = order, np.stack(self.centre), np.array(self.radius)
        self.norm = np.sqrt((self.centre**2).sum(1)) * (1 + 1e-9)


class Queries:
    """Anchors (id, label, vector) with ranges of scores, and the best k found so far in each; of one length of vector."""

    def __init__(self, query: np.ndarray, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.tree = Tree(x, label, LEAF_ANCHORS)
        o = self.tree.order
        self.query, self.vec_id, self.label, self.x, self.low, self.high, self.same, self.k = query[o], vec_id[o], label[o], x[o].astype(np.float64), low[o], high[o], same, k
        self.most = int(np.abs(self.x).max())
        n, ranges = low.shape
        self.score, self.id = np.full((n, ranges, k), LEAST, np.int64), np.full((n, ranges, k), MOST, np.int64)
        self.scored = self.pairs = 0

    def needed(self) -> np.ndarray:
        """The least score that can still enter each range."""
        return np.maximum(self.low, self.score[:, :, -1])

    def search(self, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        """Takes in some rows."""
        rows = Tree(x, label, LEAF_ROWS)
        vec_id, label, x = vec_id[rows.order], label[rows.order], x[rows.order].astype(np.float64)
        # Doubles are exact while all sums stay below 2 ** 53.
        exact = self.most * float(np.abs(x).max()) * x.shape[1] < 1 << 53
        self.pairs += len(self.query) * len(x)
        t, stack = self.tree, [(0, 0)]
        while stack:
            a, b = stack.pop()
            if self.same and not t.labels[a] & rows.labels[b] or not self.same and len(t.labels[a]) == 1 and t.labels[a] == rows.labels[b]:
                continue
            own = slice(t.first[a], t.last[a])
            middle, reach = float(t.centre[a] @ rows.centre[b]), t.norm[a] * rows.radius[b] + rows.norm[b] * t.radius[a] + t.radius[a] * rows.radius[b]
            slack = 1 + 1e-9 * (abs(middle) + reach)
            if not ((middle + reach + slack >= self.needed()[own].min(0)) & (middle - reach - slack <= self.high[own].max(0))).any():
                continue
            if t.left[a] < 0 and rows.left[b] < 0:
                there = slice(rows.first[b], rows.last[b])
                self.leaf(own, vec_id[there], label[there], x[there], exact)
            elif rows.left[b] < 0 or t.left[a] >= 0 and t.radius[a] >= rows.radius[b]:
                stack += [(t.left[a], b), (t.left[a] + 1, b)]
            else:
                # The child with the larger centre product is walked first, as it raises what is needed.
                left, right = rows.left[b], rows.left[b] + 1
                stack += [(a, left), (a, right)] if t.centre[a] @ (rows.centre[right] - rows.centre[left]) > 0 else [(a, right), (a, left)]

    def leaf(self, own: slice, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray, exact: bool) -> None:
        scores = (self.x[own] @ x.T).astype(np.int64) if exact else self.x[own].astype(np.int64) @ x.astype(np.int64).T
        self.scored += scores.size
        alike = self.label[own][:, None] == label[None, :]
        allowed = alike & (self.vec_id[own][:, None] != vec_id[None, :]) if self.same else ~alike
        floor = self.needed()[own]
        for r in range(self.low.shape[1]):
            i, j = np.nonzero(allowed & (scores >= floor[:, r : r + 1]) & (scores <= self.high[own, r][:, None]))
            if not len(i):
                continue
            some = np.unique(i)
            at = some + own.start
            who = np.concatenate([np.repeat(np.arange(len(some)), self.k), np.searchsorted(some, i)])
            score, ids = np.concatenate([self.score[at, r].ravel(), scores[i, j]]), np.concatenate([self.id[at, r].ravel(), vec_id[j]])
            best = np.lexsort((ids, -score, who))
            start = np.searchsorted(who[best], np.arange(len(some)))
            take = best[start[:, None] + np.arange(self.k)]
            self.score[at, r], self.id[at, r] = score[take], ids[take]

    def found(self) -> pd.DataFrame:
        i, r, j = np.nonzero(self.score > LEAST)
        return pd.DataFrame({"query": self.query[i], "range": r.astype(np.int32), "vec_id": self.id[i, r, j], "score": self.score[i, r, j]})


def chunks(batches: Iterator[pd.DataFrame], most: int = CHUNK) -> Iterator[tuple]:
    """Rows by length of vector, about `most` components at a time: (length, ids, labels, vectors)."""
    held: dict[int, list] = {}
    size: dict[int, int] = {}

    def whole(n: int) -> tuple:
        parts = held.pop(n)
        return n, *(np.concatenate([p[i] for p in parts]) for i in range(3))

    for b in batches:
        lengths = b.x.map(len).to_numpy()
        for n in np.unique(lengths):
            own = b[lengths == n]
            held.setdefault(int(n), []).append((own.vec_id.to_numpy(np.int64), own.label.to_numpy(np.int64), np.stack(own.x.to_numpy())))
            size[n] = size.get(n, 0) + len(own)
            if size[n] * n >= most:
                size[n] = 0
                yield whole(int(n))
    for n in list(held):
        yield whole(n)


def search(rows: DataFrame, anchors: pd.DataFrame, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """FOUND: what each task found in its rows for these anchors (query, vec_id, label, x)."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, low, high))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, lo, hi = sent.value
        lengths = a.x.map(len).to_numpy()
        made: dict[int, Queries] = {}
        for n, ids, labels, x in chunks(batches):
            if n not in made and (lengths == n).any():
                own = lengths == n
                made[n] = Queries(a["query"].to_numpy(np.int64)[own], a.vec_id.to_numpy(np.int64)[own], a.label.to_numpy(np.int64)[own], np.stack(a.x[own].to_numpy()), lo[own], hi[own], same, k)
            if n in made:
                made[n].search(ids, labels, x)
        for q in made.values():
            yield q.found()

    return rows.mapInPandas(walk, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each range, with their rank."""
    order = W.partitionBy("query", "range").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def searched(rows: DataFrame, anchors: pd.DataFrame, low: np.ndarray, high: np.ndarray, same: bool, k: int, thin: int = THIN) -> DataFrame:
    """The first k rows of each range of each anchor, over all rows. A search over a part of them only raises low."""
    few = search(rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(thin)) == 0), anchors, low, high, same, k)
    reached = best(few, k).filter(F.col("rank") == k).select("query", "range", "score").toPandas()
    at = pd.Series(np.arange(len(anchors)), index=anchors["query"]).loc[reached["query"]].to_numpy(int)
    low = low.copy()
    low[at, reached["range"].to_numpy(int)] = np.maximum(low[at, reached["range"].to_numpy(int)], reached.score.to_numpy(np.int64))
    return best(search(rows, anchors, low, high, same, k), k)


def parts(anchors: DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """The anchors, about so many components at a time, numbered from 0 on in each part."""
    held, size = [], 0
    for r in anchors.toLocalIterator():
        held.append((len(held), r.vec_id, r.label, np.array(r.x, np.int32)))
        size += len(r.x)
        if size >= most:
            yield pd.DataFrame(held, columns=["query", "vec_id", "label", "x"])
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=["query", "vec_id", "label", "x"])


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, per: int = PER, part: int = PART) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, x): `rows_of`.

    Anchors are rows with an id divisible by `every`. A negative's score, times per, is low to high times the positive's.
    """
    spark = rows.sparkSession
    rows = written(rows, "vectors")
    out = []
    for anchors in parts(rows.filter(F.col("vec_id") % every == 0), part):
        n = len(anchors)
        near = searched(rows, anchors, np.full((n, 1), LEAST + 1, np.int64), np.full((n, 1), MOST, np.int64), True, positives).toPandas()
        lo, hi = np.full((n, positives), MOST, np.int64), np.full((n, positives), LEAST + 1, np.int64)
        q, r, p = near["query"].to_numpy(int), near["rank"].to_numpy(int) - 1, near.score.to_numpy(np.int64)
        lo[q, r], hi[q, r] = -(-low * p // per), high * p // per
        far = searched(rows, anchors, lo, hi, False, negatives)
        of = pd.DataFrame({"query": q, "range": r, "anchor_id": anchors.vec_id.to_numpy()[q], "positive_id": near.vec_id, "positive_score": p})
        of = spark.createDataFrame(of, "query long, range int, anchor_id long, positive_id long, positive_score long")
        path = fresh_path(spark, "negatives")
        far.join(of, ["query", "range"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(path)
        out.append(path)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.parquet(*out)


def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(rows_of(table))


ORACLE_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {SCALE}) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) BETWEEN 1 AND {LONGEST}
  AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e) AND abs(CAST(e AS DOUBLE) * {SCALE}) <= {LARGEST})) = len(embedding)),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM k a, k b WHERE a.vec_id % {EVERY} = 0 AND len(a.x) = len(b.x)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s WHERE alike AND vec_id <> anchor_id) WHERE n <= {POSITIVES})
SELECT * FROM (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.n ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.r = s.r WHERE NOT s.alike AND {LOW} * p.score <= {PER} * s.score AND {PER} * s.score <= {HIGH} * p.score) WHERE rank <= {NEGATIVES}
"""
