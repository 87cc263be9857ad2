"""A persisted inverted-file index of vectors: cells by nearest centroid, searched by a few probes or exactly.

    path/rows/cell=<n>/   id, vec, payload: every row, in its cell's folder
    path/cells/           cell, size, n, reach, centroid: reach is the greatest angle of a row to its centroid
    path/probes/          size, probes, recall: how many cells a search has to ask, and the recall measured with them

Centroids are fitted to a bounded sample (`PER_CELL` rows a cell, chosen by a hash of the id), every row is assigned. Vectors of
each length have cells of their own, those of zeros (cosine 0 to all) one. Angles obey the triangle inequality: no row of a
cell is nearer to a query than the query's angle to the centroid less the cell's reach.

How many cells must be asked is measured, not guessed: for `TRIALS` rows (chosen by a hash) the true neighbours are found by a
scan, and the least number of cells is kept that reaches the recall asked for. Clustered vectors need few; vectors without
any structure need most, and then an index can't help.

A search asks each query's nearest cells first. The approximate one ends there. The exact one takes the k-th score found and
asks the further cells whose bound reaches it, so its hits are those of a scan, in the same order, whatever the cells are
like. Only the folders of cells that some query of a block asks are read, and a cell's rows are scored against the queries
that ask it. Filters are applied before any ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.retrieval import BLOCK, HIT, ROWS, Best, blocks, dense_topk, must, ranked, unit
from quarry.sources.shared import written

#: Rows of the sample a cell; cells at most; rounds of fitting; rows of a file.
PER_CELL, MOST_CELLS, ROUNDS, FILE_ROWS, SEED = 32, 4096, 10, 1 << 18, 17
#: For the number of probes: queries tried, neighbours of each, the recall to reach.
TRIALS, NEIGHBOURS, RECALL = 256, 20, 0.97
#: Scores have 6 places; bounds are taken a little wider than that.
PLACES, SLACK = 6, 2e-6


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors on the sphere: Lloyd's rounds from rows that are spread over the sample; empty cells go."""
    c = sample[np.unique(np.linspace(0, len(sample) - 1, cells).astype(int))]
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[at : at + 8192] @ c.T).argmax(1) for at in range(0, len(sample), 8192)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c = unit(sums[np.bincount(near, minlength=len(c)) > 0])
    return c


def build(vectors: DataFrame, path: str, cells: int | None = None, per_cell: int = PER_CELL, recall: float = RECALL) -> None:
    """Writes the index of vectors (id, vec, payload...). cells: for each length of vector; by default the root of its rows, MOST_CELLS at most."""
    spark = vectors.sparkSession
    own = vectors.filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).withColumn("vec", F.col("vec").cast("array<double>"))
    rows = written(own.filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x))), "vectors")
    zero = lambda v: F.forall(v, lambda x: x == 0)
    sizes = rows.filter(~zero("vec")).groupBy(F.size("vec").alias("size")).count().orderBy("size").collect()
    centroids, first, cell = {}, {}, 1  # cell 0: vectors of zeros
    for r in sizes:
        n = min(MOST_CELLS, cells or max(1, round(r["count"] ** 0.5)), r["count"])
        share = min(1.0, 1.2 * per_cell * n / r["count"])
        own = rows.filter((F.size("vec") == r.size) & ~zero("vec") & (F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) <= share * (1 << 30)))
        sample = own.select(F.xxhash64("id", F.lit(SEED)).alias("h"), "id", "vec").orderBy("h", "id").limit(per_cell * n).select("vec").toArrow()
        centroids[r.size] = fitted(unit(np.array(sample["vec"].to_pylist(), np.float64)), n) if len(sample) else np.eye(1, r.size)
        first[r.size] = cell
        cell += len(centroids[r.size])
    sent = spark.sparkContext.broadcast((centroids, first))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, at = sent.value
        for b in batches:
            lists = b.column(0)
            size, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            start = np.concatenate([[0], np.cumsum(size)])
            cell, angle = np.zeros(len(size), np.int32), np.zeros(len(size))
            for n in np.unique(size[size > 0]):
                some = np.flatnonzero(size == n)
                x = unit(values[start[some][:, None] + np.arange(n)])
                some, x = some[(x != 0).any(1)], x[(x != 0).any(1)]
                if len(some):
                    cosine = x @ c[n].T
                    cell[some] = at[n] + cosine.argmax(1)
                    angle[some] = np.arccos(np.clip(cosine.max(1), -1, 1))
            rest = [b.column(i) for i in range(1, b.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), lists, *rest], ["cell", "angle", "vec", *b.schema.names[1:]])

    payload = [c for c in rows.columns if c not in ("vec", "cell", "angle")]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in payload)
    assigned = written(rows.select("vec", *payload).mapInArrow(assign, f"cell int, angle double, vec array<double>, {kinds}"), "assigned")
    stats = written(assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach")), "stats")
    # A large cell is dealt to several tasks, by how many rows it has.
    spread = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / FILE_ROWS))
    dealt = assigned.join(F.broadcast(stats.select("cell", "n")), "cell").withColumn("angle", spread)
    dealt.repartition("cell", "angle").select("cell", "vec", *payload).write.partitionBy("cell").parquet(f"{path}/rows")
    known = [(0, 0, []), *((first[s] + i, s, v.tolist()) for s, c in centroids.items() for i, v in enumerate(c))]
    spark.createDataFrame(known, "cell int, size int, centroid array<double>").join(stats, "cell").coalesce(1).write.parquet(f"{path}/cells")
    tried = [(r.size, *calibrated(Index(spark, path), assigned.filter(F.size("vec") == r.size), r.size, recall)) for r in sizes]
    spark.createDataFrame(tried, "size int, probes int, recall double").coalesce(1).write.parquet(f"{path}/probes")


def calibrated(index: Index, rows: DataFrame, size: int, recall: float) -> tuple[int, float]:
    """(least number of cells, recall with it) for the neighbours of TRIALS rows (id, vec, cell) among all, itself left out."""
    q = rows.filter("cell > 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")).orderBy(F.xxhash64("qid", F.lit(SEED)), "qid").limit(TRIALS)
    q = written(q, "trials")
    true = written(dense_topk(q, rows.select("id", "vec"), NEIGHBOURS + 1).filter("qid <> id").select("qid", "id"), "true")
    found = rows.join(F.broadcast(true), "id").select("qid", "cell").collect()  # TRIALS x NEIGHBOURS rows
    asked = {r.qid: r.qvec for r in q.collect()}
    if not found:
        return 1, 1.0
    cells, cosine, _ = index.bounds(unit(np.array([asked[r.qid] for r in found])))
    place = {int(c): i for i, c in enumerate(cells)}
    own = cosine[np.arange(len(found)), [place[r.cell] for r in found]]
    rank = np.sort((cosine > own[:, None]).sum(1))
    probes = int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)]) + 1
    return probes, float((rank < probes).mean())


class Index:
    """At most MOST_CELLS centroids for each length are held."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        got = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        self.cells = {s: [r for r in got if r.size == s] for s in {r.size for r in got}}
        self.probes: dict[int, int] = {}

    def rows(self, cells: list[int]) -> DataFrame:
        """The rows of some cells: only their folders are read."""
        return self.spark.read.parquet(f"{self.path}/rows").filter(F.col("cell").isin(cells))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, cosine of each unit query to each centroid, the greatest score that a row of the cell can have)."""
        own = self.cells.get(q.shape[1], [])
        cosine = np.clip(q @ np.array([r.centroid for r in own]).reshape(len(own), q.shape[1]).T, -1, 1)
        bound = np.cos(np.maximum(0, np.arccos(cosine) - np.array([r.reach for r in own])[None, :]))
        bound[~(q != 0).any(1)] = 0  # to a query of zeros all are alike
        # A cell of zeros can't tell its rows' length: the scorer does.
        zeros = self.cells.get(0, [])
        cells = np.array([r.cell for r in own + zeros], np.int64)
        pad = np.zeros((len(q), len(zeros)))
        return cells, np.hstack([cosine, pad]), np.hstack([bound, pad])

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = None, exact: bool = False, filters: dict | None = None, block: int = BLOCK, read: list | None = None) -> DataFrame:
        """(qid, id, score, rank) of queries (qid, qvec), as `retrieval.dense_topk` has them. probes: cells to ask first, by default as many as were measured to do. read: gets how many cells each step read, of how many."""
        parts = []
        for some in blocks(queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec")).filter("qvec IS NOT NULL AND qid IS NOT NULL"), block):
            for size in sorted({len(r.qvec) for r in some}):
                own = [r for r in some if len(r.qvec) == size]
                qids, q = np.array([r.qid for r in own], np.int64), unit(np.array([r.qvec for r in own], np.float64).reshape(len(own), size))
                cells, cosine, bound = self.bounds(q)
                if not len(cells):
                    continue
                asked = np.zeros(cosine.shape, bool)
                if probes is None and not self.probes:
                    self.probes = {r.size: r.probes for r in self.spark.read.parquet(f"{self.path}/probes").collect()}
                near = np.argsort(-cosine, axis=1, kind="stable")[:, : probes or self.probes.get(size, 1)]
                np.put_along_axis(asked, near, True, axis=1)
                told = lambda x, n=len(cells): read.append((int(x.any(0).sum()), n)) if read is not None else None
                told(asked)
                found = self.scored(qids, q, cells, asked, k, filters)
                parts.append(found)
                if not exact:
                    continue
                parts[-1] = found = written(found, "found")
                at = {int(x): i for i, x in enumerate(qids)}
                need = np.full(len(qids), -np.inf)
                for r in ranked([found], queries, k).filter(F.col("rank") == k - 1).select("qid", "score").collect():  # a row for each query of the block
                    need[at[r.qid]] = r.score
                further = ~asked & (bound + SLACK >= need[:, None])
                told(further)
                if further.any():
                    parts.append(self.scored(qids, q, cells, further, k, filters))
        return ranked(parts, queries, k)

    def scored(self, qids: np.ndarray, q: np.ndarray, cells: np.ndarray, asked: np.ndarray, k: int, filters: dict | None) -> DataFrame:
        some = np.flatnonzero(asked.any(0))
        sent = self.spark.sparkContext.broadcast((qids, q, {int(cells[i]): np.flatnonzero(asked[:, i]) for i in some}))
        rows = must(self.rows([int(cells[i]) for i in some]), filters).filter(F.size("vec") == q.shape[1])
        return rows.select("id", "cell", "vec").mapInArrow(cell_scorer(sent, q.shape[1], k), HIT)


def cell_scorer(sent, size: int, k: int):
    """Rows of cells against the queries that ask each."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, asking = sent.value
        best = Best(len(qids), k)
        for batch in batches:
            ids, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = unit(batch.column(2).flatten().to_numpy().reshape(-1, size))
            for c in np.unique(cell):
                own, of = np.flatnonzero(cell == c), asking[int(c)]
                for at in range(0, len(own), ROWS):
                    some = own[at : at + ROWS]
                    best.add(ids[some], np.round(vectors[some] @ q[of].T, PLACES), None, of)
        yield best.rows(qids)

    return score
