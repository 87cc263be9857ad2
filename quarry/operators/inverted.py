"""A persisted inverted index with block maxima, and an exact top-k that reads only the blocks that can matter.

    path/postings/bucket=<hash of the term>/   term, block, most, ids, weights: a term's postings in one block of rows
    path/blocks/                               block, n: how many rows each block has
    path/facts/                                how many rows, terms and postings there are

Rows are put into blocks of about `ROWS` rows that are alike: of one scale (the sum of a row's weights, on a log scale) and with
the same heaviest term, where enough rows have it. So in a block all are long or all are short, and mostly in one language,
and block maxima tell blocks apart. A term's postings in a block are one row, so a term that every row holds is as many
rows as there are blocks, and no group grows with the table.

A search asks in three steps. From the terms' block maxima alone (the columns `ids` and `weights` are not read) follows, for every
query and block, what no row of the block can exceed. Each query's most promising blocks are scored first, as many as hold k rows;
the k-th score found there is what a row needs. Then the postings of those blocks alone are read whose bound reaches it.
What is left out can't be among the k best, ties included; so the hits are those of a scan, in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.retrieval import BLOCK, HIT, WORD, Best, blocks, ranked, terms_of
from quarry.sources.shared import written

#: Rows of a block; steps of the log scale for each doubling of weight; buckets of terms; places of a score.
ROWS, STEPS, BUCKETS, PLACES = 64, 4, 32, 4
#: Texts whose terms a task holds at once.
SLICE = 256
POSTINGS = "term string, block long, most double, ids array<long>, weights array<double>, bucket int"


WEIGHTS = "id long, terms array<string>, weights array<double>"


def terms(corpus: DataFrame) -> DataFrame:
    """WEIGHTS of texts (id, text), ln(1 + count) each, as the lexical encoder weighs; a row's terms are counted where it is read."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            rows = [terms_of(t) for t in b.column(1).to_pylist()]
            first = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
            weights = np.log1p(np.fromiter((n for r in rows for n in r.values()), np.float64))
            lists = pa.ListArray.from_arrays(first, pa.array([t for r in rows for t in r], pa.string())), pa.ListArray.from_arrays(first, pa.array(weights))
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["id", "terms", "weights"])

    return corpus.filter("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text").mapInArrow(counted, WEIGHTS)


def stored(vectors: DataFrame, column: str = "sparse") -> DataFrame:
    """WEIGHTS of stored sparse vectors (id, struct of indices and values): an index is a term, and one that repeats counts in sum."""
    pairs = F.arrays_zip(F.col(f"{column}.indices").alias("i"), F.col(f"{column}.values").alias("v"))
    each = vectors.filter(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.explode(pairs).alias("p")).filter("p.v > 0")
    summed = each.groupBy("id", F.col("p.i").cast("string").alias("term")).agg(F.sum(F.col("p.v").cast("double")).alias("weight"))
    return summed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("p")).select("id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights"))


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(weights: DataFrame, path: str, rows: int = ROWS, buckets: int = BUCKETS) -> None:
    """Writes the index of weights (WEIGHTS), one row for each id. Texts aren't shuffled: a row's terms go to its block, and that is all."""
    scale = F.floor(F.log2(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)) * STEPS).cast("int")
    # A row's heaviest term; of equal ones the last by code point.
    top = F.array_max(F.arrays_zip(F.col("weights").alias("w"), F.col("terms").alias("t")))["t"]
    held = written(weights.filter(F.size("terms") > 0).select("id", "terms", "weights", scale.alias("scale"), top.alias("top")), "weights", compression="zstd")
    common = written(held.groupBy("scale", "top").agg(F.count("*").alias("m")).filter(F.col("m") >= rows).select("scale", "top", F.col("top").alias("common")), "common")
    kind = held.join(common, ["scale", "top"], "left")
    # As many blocks of a kind as its rows ask for; a block's number is a hash, and two that meet are one block.
    sizes = written(kind.groupBy("scale", "common").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts")), "sizes")
    same = (F.col("k.scale") == F.col("s.scale")) & F.col("k.common").eqNullSafe(F.col("s.common"))
    block = F.xxhash64("k.scale", "k.common", F.col("k.common").isNull(), F.pmod(F.xxhash64("k.id"), F.col("s.parts")))
    placed = kind.alias("k").join(sizes.alias("s"), same).select(block.alias("block"), "k.id", "k.terms", "k.weights")
    postings = placed.repartition("block").sortWithinPartitions("block", "id").mapInArrow(posted, "term string, block long, most double, ids array<long>, weights array<double>")
    # A task writes its blocks' postings, a file for each bucket. There terms are in order, so the file's statistics tell which of its parts hold a term.
    dealt = postings.withColumn("bucket", bucket(F.col("term"), buckets)).sortWithinPartitions("bucket", "term", "block")
    dealt.write.options(maxRecordsPerFile=1 << 20, compression="zstd").partitionBy("bucket").parquet(f"{path}/postings")
    kind.alias("k").join(sizes.alias("s"), same).groupBy(block.alias("block")).agg(F.count("*").alias("n")).write.parquet(f"{path}/blocks")
    there = held.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings")
    facts = there.agg(F.count_distinct("term").alias("terms"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("postings"))
    facts.withColumns({"rows": F.lit(held.count()), "buckets": F.lit(buckets)}).write.parquet(f"{path}/facts")


def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, terms, weights), block after block, ids rising: a row for each term of each block."""
    now, held = None, []

    def flush() -> pa.RecordBatch:
        ids = np.concatenate([b.column(1).to_numpy() for b in held])
        size = np.concatenate([b.column(2).value_lengths().to_numpy() for b in held])
        weights = np.concatenate([b.column(3).flatten().to_numpy() for b in held])
        found = pa.concat_arrays([b.column(2).flatten() for b in held]).dictionary_encode()
        code = found.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(found.dictionary)))]).astype(np.int32)
        weights, ids = weights[order], np.repeat(ids, size)[order]
        most = np.maximum.reduceat(weights, first[:-1])
        lists = [pa.ListArray.from_arrays(first, x) for x in (ids, weights)]
        return pa.RecordBatch.from_arrays([found.dictionary, pa.array(np.full(len(most), now), pa.int64()), pa.array(most), *lists], ["term", "block", "most", "ids", "weights"])

    for b in batches:
        block = b.column(0).to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist() if len(block) else []
        for at, end in zip(cut, [*cut[1:], len(block)], strict=True):
            if block[at] != now:
                if held:
                    yield flush()
                now, held = block[at], []
            held.append(b.slice(at, end - at))
    if held:
        yield flush()


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.facts = spark.read.parquet(f"{path}/facts").first()

    def postings(self, of: list[str]) -> DataFrame:
        """The postings of some terms: only the buckets that hold one are read."""
        asked = self.spark.createDataFrame([(t,) for t in of], "term string").withColumn("bucket", bucket(F.col("term"), self.facts.buckets))
        some = sorted({r.bucket for r in asked.select("bucket").distinct().collect()})
        rows = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").filter(F.col("bucket").isin(some))
        return rows.join(F.broadcast(asked.select("term")), "term", "left_semi")

    def search(self, queries: DataFrame, k: int = 20, block: int = BLOCK, counted: list | None = None) -> DataFrame:
        """(qid, id, score, rank) of queries (qid, qtext), as `retrieval.sparse_topk` has them. counted: gets (postings scored, those that the queries' terms have) of each block of queries."""
        parts = []
        for some in blocks(queries.select("qid", "qtext").filter("qid IS NOT NULL"), block):
            number: dict[str, int] = {}
            held = [(number.setdefault(t, len(number)), i, float(np.log1p(n))) for i, r in enumerate(some) for t, n in terms_of(r.qtext).items()]
            if held:
                parts.append(self.best(np.array([r.qid for r in some], np.int64), number, held, k, counted))
        return ranked(parts, queries, k)

    def best(self, qids: np.ndarray, number: dict[str, int], held: list[tuple], k: int, counted: list | None) -> DataFrame:
        """HIT of one block of queries: (number of term, query, weight) each."""
        asked = self.spark.createDataFrame([(t, [(q, w) for q, w in own]) for t, own in grouped(number, held)], "term string, q array<struct<query: int, weight: double>>")
        blocks_ = self.spark.read.parquet(f"{self.path}/blocks")
        postings = self.postings(list(number))
        # Step one, from maxima alone: at most one row for each query and block.
        top = postings.select("term", "block", "most").join(F.broadcast(asked), "term").select("block", "most", F.explode("q").alias("x"))
        bounds = top.groupBy("block", F.col("x.query").alias("query")).agg(F.sum(F.col("most") * F.col("x.weight")).alias("bound"))
        bounds = written(bounds.join(blocks_, "block"), "bounds")
        order = W.partitionBy("query").orderBy(F.col("bound").desc(), "block")
        upto = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1))
        # A block may hold fewer rows that share a term than rows; twice k is a start, the bound decides.
        first = bounds.withColumn("before", F.coalesce(upto, F.lit(0))).filter(F.col("before") < 2 * k).select("query", "block")
        found = written(self.scored(postings, first, qids, number, held, k), "found")
        at = self.spark.createDataFrame([(int(q), i) for i, q in enumerate(qids)], "qid long, query int")
        need = ranked([found], at, k).filter(F.col("rank") == k - 1).join(F.broadcast(at), "qid").select("query", "score")
        # Scores are rounded, so a bound a little below the needed score may still reach it.
        open_ = bounds.join(F.broadcast(need), "query", "left").filter(F.col("score").isNull() | (F.col("bound") + 10.0**-PLACES >= F.col("score")))
        rest = written(open_.select("query", "block").join(first, ["query", "block"], "left_anti"), "rest")
        if counted is not None:
            size = postings.select("block", "term", F.size("ids").alias("m")).join(F.broadcast(asked), "term").select("block", "m", F.explode("q.query").alias("query"))
            some = size.join(first.unionByName(rest), ["block", "query"], "left_semi")
            counted.append(tuple(x.select(F.coalesce(F.sum("m"), F.lit(0))).first()[0] for x in (some, size)))
        return found if rest.isEmpty() else found.unionByName(self.scored(postings, rest, qids, number, held, k))

    def scored(self, postings: DataFrame, wanted: DataFrame, qids: np.ndarray, number: dict[str, int], held: list[tuple], k: int) -> DataFrame:
        """HIT: the k best of each query and task among the rows of the blocks that it wants (query, block)."""
        term, query, weight = (np.array(x) for x in zip(*sorted(held), strict=True))
        sent = self.spark.sparkContext.broadcast((qids, number, np.searchsorted(term, np.arange(len(number) + 1)), query, weight))
        asking = wanted.groupBy("block").agg(F.collect_list("query").alias("queries"))
        rows = postings.join(asking, "block").select("block", "term", "ids", "weights", F.when(F.row_number().over(W.partitionBy("block").orderBy("term")) == 1, F.col("queries")).alias("queries"))
        return rows.mapInArrow(block_scorer(sent, k), HIT)


def grouped(number: dict[str, int], held: list[tuple]) -> Iterator[tuple[str, list]]:
    own: dict[int, list] = {}
    for t, q, w in held:
        own.setdefault(t, []).append((q, w))
    return ((term, own[i]) for term, i in number.items())


def block_scorer(sent, k: int):
    """Over postings by block, a block's first row with the queries that want it: their scores, a block at a time."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, number, first, query, weight = sent.value
        best, now, wants, held = Best(len(qids), k), None, np.zeros(0, np.int64), []

        def flush() -> None:
            if not held:
                return
            ids, row = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True)
            column = np.full(len(qids), -1)
            column[wants] = np.arange(len(wants))
            total, at = np.zeros((len(ids), len(wants))), 0
            for t, own, w in held:
                some = slice(first[t], first[t + 1])
                to = column[query[some]]
                total[np.ix_(row[at : at + len(own)], to[to >= 0])] += w[:, None] * weight[some][to >= 0][None, :]
                at += len(own)
            best.add(ids, np.round(total, PLACES), total > 0, wants)

        for b in batches:
            for block, term, ids, weights, queries in zip(*(b.column(i) for i in range(5)), strict=True):
                if block.as_py() != now:
                    flush()
                    now, held = block.as_py(), []
                if queries.is_valid:
                    wants = np.sort(queries.values.to_numpy())
                held.append((number[term.as_py()], ids.values.to_numpy(), weights.values.to_numpy()))
        flush()
        yield best.rows(qids)

    return score
