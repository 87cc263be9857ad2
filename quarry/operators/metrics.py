"""Evaluation of rankings and of corpora."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ir_metrics(runs: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """(strategy, ndcg, recall, precision, mrr): means over the queries that have a positive.

    runs (strategy, qid, id, score), qrels (qid, id, rel). Linear gain over log2(rank + 1); precision over k whatever was found.
    """
    positive = qrels.filter("rel > 0")
    ideal_rank = F.row_number().over(W.partitionBy("qid").orderBy(F.col("rel").desc(), "id"))
    ideal = positive.withColumn("i", ideal_rank).groupBy("qid").agg(F.sum(F.when(F.col("i") <= k, gain("rel", "i")).otherwise(0.0)).alias("idcg"), F.count("*").alias("n"))
    return means(in_order(runs).join(positive, ["qid", "id"], "left"), ideal, k)


def ir_metrics_by_class(runs: DataFrame, queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """`ir_metrics` where a row's grade for a query is its own if their classes are equal, else 0; without the pairs.

    queries (qid, class), rows (id, class, rel). Hits look their rows up; how many positives a query has, and its ideal gain,
    follow from the number of rows of each class and grade. So the work is that of hits and rows, not of queries x rows.
    """
    positive = rows.filter("rel > 0 AND class IS NOT NULL")
    asked = queries.filter("class IS NOT NULL")
    counts = positive.groupBy("class", "rel").agg(F.count("*").alias("m"))
    # A class has as many rows here as there are grades. Places last - m + 1 to last of the ideal ranking have this grade.
    placed = counts.withColumn("last", F.sum("m").over(W.partitionBy("class").orderBy(F.col("rel").desc())))
    upto = F.array(F.lit(0.0), *[F.lit(sum(1 / math.log2(i + 1) for i in range(1, m + 1))) for m in range(1, k + 1)])
    weight = lambda place: F.element_at(upto, F.least(place, F.lit(k)).cast("int") + 1)
    of_class = placed.groupBy("class").agg(F.sum(F.col("rel") * (weight(F.col("last")) - weight(F.col("last") - F.col("m")))).alias("idcg"), F.sum("m").alias("n"))
    hits = in_order(runs).join(asked, "qid", "left").join(positive.withColumnRenamed("class", "own"), "id", "left")
    return means(hits.withColumn("rel", F.when(F.col("own") == F.col("class"), F.col("rel"))), asked.join(of_class, "class").select("qid", "idcg", "n"), k)


def gain(rel: str, rank: str) -> Column:
    return F.col(rel) / F.log2(F.col(rank) + 1)


def in_order(runs: DataFrame) -> DataFrame:
    return runs.withColumn("i", F.row_number().over(W.partitionBy("strategy", "qid").orderBy(F.col("score").desc(), "id")))


def means(hits: DataFrame, ideal: DataFrame, k: int) -> DataFrame:
    """Of hits (strategy, qid, i, rel or null) and ideal (qid, idcg, n): the means over ideal's queries."""
    judged = hits.withColumn("rel", F.coalesce("rel", F.lit(0)))
    hit, top = F.col("rel") > 0, F.col("i") <= k
    per = judged.groupBy("strategy", "qid").agg(
        F.sum(F.when(top, gain("rel", "i")).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(hit & top, 1).otherwise(0)).alias("hits"),
        F.coalesce(1.0 / F.min(F.when(hit, F.col("i"))), F.lit(0.0)).alias("rr"),
    )
    # A query with a positive for which a strategy found nothing counts as zero: sums over what was found, by the number of queries.
    found = per.join(ideal, "qid", "left").withColumn("known", F.col("n").isNotNull())
    total = lambda c, name: F.sum(F.when(F.col("known"), c).otherwise(0.0)).alias(name)
    sums = found.groupBy("strategy").agg(total(F.col("dcg") / F.col("idcg"), "ndcg"), total(F.col("hits") / F.col("n"), "recall"), total(F.col("hits") / F.lit(k), "precision"), total(F.col("rr"), "mrr"))
    one_row = F.broadcast(ideal.agg(F.count("*").alias("queries")))
    return sums.crossJoin(one_row).filter("queries > 0").select("strategy", *[F.round(F.col(c) / F.col("queries"), 6).alias(c) for c in ("ndcg", "recall", "precision", "mrr")])


def advice(metrics: DataFrame) -> DataFrame:
    """Differences of strategies and what they suggest, by fixed thresholds."""
    at = lambda s, m: F.coalesce(F.max(F.when(F.col("strategy") == s, F.col(m))), F.lit(0.0))
    d = metrics.agg(F.round(at("D", "ndcg") - at("A", "ndcg"), 6).alias("hybrid_gain"), F.round(at("D", "ndcg") - at("C", "ndcg"), 6).alias("rerank_gain"), at("D", "recall").alias("recall"))
    return d.select("*", (F.col("hybrid_gain") > 0.05).alias("hybrid_helps"), (F.col("rerank_gain") > 0.03).alias("rerank_helps"), (F.col("recall") < 0.4).alias("recall_low"))


#: Values of a range that are sorted at last; cuts of a range in a round.
REST, CUTS = 10_000, 64


def by_index(rows: DataFrame, column: str, points: dict[str, tuple[int, int]], rest: int = REST) -> DataFrame:
    """Percentiles by index of the sorted values, without interpolation: element n * a // b, counted from 0. Nulls are no values.

    Distributed selection: a range that holds the element is cut at approximate quantiles of its values, the exact counts up to
    each cut tell which part holds it, and so on until at most `rest` different values are left, which are counted. Tasks send
    counts and small sketches, so no task sees all values, however many differ. One row; of no values, nulls.
    """
    v = F.col(column)
    values = rows.filter(v.isNotNull()).select(v.alias("v"))
    n = values.count()
    found = {name: selected(values, n * a // b, rest) if n else None for name, (a, b) in points.items()}
    kind = rows.schema[column].dataType.simpleString()
    return rows.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"`{name}` {kind}" for name in found))


def selected(values: DataFrame, rank: int, rest: int = REST) -> object:
    """The element of this rank, from 0, of the sorted values (v)."""
    low = high = None  # low < element <= high
    while True:
        inside = values
        inside = inside if low is None else inside.filter(F.col("v") > F.lit(low))
        inside = inside if high is None else inside.filter(F.col("v") <= F.lit(high))
        counts = inside.groupBy("v").agg(F.count("*").alias("c")).limit(rest + 1).collect()
        if len(counts) <= rest:
            skip = 0 if low is None else values.filter(F.col("v") <= F.lit(low)).count()
            for v, c in sorted(map(tuple, counts)):
                skip += c
                if skip > rank:
                    return v
        cuts = inside.agg(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], 10 * CUTS).alias("q"), F.max("v").alias("top")).first()
        edges = sorted({*cuts.q, cuts.top})
        # Cuts are values of the range; if all are its greatest, the one before it is one too.
        edges = edges if len(edges) > 1 else [inside.filter(F.col("v") < F.lit(cuts.top)).agg(F.max("v")).first()[0], cuts.top]
        upto = values.agg(*[F.count(F.when(F.col("v") <= F.lit(e), 1)).alias(str(i)) for i, e in enumerate(edges)]).first()
        at = next(i for i in range(len(edges)) if upto[i] > rank)
        low, high = edges[at - 1] if at else low, edges[at]


def paper_status(paragraphs: Column, garbage: Column) -> Column:
    return F.when(paragraphs == 0, "FAIL").when(paragraphs < 5, "SPARSE").when(garbage > 0, "GARBAGE").otherwise("OK")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
