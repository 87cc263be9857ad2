"""Searches of persisted indexes, built from the given tables, and keyed tables in versions, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import inverted, ivf
from quarry.plans import search
from quarry.sources.keyed import KeyedTable
from quarry.sources.shared import fresh_path
from quarry.sources.tables import table


def sparse_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The sparse hits of the whole benchmark, from an inverted index of all documents."""
    path = fresh_path(spark, "postings")
    inverted.build(inverted.terms(search.corpus(spark, d)), path)
    return search.flat(inverted.Index(spark, path).search(search.query_set(spark, d), 20))


def vector_index(spark: SparkSession, d: str) -> ivf.Index:
    path = fresh_path(spark, "cells")
    ivf.build(search.vectors(spark, d), path)
    return ivf.Index(spark, path)


def dense_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The dense hits of the whole benchmark, from an inverted-file index, exactly."""
    return search.flat(vector_index(spark, d).search(search.query_set(spark, d), 20, exact=True))


def dense_indexed_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.flat(vector_index(spark, d).search(search.query_set(spark, d), 20, exact=True, filters={"label": 3}))


def dense_ann(spark: SparkSession, d: str) -> DataFrame:
    """The same, with as many cells asked as were measured to find nearly all: approximate."""
    return search.flat(vector_index(spark, d).search(search.query_set(spark, d), 20))


def sourced(spark: SparkSession, d: str) -> KeyedTable:
    """A keyed table of all documents' sources; on top of it a version in which the toxic ones are marked."""
    old = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("value"))
    new = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("key"), F.lit("toxic").alias("value")).distinct()
    kept = KeyedTable(spark, fresh_path(spark, "keyed")).create(old, "key", 16)
    kept.upsert(old)
    kept.upsert(new)
    return kept


def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    return sourced(spark, d).read()


def keyed_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What each key held before and after the last write, where that changed it."""
    kept = sourced(spark, d)
    before, after = (kept.read(v).withColumnRenamed("value", name) for v, name in ((1, "before"), (2, "after")))
    return before.join(after, "key", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after"))).select("key", "before", "after")


QUERIES = {"sparse_indexed": sparse_indexed, "dense_indexed": dense_indexed, "dense_indexed_filtered": dense_indexed_filtered, "dense_ann": dense_ann, "keyed_upsert": keyed_upsert, "keyed_as_of": keyed_as_of}

ORACLE_SQL = {
    "sparse_indexed": search.ORACLE_SQL["sparse_topk"],
    "dense_indexed": search.ORACLE_SQL["dense_topk"],
    "dense_indexed_filtered": search.ORACLE_SQL["dense_topk_filtered"],
    "keyed_upsert": "WITH n AS (SELECT DISTINCT doc_id AS key FROM labels WHERE toxic = 1) SELECT key, 'toxic' AS value FROM n UNION ALL SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT key FROM n)",
    "keyed_as_of": """WITH n AS (SELECT DISTINCT doc_id AS key, 'toxic' AS value FROM labels WHERE toxic = 1)
SELECT coalesce(doc_id, key) AS key, source AS before, value AS after FROM documents FULL JOIN n ON doc_id = key WHERE value IS NOT NULL""",
}
