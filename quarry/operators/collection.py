"""A searchable collection of the chunks that the pipeline left: numbered rows with their payload, both vectors, and indexes if wanted.

    path/rows/       id, pmcid, source_type, section, chunk_index, text, pub_year, journal, vec
    path/cells/      the vector index, path/postings/ the inverted one (`operators/ivf.py`, `operators/inverted.py`)

Searches know rows by numbers. These ascend with (pmcid, source_type, section, chunk_index), the columns that a chunk's id is made
of: rows are dealt to ranges of them, sorted there, and numbered by range and place, in one shuffle. So ties fall the same way
however the collection was built. A later build is another collection; the numbers of one mean nothing in another.

A search embeds its queries with the encoder that the chunks were embedded with, takes both legs from the indexes where there are any
(exactly: the hits are those of a scan), fuses and reranks them. Filters hold before ranking; the inverted index has no payload, so
the sparse leg of a filtered search scans.

A chunk without a dense vector has no dense hits; one without a text has no sparse ones. A blank query has none at all, a null
filter value matches nothing, an empty collection answers nothing. Rows that are equal in all four columns keep numbers of
their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators import inverted, ivf, providers, records
from quarry.operators import retrieval as R
from quarry.operators.agent import Agent
from quarry.sources.shared import exists

KEY = ["pmcid", "source_type", "section", "chunk_index"]
ROWS = "id long, pmcid string, source_type string, section string, chunk_index int, text string, pub_year string, journal string, vec array<double>"
FILTERS = ["pmcid", "source_type", "section", "pub_year", "journal"]


def build(made: dict[str, DataFrame], path: str, indexed: bool = True) -> Collection:
    """The collection at path, of the tables that `etl.run` returns: abstracts and full texts, each with its paper's year and journal."""
    spark = made["papers"].sparkSession
    abstracts = records.lookup(made["abstract chunks"].select(*KEY, "text", "dense"), made["papers"], "pmcid", ["pub_year", "journal"])
    rows = abstracts.unionByName(made["fulltext chunks"].select(*KEY, "text", "dense", "pub_year", "journal"))
    rows = rows.withColumn("vec", F.col("dense").cast("array<double>")).drop("dense")
    rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("id", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{path}/rows")
    found = Collection(spark, path)
    if indexed:
        ivf.build(found.rows.select("id", "vec", *FILTERS), f"{path}/cells")
        inverted.build(inverted.terms(found.rows.select("id", "text")), f"{path}/postings")
    return Collection(spark, path)


class Collection:
    def __init__(self, spark: SparkSession, path: str, encode: Callable[[list[str]], list] = providers.letters):
        self.spark, self.encode = spark, encode
        self.rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
        self.cells = ivf.Index(spark, f"{path}/cells") if exists(spark, f"{path}/cells") else None
        self.postings = inverted.Index(spark, f"{path}/postings") if exists(spark, f"{path}/postings/facts") else None

    def asked(self, queries: DataFrame) -> DataFrame:
        """queries (qid, qtext) that are not blank, with the vectors of their texts."""
        kept = queries.filter(strip(F.coalesce("qtext", F.lit(""))) != "").withColumn("text", F.col("qtext"))
        return providers.embedded(kept, self.encode, "qvec").drop("text")

    def legs(self, queries: DataFrame, n: int, filters: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """The n best dense and sparse hits of queries (qid, qtext, qvec)."""
        if unknown := set(filters or {}) - set(FILTERS):
            raise ValueError(f"no filters: {sorted(unknown)}")
        if self.cells is None:
            dense = R.dense_topk(queries, self.rows, n, filters)
        else:
            dense = self.cells.search(queries, n, exact=True, filters=filters)
        sparse = R.sparse_topk(queries, self.rows, n, filters) if self.postings is None or filters else self.postings.search(queries, n)
        return dense, sparse

    def search(self, queries: DataFrame, top_k: int = 20, top_n: int = 5, filters: dict | None = None) -> DataFrame:
        """(qid, rank, rerank_score, pmcid, source_type, section, chunk_index, pub_year, journal, text): the top_n chunks of each query (qid, qtext)."""
        asked = self.asked(queries)
        hits = R.rerank(R.rrf(*self.legs(asked, 2 * top_k, filters), top_k), asked, self.rows, top_n)
        return hits.select("qid", "id", "rank", "rerank_score").join(self.rows.drop("vec"), "id").drop("id")

    def agent(self, **own) -> Agent:
        """An agent whose searches are this collection's, its indexes and encoder included."""
        return Agent(self.spark, self.rows.drop("vec"), self.rows, encode=lambda query: self.encode([query])[0], legs=self.legs, **own)
