"""Search of what the pipeline wrote: the whole benchmark asked of the chunks of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import collection
from quarry.plans import corpus, raw, search
from quarry.sources.shared import fresh_path
from quarry.sources.tables import table

SHOWN = ["qid", "rank", "rerank_score", "pmcid", "source_type", "section", "chunk_index", "pub_year", "journal"]


def chunk_search(s: SparkSession, d: str) -> DataFrame:
    """The five best chunks for each item: raw answers to papers and chunks with vectors, these to a collection, then hybrid search with reranking."""
    held = collection.build(raw.etl_tables(s, d), fresh_path(s, "collection"), indexed=False)
    return held.search(table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))).select(SHOWN)


QUERIES = {"chunk_search": chunk_search}


def letters(text: str) -> str:
    return "[" + ", ".join(f"CAST(CAST((length({text}) - length(replace({text}, '{c}', ''))) / greatest(1, length({text})) AS FLOAT) AS DOUBLE)" for c in " aeinrst") + "]"


def searched(rows: str) -> str:
    """SQL of the search over rows (pmcid, source_type, section, chunk_index, text, pub_year, journal), the end of a WITH."""
    legs = search.WITH[search.WITH.index("dot AS") :].replace("v.label, ", "").replace("SELECT doc_id AS id, lang, source AS journal, unnest(", "SELECT id, unnest(").replace("id, lang, journal, ", "id, ").replace("FROM documents", "FROM c")
    return f"""c AS (SELECT *, row_number() OVER (ORDER BY pmcid, source_type, section, chunk_index) AS id FROM ({rows})),
v AS (SELECT id, {letters('text')} AS vec FROM c), q AS (SELECT item_id AS qid, text AS qtext, {letters('text')} AS qvec FROM benchmark WHERE {corpus.STRIP('text')} <> ''),
""" + legs + search.RRF.format(name="fused", n=40, k=20) + search.end(search.RERANK.replace("documents d ON d.doc_id", "c d ON d.id"))


YEAR, JOURNAL = "CAST(2015 + doc_id % 12 AS VARCHAR)", "coalesce(source, '')"
CHUNKS = f"""SELECT 'PMC' || doc_id AS pmcid, source_type, section, chunk_index, c.text, CASE WHEN status = 'fetched' THEN {YEAR} ELSE '' END AS pub_year, CASE WHEN status = 'fetched' THEN {JOURNAL} ELSE '' END AS journal FROM chunks c JOIN o ON c.pmcid = o.doc_id
  UNION ALL SELECT 'PMC' || doc_id, 'abstract', 'abstract', 0, {raw.ABSTRACT}, {YEAR}, {JOURNAL} FROM o WHERE status = 'fetched'"""
ORACLE_SQL = {
    "chunk_search": raw.JATS_CHUNKS + f", o AS ({raw.STATUS}), " + searched(CHUNKS) + "SELECT qid, CAST(rank AS INTEGER) AS rank, rerank_score, pmcid, source_type, section, chunk_index, pub_year, journal FROM reranked JOIN c USING (id) WHERE rank < 5",
}
