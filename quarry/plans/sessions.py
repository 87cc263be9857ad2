"""Session, context and label queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import memory
from quarry.operators import retrieval as R
from quarry.plans import search
from quarry.sources.tables import table


def messages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select("conv_id", "turn", "role", "text")


def found(s: SparkSession, d: str, n: int) -> DataFrame:
    hits = R.search(search.query_set(s, d), search.corpus(s, d), search.vectors(s, d), 20, n)
    return hits.join(search.corpus(s, d), "id", "left").withColumn("pub_year", (2015 + F.col("id") % 12).cast("string"))


def sentiment_summary(s: SparkSession, d: str) -> DataFrame:
    """Labels of documents by source; toxic ones stand for a negative label, unlabelled ones for an error."""
    l = table(s, d, "labels").select("doc_id", "quality", "toxic")  # noqa: E741
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
    rows = table(s, d, "documents").select("doc_id", "source").join(l, "doc_id", "left")
    return memory.label_summary(rows.select("source", F.col("doc_id").alias("pos"), label.alias("label"), F.when(F.col("quality").isNull(), "no label").alias("error")), "source")


def paper_detail(s: SparkSession, d: str) -> DataFrame:
    """The point lookup of one paper; missing texts are empty."""
    rows = table(s, d, "documents").filter("doc_id = 42")
    return rows.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])


QUERIES = {
    "recent_messages": lambda s, d: memory.recent(messages(s, d)),
    "summary_transcript": lambda s, d: memory.transcripts(messages(s, d)),
    "summary_transcript_cut": lambda s, d: memory.transcripts(messages(s, d), 2, 120, 300),
    "session_upsert": lambda s, d: memory.sessions(messages(s, d)),
    "session_lookup": lambda s, d: memory.sessions(messages(s, d)).filter("session_id = '7'"),
    "qa_context": lambda s, d: memory.context(found(s, d, 15), F.concat(F.col("id").cast("string"), F.lit(" / "), F.coalesce("journal", F.lit(""))), 15),
    "review_context": lambda s, d: memory.context(found(s, d, 20), F.concat(F.col("id").cast("string"), F.lit(" "), F.col("pub_year"), F.lit(" / "), F.coalesce("journal", F.lit(""))), 20),
    "sentiment_summary": sentiment_summary,
    "paper_detail": paper_detail,
}


def transcript_sql(keep: int, each: int, total: int) -> str:
    return f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
l AS (SELECT conv_id, i, '[' || role || ']: ' || substr(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), 1, {each}) AS line FROM m WHERE i <= n - {keep} AND trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''),
j AS (SELECT conv_id, substr(string_agg(line, chr(10) ORDER BY i), 1, {total}) AS t FROM l GROUP BY conv_id)
SELECT c.conv_id, coalesce(t, '{memory.NOTHING}') AS transcript FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN j ON c.conv_id = j.conv_id"""


LAST = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations)"
CONTEXT = search.end(search.HYBRID + search.RERANK) + "SELECT qid, string_agg('[' || {head} || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM reranked LEFT JOIN documents ON doc_id = id WHERE rank < {n} GROUP BY qid"
SESSIONS = f"WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(to_json(list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn, role, text)) AS VARCHAR) AS history, count(*) AS n_messages FROM {LAST} WHERE r <= 3 GROUP BY conv_id) "
ORACLE_SQL = {
    "recent_messages": f"SELECT conv_id, turn, role, text FROM {LAST} WHERE r <= 3",
    "summary_transcript": transcript_sql(3, 2000, 12000),
    "summary_transcript_cut": transcript_sql(2, 120, 300),
    "qa_context": CONTEXT.format(head="id || ' / ' || coalesce(source, '')", n=15),
    "review_context": CONTEXT.format(head="id || ' ' || (2015 + id % 12) || ' / ' || coalesce(source, '')", n=20),
    "sentiment_summary": """WITH r AS (SELECT source, d.doc_id AS pos, quality IS NULL AS error, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'unknown' END AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT source, label, count(*) AS c, min(pos) AS p FROM r WHERE NOT error GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, p) AS n FROM c)
SELECT r.source, count(*) AS total, count(*) FILTER (WHERE NOT error) AS valid, any_value(b.label) AS dominant, coalesce(any_value(b.c), 0) AS dominant_count FROM r LEFT JOIN b ON r.source = b.source AND b.n = 1 GROUP BY r.source""",
    "session_upsert": SESSIONS + "SELECT * FROM s",
    "session_lookup": SESSIONS + "SELECT * FROM s WHERE session_id = '7'",
    "paper_detail": "SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents WHERE doc_id = 42",
}
