"""Queries of raw records: fetching and resuming, files read and written, reprocessing, the whole pipeline. Stand-in answers and files are made from the tables by rules on the id."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import etl
from quarry.operators import chunking, fetch, markup, providers, records
from quarry.plans import corpus
from quarry.sources import paged, tables
from quarry.sources.shared import fresh_path
from quarry.sources.tables import table
from quarry.streaming import incremental


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def answers(s: SparkSession, d: str, attempt: int = 1) -> DataFrame:
    """What a remote answers for every document: some requests fail (at the first attempt, or always), some records are broken."""
    i = F.col("doc_id")
    mapped = table(s, d, "labels").select("doc_id", (F.col("doc_id") + 1000000).cast("string").alias("mapped"))
    own = F.when(i % 4 == 0, F.concat(F.lit("<article-id pub-id-type='pmid'> 9"), i.cast("string"), F.lit(" </article-id>"))).otherwise(F.lit(""))
    xml = F.concat(F.lit("<article><front><article-meta>"), own, F.lit("</article-meta></front></article>"))
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag.split()[0]}>"))
    record = F.concat(
        F.lit("<PubmedArticleSet><PubmedArticle>"),
        part("ArticleTitle", F.concat(F.lit("Of <i>"), F.col("lang"), F.lit("</i>"))),
        F.when(i % 2 == 0, part("AbstractText Label='AIM'", escaped(F.col("text")))).otherwise(part("AbstractText", escaped(F.col("text")))),
        part("AbstractText", F.col("source")),
        part("Author", part("ForeName", F.lit("Ada"))),
        part("Author", F.concat(part("LastName", F.concat(F.lit("L"), i.cast("string"))), F.when(i % 3 == 0, part("ForeName", F.lit("Bo"))).otherwise(F.lit("")))),
        part("Journal", part("Title", F.col("source"))),
        part("PubDate", part("Year", (2015 + i % 12).cast("string"))),
        part("ArticleDate", part("Month", (1 + i % 12).cast("string"))),
        F.when(i % 5 > 0, part("ArticleId IdType='doi'", F.concat(F.lit(" 10.1/"), i.cast("string")))).otherwise(F.lit("")),
        F.lit("</PubmedArticle></PubmedArticleSet>"),
    )
    return corpus.docs(s, d).join(mapped, "doc_id", "left").select(
        F.concat(F.lit("PMC"), i.cast("string")).alias("pmcid"),
        F.when((i % 6 == 0) & F.lit(attempt == 1), F.lit(None)).when(i % 6 == 1, "<error>no such id</error>").otherwise(xml).alias("xml"),
        "mapped",
        F.when((i % 7 == 0) & F.lit(attempt == 1), F.lit(None)).when(i % 7 == 1, "<broken").otherwise(record).alias("record_xml"),
    )


def fetch_outcomes(s: SparkSession, d: str) -> DataFrame:
    """What comes of every key at the first attempt, and the records of those fetched."""
    r = F.col("record")
    got = fetch.outcomes(answers(s, d))
    return got.select("pmcid", "outcome", "pmid", *[r[c].alias(c) for c in ("doi", "title", "abstract", "journal", "pub_year", "pub_month", "pub_day")], F.array_join(r["authors"], ", ").alias("authors"))


def fetch_resume(s: SparkSession, d: str) -> DataFrame:
    """Two runs over all keys: the second asks again for what is not final. Of each key its status and its number of attempts."""
    keys = corpus.docs(s, d).select(F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid"))
    log = s.createDataFrame([], "pmcid string, status string, attempt int")
    for attempt in (1, 2):
        wanted = fetch.todo(keys, log)
        log = fetch.logged(log, fetch.outcomes(answers(s, d, attempt).join(wanted, "pmcid", "left_semi")))
        log = tables.written(log, "fetched")
    return records.latest(log, "pmcid", "attempt").select("pmcid", "status", "attempt")


def documents_ids(s: SparkSession, d: str) -> DataFrame:
    return corpus.docs(s, d).select(F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid"))


def paged_source(s: SparkSession, d: str) -> DataFrame:
    """All ids through the paged data source; the search behind it holds the ids of all documents as pages in the shared folder."""
    path = fresh_path(s, "pages")
    tables.id_pages(s, documents_ids(s, d)).repartitionByRange("page").sortWithinPartitions("page", "pmcid").write.parquet(path)
    paged.register(s, "paged", lambda: StoredSearch(path))
    return s.read.format("paged").option("pause", 0).load()


class StoredSearch:
    """A search over pages of 200 ids in Parquet, of which a request reads the row groups that can hold its pages."""

    def __init__(self, path: str):
        import pyarrow.dataset as ds

        self.pages = ds.dataset(re.sub("^s3a:", "s3:", path), format="parquet")

    def total(self) -> int:
        return self.pages.count_rows()

    def page(self, start: int, size: int) -> list[str]:
        import pyarrow.dataset as ds

        first, last = start // 200, (start + size - 1) // 200
        ids = self.pages.to_table(["pmcid"], filter=(ds.field("page") >= first) & (ds.field("page") <= last)).column(0).to_pylist()
        return [i.removeprefix("PMC") for i in sorted(ids)[start - first * 200 :][:size]]


def id_cache(s: SparkSession, d: str) -> DataFrame:
    """The id list is searched once; what a later search would give is not asked for."""
    path = fresh_path(s, "ids")
    tables.cached_ids(s, path, lambda: documents_ids(s, d))
    return tables.cached_ids(s, path, lambda: documents_ids(s, d).limit(0))


def benchmark_records(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The benchmark as records, and as malformed JSON (pmcid, json)."""
    i = F.col("item_id")
    raw = table(s, d, "benchmark").select(
        F.concat(F.lit("B"), i.cast("string")).alias("pmcid"),
        F.when(i % 5 != 0, i.cast("string")).alias("pmid"),
        F.when(i % 13 == 0, " ").otherwise(F.col("text")).alias("title"),
        F.array(F.when(i % 11 == 0, "Erratum").otherwise("Journal Article")).alias("article_types"),
        (i % 7 == 3).alias("bad"),
    )
    return raw.filter("NOT bad").drop("bad"), raw.filter("bad").select("pmcid", F.concat(F.lit('{"pmcid": "'), F.col("pmcid")).alias("json"))


def statuses(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    valid, status = found
    return status.join(valid.select("pmcid", "title"), "pmcid", "left")


def metadata_scan(s: SparkSession, d: str) -> DataFrame:
    """The benchmark as one JSON file for each item, some malformed, read again: the status of each, and the titles of valid ones."""
    path, (good, bad) = fresh_path(s, "metadata"), benchmark_records(s, d)
    tables.write_metadata(good, path)
    tables.write_keyed(bad, path, "json")
    return statuses(tables.scanned(tables.read_metadata(s, path)))


def packed_metadata_scan(s: SparkSession, d: str) -> DataFrame:
    """The same from a packed store, in as many files as it has buckets."""
    path, (good, bad) = fresh_path(s, "packed"), benchmark_records(s, d)
    tables.pack(good.select("pmcid", F.to_json(F.struct("*")).alias("json")).unionByName(bad), path, "json", 16)
    return statuses(tables.scanned(tables.packed_metadata(tables.packed(s, path))))


def benchmark_markup(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The benchmark as markup (pmcid, xml), some malformed; and one item as it is written again."""
    i = F.col("item_id")
    body = F.concat(F.lit("<article><body><sec><title>S</title><p>"), escaped(F.col("text")), F.lit("</p>"))
    rows = table(s, d, "benchmark").select(F.concat(F.lit("B"), i.cast("string")).alias("pmcid"), F.concat(body, F.when(i % 9 == 4, "").otherwise("</sec></body></article>")).alias("xml"))
    return rows, rows.filter("pmcid = 'B1'").withColumn("xml", F.lit("<article><body><p>A text that was written again.</p></body></article>"))


def markup_scan(s: SparkSession, d: str) -> DataFrame:
    """The benchmark as one markup file for each item, some malformed, one written again, and all read again as paragraphs."""
    path = fresh_path(s, "markup")
    for rows in benchmark_markup(s, d):
        tables.write_fulltext(rows, path)
    return markup.exploded(markup.paragraphs(tables.read_markup(s, path)))


def packed_markup_scan(s: SparkSession, d: str) -> DataFrame:
    """The same from a packed store; what is written again takes its bucket's place alone."""
    path = fresh_path(s, "packed")
    for rows in benchmark_markup(s, d):
        tables.pack(rows, path, "xml", 16)
    return markup.exploded(markup.paragraphs(tables.packed_markup(tables.packed(s, path))))


def report_sink(s: SparkSession, d: str) -> DataFrame:
    """The parse scan's statuses as a report, written as JSON and read again."""
    path = fresh_path(s, "report")
    tables.write_report(corpus.scan(s, d).groupBy("status").agg(F.count("*").alias("n")), path)
    return s.read.schema("status string, n long").json(path)


def table_columns(s: SparkSession, d: str) -> DataFrame:
    """The columns of the tables that are made if absent; made twice, the second time as something else, which changes nothing."""
    name = f"quarry_{uuid.uuid4().hex}"
    try:
        tables.ensure_tables(s, name)
        tables.ensure_tables(s, name, dict.fromkeys(tables.TABLES, "other int"))
        rows = [(t, i, c.name, c.dataType) for t in tables.TABLES for i, c in enumerate(s.catalog.listColumns(f"{name}.{t}"))]
    finally:
        s.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    return s.createDataFrame(rows, "name string, pos int, column string, type string")


def failing(texts: list[str]) -> list[list[float]]:
    """The stand-in encoder of reprocessing: it refuses texts whose length is a multiple of 97."""
    if any(len(t) % 97 == 0 for t in texts):
        raise ValueError("refused")
    return providers.letters(texts)


def reprocess(s: SparkSession, d: str, dry_run: bool = False) -> DataFrame:
    """Papers that a report calls FAIL (every fifth document), half of whose files are there, some of these still empty."""
    i = F.col("doc_id")
    report = corpus.docs(s, d).select(i.alias("pmcid"), F.when(i % 5 == 0, "FAIL").otherwise("OK").alias("status"))
    files = corpus.jats(s, d).filter(i % 10 != 0).select(i.alias("pmcid"), F.when(i % 15 == 5, "<article><body><fig/></body></article>").otherwise(F.col("xml")).alias("xml"))
    papers = corpus.docs(s, d).select(i.alias("pmcid"), F.col("source").alias("journal"), (2015 + i % 12).cast("string").alias("pub_year"))
    return etl.reprocess(report, files, papers, failing, providers.term_weights, dry_run, batch=1, wait=0.0)


def embed_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks with both vectors of the stand-in encoders; here, the counts that the vectors tell."""
    rows = providers.embedded_both(chunking.chunks(corpus.with_paragraphs(s, d)), providers.letters, providers.term_weights, wait=0.0)
    long = lambda c: F.round(c).cast("long")
    tokens = F.aggregate("sparse.values", F.lit(0).cast("long"), lambda a, v: a + long(F.expm1(v)))
    found = F.aggregate("dense", F.lit(0).cast("long"), lambda a, v: a + long(v * F.col("n")))
    rows = rows.withColumn("n", F.length("text"))
    return rows.select("pmcid", "section", "chunk_index", F.size("sparse.indices").alias("n_terms"), F.array_min("sparse.indices").alias("least"), tokens.alias("tokens"), found.alias("letters"))


def question_set(s: SparkSession, d: str) -> DataFrame:
    """Questions of fifty sampled abstracts by the stand-in generator, with their known relevance."""
    some = corpus.docs(s, d).select(F.col("doc_id").alias("pmcid"), F.col("text").alias("abstract")).orderBy(F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string")))).limit(50)
    return providers.questions(some, providers.first_words)


def events_by_day(s: SparkSession, d: str) -> DataFrame:
    return incremental.totals(table(s, d, "events").select("ts", "event_type")).select(F.col("day").cast("date").cast("string").alias("day"), "event_type", "n")


def etl_tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables that every stage leaves, from the raw answers for all documents."""
    given = answers(s, d, 2).drop("xml").join(corpus.jats(s, d).select(F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid"), "xml"), "pmcid")
    return etl.run(s, given, fresh_path(s, "etl"), providers.letters, providers.term_weights, wait=0.0)


def etl_run(s: SparkSession, d: str) -> DataFrame:
    """Every stage from raw answers to vector rows, over all documents; the rows of each table it leaves."""
    return etl.summary(s, etl_tables(s, d))


QUERIES = {
    "fetch_outcomes": fetch_outcomes, "fetch_resume": fetch_resume, "id_pages": lambda s, d: tables.id_pages(s, documents_ids(s, d)), "paged_source": paged_source, "id_cache": id_cache, "metadata_scan": metadata_scan, "markup_scan": markup_scan, "packed_metadata_scan": packed_metadata_scan, "packed_markup_scan": packed_markup_scan,
    "report_sink": report_sink, "table_columns": table_columns, "reprocess_dry_run": lambda s, d: reprocess(s, d, True), "reprocess_failed": reprocess, "embed_chunks": embed_chunks,
    "question_set": question_set, "events_by_day": events_by_day, "etl_run": etl_run,
}

JATS_PARAGRAPHS = f"{corpus.JATS_SQL}, p AS (SELECT doc_id, section, {corpus.STRIP('text')} AS t, pos AS i, type <> 'paragraph' AS caption FROM parsed)"
JATS_CHUNKS = corpus.chunk_sql(3200, 80, JATS_PARAGRAPHS)


def answered_sql(attempt: int) -> str:
    """(doc_id, ok, pmid, can be had, can be read) of every document's answers."""
    first = "true" if attempt == 1 else "false"
    return f"""SELECT d.*, NOT (doc_id % 6 = 0 AND {first}) AND doc_id % 6 <> 1 AS ok, coalesce(CAST(l + 1000000 AS VARCHAR), CASE WHEN doc_id % 4 = 0 THEN '9' || doc_id END) AS pmid_of,
  NOT (doc_id % 7 = 0 AND {first}) AND doc_id % 7 <> 1 AS read FROM documents d LEFT JOIN (SELECT DISTINCT doc_id AS l FROM labels) ON d.doc_id = l"""


OUTCOME = "CASE WHEN NOT ok THEN 'failed' WHEN pmid_of IS NULL THEN 'no_pmid' WHEN NOT read THEN 'failed' ELSE 'fetched' END"
STATUS = "SELECT *, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'no_pmid' WHEN doc_id % 7 = 1 THEN 'failed' ELSE 'fetched' END AS status FROM documents"
STRIPPED = corpus.STRIP("text")
ABSTRACT = f"CASE WHEN {STRIPPED} <> '' THEN (CASE WHEN doc_id % 2 = 0 THEN 'AIM: ' ELSE '' END) || {STRIPPED} || chr(10) ELSE '' END || source"
ORACLE_SQL = {
    "fetch_outcomes": f"""WITH a AS ({answered_sql(1)}), o AS (SELECT *, {OUTCOME} AS outcome FROM a), f AS (SELECT *, outcome = 'fetched' AS f FROM o)
SELECT 'PMC' || doc_id AS pmcid, outcome, CASE WHEN ok THEN pmid_of END AS pmid, CASE WHEN f THEN CASE WHEN doc_id % 5 > 0 THEN '10.1/' || doc_id ELSE '' END END AS doi, CASE WHEN f THEN 'Of ' || lang END AS title, CASE WHEN f THEN {ABSTRACT} END AS abstract,
  CASE WHEN f THEN source END AS journal, CASE WHEN f THEN CAST(2015 + doc_id % 12 AS VARCHAR) END AS pub_year, CASE WHEN f THEN CAST(1 + doc_id % 12 AS VARCHAR) END AS pub_month, CASE WHEN f THEN '' END AS pub_day,
  CASE WHEN f THEN CASE WHEN doc_id % 3 = 0 THEN 'Bo ' ELSE '' END || 'L' || doc_id END AS authors FROM f""",
    "fetch_resume": f"""WITH a AS (SELECT doc_id, {OUTCOME} AS o FROM ({answered_sql(1)})), b AS (SELECT doc_id, {OUTCOME} AS o FROM ({answered_sql(2)}))
SELECT 'PMC' || a.doc_id AS pmcid, CASE WHEN a.o = 'failed' THEN b.o ELSE a.o END AS status, CASE WHEN a.o = 'failed' THEN 2 ELSE 1 END AS attempt FROM a JOIN b ON a.doc_id = b.doc_id""",
    "id_pages": "SELECT (row_number() OVER (ORDER BY pmcid) - 1) // 200 AS page, pmcid FROM (SELECT DISTINCT 'PMC' || doc_id AS pmcid FROM documents)",
    "id_cache": "SELECT 'PMC' || doc_id AS pmcid FROM documents",
    "metadata_scan": f"""WITH r AS (SELECT 'B' || item_id AS pmcid, CASE WHEN item_id % 7 = 3 THEN 'parse_error' WHEN item_id % 5 = 0 THEN 'no_pmid' WHEN item_id % 11 = 0 THEN 'article_types_invalid' WHEN item_id % 13 = 0 OR {corpus.STRIP('text')} = '' THEN 'no_title' ELSE 'valid' END AS status, text FROM benchmark)
SELECT pmcid, status, CASE WHEN status = 'valid' THEN text END AS title FROM r""",
    "markup_scan": f"""WITH r AS (SELECT 'B' || item_id AS pmcid, CASE WHEN item_id = 1 THEN 'body' ELSE 'S' END AS section, CASE WHEN item_id = 1 THEN 'A text that was written again.' ELSE {corpus.COLLAPSE('text')} END AS text FROM benchmark WHERE item_id % 9 <> 4)
SELECT pmcid, CAST(0 AS INTEGER) AS pos, section, text, 'paragraph' AS type FROM r WHERE length(text) >= 20""",
    "report_sink": corpus.SCAN + "SELECT status, count(*) AS n FROM scan GROUP BY status",
    "table_columns": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', CAST({i} AS INTEGER), '{c.split(' ', 1)[0]}', '{c.split(' ', 1)[1].removesuffix(' not null').replace(': ', ':').replace(', ', ',')}')" for t, columns in tables.TABLES.items() for i, c in enumerate(tables.columns_of(columns))) + ") AS c(name, pos, \"column\", type)",
    "reprocess_dry_run": "SELECT doc_id AS pmcid, doc_id % 10 <> 0 AS present FROM documents WHERE doc_id % 5 = 0",
    "reprocess_failed": JATS_CHUNKS + """, c AS (SELECT pmcid, count(*) AS n, count(*) FILTER (WHERE length(text) % 97 <> 0) AS w FROM chunks GROUP BY pmcid)
SELECT doc_id AS pmcid, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 15 = 5 OR n IS NULL THEN 'still_empty' WHEN w < n THEN 'embed_failed' ELSE 'success' END AS outcome,
  CASE WHEN doc_id % 10 = 0 OR doc_id % 15 = 5 THEN 0 ELSE coalesce(n, 0) END AS n_chunks, CASE WHEN doc_id % 10 = 0 OR doc_id % 15 = 5 THEN 0 ELSE coalesce(w, 0) END AS n_written FROM documents LEFT JOIN c ON c.pmcid = doc_id WHERE doc_id % 5 = 0""",
    "embed_chunks": corpus.chunk_sql(3200, 80) + """, t AS (SELECT pmcid, section, chunk_index, term, count(*) AS n FROM (SELECT *, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM chunks) GROUP BY ALL),
h AS (SELECT pmcid, section, chunk_index, CAST(('0x' || substr(md5(term), 1, 7)) AS INTEGER) AS i, n FROM t), g AS (SELECT pmcid, section, chunk_index, CAST(count(DISTINCT i) AS INTEGER) AS n_terms, min(i) AS least, CAST(sum(n) AS BIGINT) AS tokens FROM h GROUP BY ALL)
SELECT c.pmcid, c.section, c.chunk_index, coalesce(n_terms, 0) AS n_terms, least, coalesce(tokens, 0) AS tokens, CAST(length(text) - length(regexp_replace(text, '[ aeinrst]', '', 'g')) AS BIGINT) AS letters
FROM chunks c LEFT JOIN g ON c.pmcid = g.pmcid AND c.section = g.section AND c.chunk_index = g.chunk_index""",
    "question_set": f"""WITH s AS (SELECT doc_id AS pmcid, text, string_split({corpus.COLLAPSE('substr(text, 1, 1500)')}, ' ') AS w FROM documents ORDER BY md5('42|' || doc_id) LIMIT 50), q(pos, a, b, intent) AS (VALUES (0, 1, 5, 'mechanism'), (1, 3, 6, 'treatment'))
SELECT pmcid, pos, array_to_string(w[a:b], ' ') AS query, intent, 2 AS relevance, substr(text, 1, 300) AS source_abstract FROM s CROSS JOIN q WHERE len(w) >= 5""",
    "events_by_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "etl_run": JATS_CHUNKS + f""", o AS ({STATUS})
SELECT 'papers' AS name, count(*) FILTER (WHERE status = 'fetched') AS n FROM o UNION ALL SELECT 'abstract chunks', count(*) FILTER (WHERE status = 'fetched') FROM o
UNION ALL SELECT 'fulltext chunks', count(*) FROM (SELECT DISTINCT pmcid, substr(replace(lower(section), ' ', '_'), 1, 30) AS section, chunk_index FROM chunks) c JOIN o ON c.pmcid = o.doc_id
UNION ALL SELECT 'status ' || status, count(*) FROM o GROUP BY ALL""",
}
ORACLE_SQL["paged_source"] = ORACLE_SQL["id_pages"]
ORACLE_SQL |= {f"packed_{name}": ORACLE_SQL[name] for name in ("metadata_scan", "markup_scan")}
