"""Text, chunking, record and table queries. Raw records are derived from `documents` by rules on the id, so every branch occurs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, markup, records
from quarry.operators import metrics as M
from quarry.operators import retrieval as R
from quarry.sources.tables import table

WS = T.WS


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", "lang", "source")


def raw_records(s: SparkSession, d: str) -> DataFrame:
    """Raw metadata: pmids, types, titles and dates that meet every rule for some ids."""
    i = F.col("doc_id")
    kinds = F.when(i % 13 == 0, F.array(F.lit("Journal Article"), F.lit("Erratum"))).when(i % 17 == 0, F.array(F.lit("Retraction of Publication"))).otherwise(F.array(F.lit("Journal Article")))
    months = ["Jan", "2", "12", "Winter", "", "13", "Sept", "06", "september", "0"]
    return docs(s, d).select(
        F.concat(F.lit("PMC"), i.cast("string")).alias("pmcid"),
        F.when(i % 11 != 0, i.cast("string")).alias("pmid"),
        (i % 23 == 0).alias("no_pubmed_record"),
        F.when(i % 19 == 0, "  ").otherwise(F.col("text")).alias("title"),
        F.col("text").alias("abstract"),
        F.lit("").alias("doi"),
        F.col("source").alias("journal"),
        F.when(i % 29 == 0, "").otherwise((2015 + i % 12).cast("string")).alias("pub_year"),
        F.element_at(F.array(*[F.lit(m) for m in months]), (i % 10 + 1).cast("int")).alias("pub_month"),
        F.when(i % 5 == 0, "").otherwise((i % 33).cast("string")).alias("pub_day"),
        F.array(F.col("lang")).alias("authors"),
        F.array(F.col("lang"), F.col("source")).alias("keywords"),
        kinds.alias("article_types"),
    )


def with_paragraphs(s: SparkSession, d: str) -> DataFrame:
    """documents as (pmcid, paragraphs): a line is a paragraph, sections go by turns, every seventh is a caption."""
    names = F.array(*[F.lit(x) for x in ("1. Introduction", "Methods", "3.1 Results")])
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.element_at(names, i % 3 + 1).alias("section"), t.alias("text"), F.when(i % 7 == 6, "figure_caption").otherwise("paragraph").alias("type")))
    return docs(s, d).select(F.col("doc_id").alias("pmcid"), lines.alias("paragraphs"))


def text_normalize(s: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit("  \t"), F.col("text"), F.lit(" \n"))
    return docs(s, d).select("doc_id", T.collapse(padded).alias("normal"), F.length(T.strip(padded)).alias("stripped_length"), T.words_in(F.col("text")).alias("n_words"))


def sentence_split(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def section_skip(s: SparkSession, d: str) -> DataFrame:
    names = [*T.SKIPPED, "Supplementary Material", " Funding ", "Introduction", "REFERENCES", "2. Methods", ""]
    title = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    return docs(s, d).select("doc_id", title.alias("title"), T.skipped_section(title).alias("skipped"), T.slug(title).alias("slug"), T.strip_numbering(title).alias("plain"))


def pub_dates(s: SparkSession, d: str) -> DataFrame:
    return raw_records(s, d).select("pmcid", "pub_year", "pub_month", "pub_day", T.pub_date(F.col("pub_year"), F.col("pub_month"), F.col("pub_day")).cast("string").alias("pub_date"))


def garbage_flags(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", T.garbage(F.col("text")).alias("garbage"))


def papers_table(s: SparkSession, d: str) -> DataFrame:
    return records.papers(raw_records(s, d)).select("pmcid", "pmid", "doi", "title", "journal", "pub_year", "pub_month", "pub_day", "abstract", F.col("pub_date").cast("string").alias("pub_date"))


def chunk_index(s: SparkSession, d: str) -> DataFrame:
    """Ids of all chunks: no two may be equal."""
    c = chunking.chunks(with_paragraphs(s, d), 3200, 80)
    ident = T.point_id(F.col("pmcid"), F.col("source_type"), F.col("section"), F.col("chunk_index"))
    return c.select("pmcid", "section", "chunk_index", F.length("text").alias("n_chars"), ident.alias("point_id"))


def meta_lookup_join(s: SparkSession, d: str) -> DataFrame:
    """Line items with their order's priority and date as text; by order, at volume."""
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority", F.date_format("o_orderdate", "yyyy").alias("o_year"))
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber")
    return records.lookup(rows, orders, "key", ["o_orderpriority", "o_year"]).groupBy("o_orderpriority", "o_year").agg(F.count("*").alias("n"))


def payload_backfill(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("lang"))
    return records.backfill(rows, docs(s, d).select(F.col("doc_id").alias("id"), F.nullif("lang", F.lit("es")).alias("lang")), "id", "lang")


def papers_upsert(s: SparkSession, d: str) -> DataFrame:
    """Customers' latest orders: of each key the last writer's row."""
    rows = table(s, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderdate", "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    return records.latest(rows, "custkey", "o_orderdate", "o_orderkey")


def table_upsert(s: SparkSession, d: str) -> DataFrame:
    old = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    new = table(s, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("value"))
    return records.upsert(old, new, "key")


def pending_anti_join(s: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order that is still open: some have one, some don't."""
    done = table(s, d, "orders").filter("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey"))
    return records.pending(table(s, d, "customer").select(F.col("c_custkey").alias("custkey")), done, "custkey")


def event_log(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("user_id", "ts", "event_id", "event_type")


def progress_state(s: SparkSession, d: str) -> DataFrame:
    return records.states(event_log(s, d), "user_id", "event_type", "ts", "event_id")


def status_move(s: SparkSession, d: str) -> DataFrame:
    """Keys whose latest state is an error go back to pending if they ever bought something."""
    state = progress_state(s, d)
    bought = event_log(s, d).filter("event_type = 'purchase'").select("user_id")
    back = state.filter("status = 'error'").join(bought, "user_id", "left_semi")
    return records.move(state, "user_id", back, "pending").groupBy("status").agg(F.count("*").alias("n"))


def vector_completeness(s: SparkSession, d: str) -> DataFrame:
    """Documents by language: with a vector, and without (to be embedded again)."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs(s, d).join(v, "doc_id", "left").groupBy("lang").agg(F.count("embedding").alias("complete"), F.sum(F.col("embedding").isNull().cast("long")).alias("failed"))


def vector_upsert(s: SparkSession, d: str) -> DataFrame:
    """Chunk rows with vectors, of every document that has one; of rows with equal ids the later stays."""
    rows = docs(s, d).join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label"), "doc_id", "left")
    section = F.concat(F.lit("A section title of thirty chars: "), F.col("source"))
    rows = rows.select(F.col("doc_id").alias("pmcid"), F.lit("fulltext").alias("source_type"), section.alias("section"), F.lit(0).alias("chunk_index"), F.col("embedding").alias("dense"), F.col("label").alias("sparse"), F.col("doc_id").alias("seq"))
    return records.points(rows).select("id", "pmcid", "seq", "sparse")


def payload_scan(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).filter("lang = 'de'").select("doc_id", "lang", F.col("source").alias("journal"))


def existence_split(s: SparkSession, d: str) -> DataFrame:
    """Toxic documents with and without a vector."""
    want, have = table(s, d, "labels").filter("toxic = 1").select("doc_id"), table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    there = want.join(have, "doc_id", "left_semi").withColumn("present", F.lit(True))
    return there.unionByName(want.join(have, "doc_id", "left_anti").withColumn("present", F.lit(False)))


def id_mapping(s: SparkSession, d: str) -> DataFrame:
    """A mapped id where there is one, else the record's own, else null."""
    own = raw_records(s, d).select("pmcid", "pmid")
    mapped = table(s, d, "labels").select(F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid"), (F.col("doc_id") + 1000000).cast("string").alias("mapped"))
    return own.join(mapped, "pmcid", "left").select("pmcid", F.coalesce("mapped", "pmid").alias("pmid"))


def health_distribution(s: SparkSession, d: str) -> DataFrame:
    """Counts by source type (here: language) and the eight latest years."""
    rows = raw_records(s, d).select("pub_year", F.element_at("authors", 1).alias("lang"))
    by_lang = rows.groupBy("lang").agg(F.count("*").alias("n")).select(F.lit("lang").alias("kind"), F.col("lang").alias("value"), "n")
    by_year = rows.groupBy("pub_year").agg(F.count("*").alias("n")).orderBy(F.col("pub_year").desc()).limit(8).select(F.lit("year").alias("kind"), F.col("pub_year").alias("value"), "n")
    return by_lang.unionByName(by_year)


def scan(s: SparkSession, d: str) -> DataFrame:
    """One row for each document: paragraphs, chunks, mean chunk length, core sections that are missing, status. Worked out within the row."""
    rows = with_paragraphs(s, d).withColumn("chunks", chunking.chunked(F.col("paragraphs")))
    # Each step is a column of its own and is used more than once, so that none is worked out again for each core section.
    rows = rows.withColumn("sections", F.transform(F.filter("paragraphs", lambda x: F.length(T.collapse(x["text"])) >= 20), lambda x: x["section"]))
    rows = rows.withColumn("found", F.transform(F.array_distinct("sections"), lambda x: T.strip(F.lower(T.strip_numbering(x)))))
    core = ["discussion", "introduction", "methods", "results"]
    has = lambda name: F.exists("found", lambda y: F.contains(y, F.lit(name)))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    chars = F.coalesce(F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + F.length(c["text"])), F.lit(0).cast("long"))
    rows = rows.select(
        "pmcid",
        F.size("sections").alias("para_count"),
        count("chunks").alias("chunk_count"),
        F.coalesce(F.bround(chars / F.nullif(count("chunks"), F.lit(0).cast("long"))).cast("long"), F.lit(0).cast("long")).alias("avg_chunk_len"),
        F.concat_ws(",", *[F.when(~has(x), F.lit(x)) for x in core]).alias("missing_core"),
        count(F.filter("chunks", lambda c: T.garbage(c["text"]))).alias("garbage_count"),
    )
    return rows.withColumn("status", M.paper_status(F.col("para_count"), F.col("garbage_count")))


def chunk_len_percentiles(s: SparkSession, d: str) -> DataFrame:
    return M.by_index(scan(s, d).filter("avg_chunk_len > 0"), "avg_chunk_len", {"median": (1, 2), "p10": (1, 10), "p90": (9, 10)})


def missing_sections(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d).select(F.explode(F.split("missing_core", ",")).alias("section")).filter("section <> ''").groupBy("section").agg(F.count("*").alias("n"))


def seeded_sample(s: SparkSession, d: str) -> DataFrame:
    """Fifty documents in the order of a seeded hash: the sampling operator."""
    return docs(s, d).select("doc_id", F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string"))).alias("h")).orderBy("h").limit(50)


def jats(s: SparkSession, d: str) -> DataFrame:
    """documents as full-text markup: the first line is a paragraph of the body, the others go by turns through what a section holds."""
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def part(t: Column, i: Column) -> Column:
        put = lambda form: F.concat(*[y for x in re.split("([@#])", form) for y in [t if x == "@" else i.cast("string") if x == "#" else F.lit(x)]])
        out = F.when(i == 0, put("<p>@</p><sec><title>Main <i>part</i></title>"))
        for k, form in enumerate(FORMS):
            out = out.when(i % len(FORMS) == k, put(form))
        return out

    body = F.array_join(F.transform(F.split(safe, "\n"), part), "")
    return docs(s, d).select("doc_id", F.concat(F.lit("<article><body>"), body, F.lit("</sec><sec><title>References</title><sec><p>A reference that is left out.</p></sec></sec></body></article>")).alias("xml"))


#: What line number # with the text @ becomes, by turns.
FORMS = [
    "<p>@</p>",
    "<sec><p>@</p></sec>",
    "<sec><title>Sub #</title><p>@</p></sec>",
    "<fig><caption><p>@</p></caption></fig>",
    "<table-wrap><caption><title>T. </title><p>@</p></caption></table-wrap>",
    "<list><list-item><p>@</p><list><list-item><p>nested @</p></list-item></list></list-item></list>",
    "<p>@<b>lost</b><list><list-item><p>inner <i>x</i> @</p></list-item></list>tail</p>",
    "<boxed-text><p>left out @</p></boxed-text>",
]


def jats_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return markup.exploded(markup.paragraphs(jats(s, d)))


def pages_paragraphs(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "pages").select("page_id", F.col("html").alias("xml"))
    return markup.exploded(markup.paragraphs(pages, parse=markup.parse_page))


def damaged(s: SparkSession, d: str) -> DataFrame:
    """Full texts of documents, seven of eight of them damaged by a rule on the id in one of the ways that diagnosis tells apart."""
    forms = [None, "<article><body>", "<article><front/></article>", "<article xmlns='u'><body><sec><p>A long enough text, in a name space.</p></sec></body></article>", "<article><body><fig/></body></article>", "<article><body><p>short</p></body></article>", "<article><body><sec><p>short</p></sec></body></article>"]
    xml = F.col("xml")
    for k, form in enumerate(forms):
        xml = F.when(F.col("doc_id") % 8 == k, F.lit(form).cast("string")).otherwise(xml)
    return jats(s, d).withColumn("xml", xml)


def fail_diagnosis(s: SparkSession, d: str) -> DataFrame:
    """Of the full texts without a paragraph: why, how many, and the first three as examples."""
    rows = damaged(s, d).select("doc_id", "xml", F.size(markup.column(markup.parse_fulltext, markup.PARAGRAPHS)("xml")).alias("n"))
    failed = rows.withColumn("status", M.paper_status(F.col("n"), F.lit(0))).filter("status = 'FAIL'")
    reasons = failed.select("doc_id", markup.column(markup.diagnose, "string")(F.col("xml")).alias("reason"))
    first = R.top(reasons, 3, F.col("doc_id"), by="reason").groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("examples"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n")).join(first, "reason")


def embeddings_grouped(s: SparkSession, d: str) -> DataFrame:
    """Payload updates batched by what they set: of each (language, source) the ids in lists of at most 500; here, what the lists hold."""
    lists = records.update_groups(docs(s, d).select("doc_id", "lang", "source"), "doc_id", ["lang", "source"])
    k = F.col("keys")
    return lists.groupBy("lang", "source").agg(F.sum(F.size(k)).alias("n"), F.min(F.array_min(k)).alias("least"), F.max(F.array_max(k)).alias("greatest"), F.sum(F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"), (F.max(F.size(k)) <= 500).alias("bounded"))


def failed_keys(s: SparkSession, d: str) -> DataFrame:
    """The distinct sources of documents of which some lack a vector, to be embedded again."""
    rows = docs(s, d).join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return records.failed(rows, "doc_id", "embedding")


QUERIES = {
    "text_normalize": text_normalize, "sentence_split": sentence_split, "section_skip": section_skip, "pub_date_parse": pub_dates, "garbage_flags": garbage_flags,
    "record_validity": lambda s, d: raw_records(s, d).select("pmcid", records.validity().alias("status")), "papers_table": papers_table,
    "chunk_fulltext": lambda s, d: chunking.chunks(with_paragraphs(s, d)), "chunk_fulltext_small": lambda s, d: chunking.chunks(with_paragraphs(s, d), 400, 80), "chunk_index": chunk_index,
    "abstract_chunks": lambda s, d: chunking.abstract_chunks(raw_records(s, d)), "point_id": lambda s, d: docs(s, d).select("doc_id", T.point_id(F.col("doc_id"), F.lit("abstract"), F.col("source"), F.lit(0)).alias("id")),
    "meta_lookup_join": meta_lookup_join, "payload_backfill": payload_backfill, "papers_upsert": papers_upsert, "table_upsert": table_upsert, "pending_anti_join": pending_anti_join,
    "progress_state": progress_state, "status_move": status_move, "vector_completeness": vector_completeness, "vector_upsert": vector_upsert, "payload_scan": payload_scan,
    "existence_split": existence_split, "id_mapping": id_mapping, "health_distribution": health_distribution, "parse_scan_status": scan, "chunk_len_percentiles": chunk_len_percentiles,
    "missing_sections": missing_sections, "seeded_sample": seeded_sample, "jats_paragraphs": jats_paragraphs, "pages_paragraphs": pages_paragraphs, "fail_diagnosis": fail_diagnosis,
    "update_groups": embeddings_grouped, "failed_keys": failed_keys,
}

STRIP = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
COLLAPSE = lambda c: STRIP(f"regexp_replace({c}, '{WS}+', ' ', 'g')")
UUID5 = """(SELECT concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', CAST(strpos('0123456789abcdef', substr(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)))"""
POINT = lambda name: f"sha1(unhex('{T.NAMESPACE_HEX}') || encode({name}))"
RAW = """
WITH raw AS (SELECT doc_id, 'PMC' || doc_id AS pmcid, CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id AS VARCHAR) END AS pmid, doc_id % 23 = 0 AS no_pubmed_record, CASE WHEN doc_id % 19 = 0 THEN '  ' ELSE text END AS title,
  text AS abstract, source AS journal, CASE WHEN doc_id % 29 = 0 THEN '' ELSE CAST(2015 + doc_id % 12 AS VARCHAR) END AS pub_year,
  (['Jan', '2', '12', 'Winter', '', '13', 'Sept', '06', 'september', '0'])[doc_id % 10 + 1] AS pub_month, CASE WHEN doc_id % 5 = 0 THEN '' ELSE CAST(doc_id % 33 AS VARCHAR) END AS pub_day, lang FROM documents),
dated AS (SELECT *, CASE WHEN regexp_matches(pub_month, '^[0-9]{1,2}$') THEN CAST(pub_month AS INTEGER) ELSE CASE lower(substr(pub_month, 1, 3)) WHEN 'jan' THEN 1 WHEN 'sep' THEN 9 END END AS m,
  CASE WHEN pub_day = '' THEN 1 ELSE least(CAST(pub_day AS INTEGER), 28) END AS dd FROM raw),
dates AS (SELECT *, CASE WHEN pub_year <> '' AND m BETWEEN 1 AND 12 AND dd >= 1 THEN make_date(CAST(pub_year AS INTEGER), m, dd) END AS pub_date,
  CASE WHEN no_pubmed_record OR pmid IS NULL THEN 'no_pmid' WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'article_types_invalid' WHEN trim(title) = '' THEN 'no_title' ELSE 'valid' END AS status FROM dated)
"""
NULLED = lambda c: f"nullif({STRIP(c)}, '') AS {c}"


LINES = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, (['1. Introduction', 'Methods', '3.1 Results'])[i % 3 + 1] AS section, {STRIP('t')} AS t, i, i % 7 = 6 AS caption FROM lines)"""


def chunk_sql(limit: int, least: int, paragraphs: str = LINES) -> str:
    """Units (paragraphs; sentences of those over the limit) in runs that cannot be merged across; a recursive walk numbers chunks."""
    return f"""
WITH RECURSIVE {paragraphs},
body AS (SELECT *, CASE WHEN length(t) > {limit} THEN 1 ELSE 0 END AS big FROM p WHERE NOT caption AND t <> ''),
run AS (SELECT *, sum(big) OVER w * 2 - big AS r FROM body WINDOW w AS (PARTITION BY doc_id, section ORDER BY i ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT doc_id, section, r, i, CASE WHEN big = 1 THEN string_split(regexp_replace(t, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)) ELSE [t] END AS us FROM run),
unit AS (SELECT doc_id, section, r, i, unnest(us) AS u, generate_subscripts(us, 1) AS j FROM cut),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section, r ORDER BY i, j) AS n FROM unit),
walk AS (SELECT doc_id, section, r, n, length(u) AS cur, 0 AS k FROM numbered WHERE n = 1
  UNION ALL SELECT b.doc_id, b.section, b.r, b.n, CASE WHEN a.cur + length(b.u) + 1 <= {limit} THEN a.cur + length(b.u) + 1 ELSE length(b.u) END, CASE WHEN a.cur + length(b.u) + 1 <= {limit} THEN a.k ELSE a.k + 1 END
  FROM walk a JOIN numbered b ON a.doc_id = b.doc_id AND a.section = b.section AND a.r = b.r AND b.n = a.n + 1),
chunk AS (SELECT w.doc_id, w.section, 0 AS kind, w.r, w.k, string_agg(b.u, ' ' ORDER BY b.n) AS text FROM walk w JOIN numbered b ON w.doc_id = b.doc_id AND w.section = b.section AND w.r = b.r AND w.n = b.n GROUP BY w.doc_id, w.section, w.r, w.k
  UNION ALL SELECT doc_id, section, 1, i, 0, t FROM p WHERE caption),
chunks AS (SELECT doc_id AS pmcid, 'fulltext' AS source_type, section, CAST(row_number() OVER (PARTITION BY doc_id, section ORDER BY kind, r, k) - 1 AS INTEGER) AS chunk_index, text FROM chunk WHERE length(text) >= {least})
"""


GARBAGE = "(length({c}) <= 400 AND (length({c}) - length(replace({c}, ';', '')) > 3 OR (regexp_matches({c}, '[a-z][A-Z][a-z]') AND CASE WHEN {n} = '' THEN 0 ELSE len(string_split({n}, ' ')) END < 5)))"
SCAN = (
    chunk_sql(3200, 80)
    + f""", good AS (SELECT pmcid, count(*) AS chunk_count, avg(length(text)) AS mean, count(*) FILTER (WHERE {GARBAGE.format(c='text', n=COLLAPSE('text'))}) AS garbage_count FROM chunks GROUP BY pmcid),
paras AS (SELECT doc_id AS pmcid, count(*) FILTER (WHERE length({COLLAPSE('t')}) >= 20) AS para_count,
  concat_ws(',', 'discussion', CASE WHEN count(*) FILTER (WHERE section = '1. Introduction' AND length({COLLAPSE('t')}) >= 20) = 0 THEN 'introduction' END, CASE WHEN count(*) FILTER (WHERE section = 'Methods' AND length({COLLAPSE('t')}) >= 20) = 0 THEN 'methods' END,
  CASE WHEN count(*) FILTER (WHERE section = '3.1 Results' AND length({COLLAPSE('t')}) >= 20) = 0 THEN 'results' END) AS missing_core FROM p GROUP BY doc_id),
scan AS (SELECT a.pmcid, CAST(para_count AS INTEGER) AS para_count, coalesce(chunk_count, 0) AS chunk_count, CAST(round_even(coalesce(mean, 0), 0) AS BIGINT) AS avg_chunk_len, missing_core, coalesce(garbage_count, 0) AS garbage_count,
  CASE WHEN para_count = 0 THEN 'FAIL' WHEN para_count < 5 THEN 'SPARSE' WHEN coalesce(garbage_count, 0) > 0 THEN 'GARBAGE' ELSE 'OK' END AS status FROM paras a LEFT JOIN good b ON a.pmcid = b.pmcid)
"""
)
#: Rows of `jats`: (line i, part j, section, text, type); what is shorter than 20 characters is left out before it is numbered.
JATS_SQL = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
forms AS (SELECT doc_id, i, 0 AS j, CASE WHEN i = 0 THEN 'body' WHEN i % 8 = 2 THEN 'Sub ' || i ELSE 'Main part' END AS section,
    CASE WHEN i > 0 AND i % 8 = 4 THEN {COLLAPSE("('T. ' || t)")} WHEN i > 0 AND i % 8 = 6 THEN {STRIP('t')} ELSE {COLLAPSE('t')} END AS text,
    CASE WHEN i = 0 THEN 'paragraph' WHEN i % 8 = 3 THEN 'figure_caption' WHEN i % 8 = 4 THEN 'table_caption' ELSE 'paragraph' END AS type FROM lines WHERE i = 0 OR i % 8 <> 7
  UNION ALL SELECT doc_id, i, 1, 'Main part', {COLLAPSE("('nested ' || t)")}, 'paragraph' FROM lines WHERE i > 0 AND i % 8 = 5
  UNION ALL SELECT doc_id, i, 1, 'Main part', {COLLAPSE("('inner x ' || t)")}, 'paragraph' FROM lines WHERE i > 0 AND i % 8 = 6),
parsed AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS pos, section, text, type FROM forms WHERE length(text) >= 20)"""
NAMES = ", ".join(f"'{x}'" for x in [*T.SKIPPED, "Supplementary Material", " Funding ", "Introduction", "REFERENCES", "2. Methods", ""])

ORACLE_SQL = {
    "text_normalize": f"WITH t AS (SELECT doc_id, text, chr(160) || ' ' || chr(9) || text || chr(8195) || chr(10) AS p FROM documents) SELECT doc_id, {COLLAPSE('p')} AS normal, CAST(length({STRIP('p')}) AS INTEGER) AS stripped_length, CAST(CASE WHEN {COLLAPSE('text')} = '' THEN 0 ELSE len(string_split({COLLAPSE('text')}, ' ')) END AS INTEGER) AS n_words FROM t",
    "sentence_split": f"WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents) SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS sentence FROM s",
    "section_skip": f"WITH t AS (SELECT doc_id, ([{NAMES}])[doc_id % {len(T.SKIPPED) + 6} + 1] AS title FROM documents) SELECT doc_id, title, trim(lower(title)) IN ({', '.join(repr(x) for x in T.SKIPPED)}) AS skipped, substr(replace(lower(title), ' ', '_'), 1, 30) AS slug, regexp_replace(title, '^[0-9]+[.\\s]*', '') AS plain FROM t",
    "pub_date_parse": RAW + "SELECT pmcid, pub_year, pub_month, pub_day, CAST(pub_date AS VARCHAR) AS pub_date FROM dates",
    "garbage_flags": f"SELECT doc_id, {GARBAGE.format(c='text', n=COLLAPSE('text'))} AS garbage FROM documents",
    "record_validity": RAW + "SELECT pmcid, status FROM dates",
    "papers_table": RAW + f"SELECT pmcid, {', '.join(NULLED(c) for c in ('pmid', 'title', 'journal', 'pub_year', 'pub_month', 'pub_day', 'abstract'))}, CAST(NULL AS VARCHAR) AS doi, CAST(pub_date AS VARCHAR) AS pub_date FROM dates WHERE status = 'valid'",
    "chunk_fulltext": chunk_sql(3200, 80) + "SELECT * FROM chunks",
    "chunk_fulltext_small": chunk_sql(400, 80) + "SELECT * FROM chunks",
    "chunk_index": chunk_sql(3200, 80) + f", h AS (SELECT *, {POINT('''concat_ws('_', CAST(pmcid AS VARCHAR), source_type, substr(replace(lower(section), ' ', '_'), 1, 30), CAST(chunk_index AS VARCHAR))''')} AS h FROM chunks) SELECT pmcid, section, chunk_index, CAST(length(text) AS INTEGER) AS n_chars, {UUID5} AS point_id FROM h",
    "abstract_chunks": RAW + f"SELECT pmcid, 'abstract' AS source_type, 'abstract' AS section, CAST(0 AS INTEGER) AS chunk_index, {STRIP('abstract')} AS text FROM raw WHERE {STRIP('abstract')} <> ''",
    "point_id": f"WITH h AS (SELECT doc_id, {POINT('''concat_ws('_', CAST(doc_id AS VARCHAR), 'abstract', substr(replace(lower(source), ' ', '_'), 1, 30), '0')''')} AS h FROM documents) SELECT doc_id, {UUID5} AS id FROM h",
    "meta_lookup_join": "SELECT coalesce(o_orderpriority, '') AS o_orderpriority, coalesce(strftime(o_orderdate, '%Y'), '') AS o_year, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "payload_backfill": "SELECT vec_id AS id, coalesce(nullif(d.lang, 'es'), CAST(label AS VARCHAR)) AS lang FROM embeddings LEFT JOIN documents d ON vec_id = doc_id",
    "papers_upsert": "SELECT o_custkey AS custkey, o_orderdate, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "table_upsert": "WITH n AS (SELECT o_custkey AS key, max(o_orderpriority) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT * FROM n UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT key FROM n)",
    "pending_anti_join": "SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')",
    "progress_state": "SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "status_move": "WITH s AS (SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1) SELECT CASE WHEN status = 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') THEN 'pending' ELSE status END AS status, count(*) AS n FROM s GROUP BY 1",
    "vector_completeness": "SELECT lang, count(vec_id) AS complete, count(*) - count(vec_id) AS failed FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY lang",
    "vector_upsert": f"WITH h AS (SELECT doc_id AS pmcid, doc_id AS seq, label AS sparse, {POINT('''concat_ws('_', CAST(doc_id AS VARCHAR), 'fulltext', substr(replace(lower('A section title of thirty chars: ' || source), ' ', '_'), 1, 30), '0')''')} AS h FROM documents JOIN embeddings ON vec_id = doc_id) SELECT {UUID5} AS id, pmcid, seq, sparse FROM h",
    "payload_scan": "SELECT doc_id, lang, source AS journal FROM documents WHERE lang = 'de'",
    "existence_split": "SELECT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS present FROM labels WHERE toxic = 1",
    "id_mapping": RAW + "SELECT pmcid, coalesce(CAST(l.doc_id + 1000000 AS VARCHAR), pmid) AS pmid FROM raw LEFT JOIN labels l ON raw.doc_id = l.doc_id",
    "health_distribution": RAW + "SELECT 'lang' AS kind, lang AS value, count(*) AS n FROM raw GROUP BY lang UNION ALL SELECT * FROM (SELECT 'year', pub_year, count(*) FROM raw GROUP BY pub_year ORDER BY pub_year DESC LIMIT 8)",
    "parse_scan_status": SCAN + "SELECT * FROM scan",
    "chunk_len_percentiles": SCAN + ", l AS (SELECT list(avg_chunk_len ORDER BY avg_chunk_len) AS l, count(*) AS n FROM scan WHERE avg_chunk_len > 0) SELECT l[n // 2 + 1] AS median, l[n // 10 + 1] AS p10, l[n * 9 // 10 + 1] AS p90 FROM l",
    "missing_sections": SCAN + ", u AS (SELECT unnest(string_split(missing_core, ',')) AS section FROM scan) SELECT section, count(*) AS n FROM u WHERE section <> '' GROUP BY section",
    "seeded_sample": "SELECT doc_id, md5('42|' || doc_id) AS h FROM documents ORDER BY h LIMIT 50",
    "jats_paragraphs": f"WITH {JATS_SQL} SELECT * FROM parsed",
    "fail_diagnosis": f"""WITH {JATS_SQL}, whole AS (SELECT DISTINCT doc_id FROM parsed), r AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'missing file' WHEN 1 THEN 'malformed' WHEN 2 THEN 'no body' WHEN 3 THEN 'namespaced body' WHEN 4 THEN 'neither sec nor p' WHEN 5 THEN 'p without sec' ELSE 'other' END AS reason,
  doc_id % 8 < 7 OR doc_id NOT IN (SELECT doc_id FROM whole) AS fail FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS i FROM r WHERE fail)
SELECT reason, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE i <= 3) AS examples FROM n GROUP BY reason""",
    "update_groups": "SELECT lang, source, count(*) AS n, min(doc_id) AS least, max(doc_id) AS greatest, CAST(sum(doc_id) AS BIGINT) AS total, true AS bounded FROM documents GROUP BY lang, source",
    "failed_keys": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
}
