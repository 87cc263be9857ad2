"""Queries over whole tables and values, held against SQL of their own: no prefix, no modulo rule, no single query."""

from quarry.operators import chunking, records
from quarry.plans import catalog, corpus, search
from tests.compare import same

DATA = "/root/testdata/sf0.001"


def test_garbage_flags_judge_whole_texts(spark, tmp_path):
    texts = ["a;b;c;d;e", "coronaVacWibp", "plain text here", "x;" * 300, "two joinedWords in a text of more", "a;b;c" + " " * 400 + ";d;e", "joinedWord" + " w" * 30, None]
    texts = [t for t in texts for _ in range(3)]
    frame = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    sql = f"SELECT doc_id, {corpus.GARBAGE.format(c='text', n=corpus.COLLAPSE('text'))} AS garbage FROM documents"
    got = catalog.QUERIES["garbage_flags"](spark, str(tmp_path))
    same(got, sql, str(tmp_path))
    assert {r.doc_id for r in got.filter("garbage").collect()} == {0, 1, 2, 3, 4, 5}
    same(catalog.QUERIES["garbage_flags"](spark, DATA), sql, DATA)


def test_meta_lookup_join_reads_all_orders(spark, tmp_path):
    sql = "SELECT coalesce(o_orderpriority, '') AS o_orderpriority, coalesce(strftime(o_orderdate, '%Y'), '') AS o_year, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"
    same(catalog.QUERIES["meta_lookup_join"](spark, DATA), sql, DATA)
    spark.sql("SELECT 3L AS o_orderkey, '1-URGENT' AS o_orderpriority, DATE '1995-02-03' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT explode(array(3L, 3L, 4L)) AS l_orderkey, 1 AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["meta_lookup_join"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [("", "", 1), ("1-URGENT", "1995", 2)]


def test_records_hold_whole_texts_of_all_rows(spark):
    text = corpus.STRIP("text")
    same(catalog.QUERIES["abstract_chunks"](spark, DATA), f"SELECT 'PMC' || doc_id AS pmcid, 'abstract' AS source_type, 'abstract' AS section, CAST(0 AS INTEGER) AS chunk_index, {text} AS text FROM documents WHERE {text} <> ''", DATA)
    sql = f"SELECT 'PMC' || doc_id AS pmcid, nullif({text}, '') AS title, nullif({text}, '') AS abstract FROM documents WHERE {text} <> '' AND doc_id % 11 <> 0 AND doc_id % 23 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0"
    same(catalog.QUERIES["papers_table"](spark, DATA).select("pmcid", "title", "abstract"), sql, DATA)


def test_vector_upsert_keeps_every_document_with_a_vector(spark):
    got = catalog.QUERIES["vector_upsert"](spark, DATA)
    same(got.select("pmcid", "seq", "sparse"), "SELECT doc_id AS pmcid, doc_id AS seq, label AS sparse FROM documents JOIN embeddings ON vec_id = doc_id", DATA)
    assert got.select("id").distinct().count() == got.count() > 100


def test_blank_abstracts_and_colliding_ids(spark):
    raw = spark.createDataFrame([("PMC1", " "), ("PMC2", None), ("PMC3", " a b ")], "pmcid string, abstract string")
    assert [(r.pmcid, r.text) for r in chunking.abstract_chunks(raw).collect()] == [("PMC3", "a b")]
    name = "A section title of thirty chars: "
    rows = [(1, "fulltext", name + "x", 0, [1.0], 1, 10), (1, "fulltext", name + "y", 0, [2.0], 2, 11), (2, "fulltext", name + "x", 0, [3.0], 3, 12), (3, "fulltext", name, 0, None, 4, 13)]
    chunks = spark.createDataFrame(rows, "pmcid long, source_type string, section string, chunk_index int, dense array<double>, sparse int, seq long")
    assert sorted((r.pmcid, r.seq) for r in records.points(chunks).collect()) == [(1, 11), (2, 12)]


def test_searches_run_for_the_whole_query_set(spark):
    take = search.LIMITED
    filtered = "(SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM {}) WHERE rank < 20"
    preview = "SELECT qid, id, CAST(rank AS INTEGER) AS rank, coalesce(source, '') AS journal, coalesce(lang, '') AS lang, round(rerank_score, 3) AS score, substr(coalesce(text, ''), 1, 150) AS text FROM reranked LEFT JOIN documents ON doc_id = id WHERE rank < 10"
    whole = {
        "dense_topk": search.end(search.WITH) + take + "dense WHERE rank < 20",
        "dense_topk_filtered": search.end(search.WITH) + take + filtered.format("dot WHERE label = 3"),
        "sparse_topk": search.end(search.WITH) + take + "sparse WHERE rank < 20",
        "sparse_topk_filtered": search.end(search.WITH) + take + filtered.format("terms WHERE lang = 'en' AND journal = 'src1'"),
        "search_preview": search.end(search.HYBRID + search.RERANK) + preview,
    }
    for name, sql in whole.items():
        got = catalog.QUERIES[name](spark, DATA)
        same(got, sql, DATA)
        assert got.select("qid").distinct().count() > 1, name
