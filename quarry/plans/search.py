"""Search and evaluation queries. The query set is the whole benchmark table, each item with the vector of its number, if any.

An item without a vector has no dense hits; its sparse ones count all the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import metrics as M
from quarry.operators import providers
from quarry.operators import retrieval as R
from quarry.sources.shared import written
from quarry.sources.tables import table


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("journal"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def query_set(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))
    return q.join(vectors(spark, d).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("label").alias("qlabel")), "qid", "left")


def flat(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "id", "score", "rank")


def fixed_set(spark: SparkSession, d: str, texts: list[tuple[str, str]]) -> DataFrame:
    """(qid, intent, qtext, qvec, qlabel) of fixed queries (intent, text) numbered from 0, each with the vector of its number, if any."""
    q = spark.createDataFrame([(i, intent, text) for i, (intent, text) in enumerate(texts)], "qid long, intent string, qtext string")
    return q.join(vectors(spark, d).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("label").alias("qlabel")), "qid", "left")


def legs(spark: SparkSession, d: str, n: int = 40, q: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The dense and the sparse leg of a query set (the whole benchmark), n hits deep, worked out once."""
    q = query_set(spark, d) if q is None else q
    leg = lambda hits, name: hits.select(F.lit(name).alias("leg"), "qid", "id", "score", "rank")
    both = written(leg(R.dense_topk(q, vectors(spark, d), n), "dense").unionByName(leg(R.sparse_topk(q, corpus(spark, d), n), "sparse")), "legs")
    return tuple(both.filter(F.col("leg") == x).drop("leg") for x in ("dense", "sparse"))


def strategies(spark: SparkSession, d: str, q: DataFrame | None = None) -> dict[str, DataFrame]:
    """The four systems' hits for a query set (the whole benchmark), and C at D's depth (E): all are cuts of the same two legs."""
    q, c = query_set(spark, d) if q is None else q, corpus(spark, d)
    dense, sparse = legs(spark, d, q=q)
    cut = lambda x, n: x.filter(F.col("rank") < n)
    fused = R.rrf(dense, sparse, 20)
    run = lambda x, s: x.select("qid", "id", F.col(s).alias("score"), "rank")
    return {
        "A": run(cut(dense, 5), "score"),
        "B": run(cut(sparse, 5), "score"),
        "C": run(R.rrf(cut(dense, 10), cut(sparse, 10), 5), "rrf_score"),
        "D": run(R.rerank(fused, q, c, 5), "rerank_score"),
        "E": run(cut(fused, 5), "rrf_score"),
    }


def runs(spark: SparkSession, d: str, q: DataFrame | None = None) -> DataFrame:
    """(strategy, qid, id, score, rank): five hits a query and strategy, written, as every reader reads them more than once."""
    out = None
    for name, hits in strategies(spark, d, q).items():
        one = hits.select(F.lit(name).alias("strategy"), "qid", "id", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return written(out, "runs")


def graded(spark: SparkSession, d: str) -> DataFrame:
    """(id, class, rel) of every vector: what it is worth to queries of its label, 2 for quality 1, else 1; a known label beats a judged grade."""
    good = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"), F.lit(2).alias("known"))
    return vectors(spark, d).select("id", F.col("label").alias("class")).join(good, "id", "left").select("id", "class", F.coalesce("known", F.lit(1)).alias("rel"))


def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.ir_metrics_by_class(runs(spark, d), query_set(spark, d).select("qid", F.col("qlabel").alias("class")), graded(spark, d))


def sets(spark: SparkSession, d: str) -> DataFrame:
    """(qid, A, B, C, D): each system's ids; at most five each."""
    got = runs(spark, d).groupBy("qid").pivot("strategy", ["A", "B", "C", "D"]).agg(F.array_sort(F.collect_set("id")))
    empty = F.array().cast("array<long>")
    return got.select("qid", *[F.coalesce(c, empty).alias(c) for c in "ABCD"])


def ablation_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return sets(spark, d).select("qid", F.round(M.jaccard(F.col("A"), F.col("B")), 6).alias("jaccard"), F.size(F.array_except("A", "B")).alias("dense_only"), F.size(F.array_except("B", "A")).alias("sparse_only"))


def rerank_churn(spark: SparkSession, d: str) -> DataFrame:
    each = sets(spark, d).select(F.size(F.array_except("D", "C")).alias("new"), F.size(F.array_except("C", "D")).alias("dropped"), M.jaccard(F.col("A"), F.col("B")).alias("j"))
    return each.agg(F.round(F.avg("new"), 6).alias("mean_new"), F.round(F.avg("dropped"), 6).alias("mean_dropped"), F.round(F.avg("j"), 6).alias("mean_jaccard"))


def pooled_hits(spark: SparkSession, d: str) -> DataFrame:
    """One hit per (query, id) over systems A to D: the last system's, and within it the last rank."""
    rows = runs(spark, d).filter("strategy < 'E'")
    return rows.groupBy("qid", "id").agg(F.max(F.struct("strategy", "rank", "score")).alias("x")).select("qid", "id", F.col("x.strategy").alias("strategy"), F.col("x.rank").alias("rank"), F.col("x.score").alias("score"))


def result_diversity(spark: SparkSession, d: str) -> DataFrame:
    hits = strategies(spark, d)["D"]
    return hits.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_distinct"), F.round(F.count_distinct("id") / F.count("*"), 6).alias("unique_ratio"))


def health(spark: SparkSession, d: str) -> DataFrame:
    """Hits by kind and the warnings that follow: a kind absent, few different ids, few recent ones, queries without hits."""
    hits = strategies(spark, d)["D"].join(corpus(spark, d).select("id", "lang"), "id", "left").withColumn("year", (2015 + F.col("id") % 12).cast("string"))
    recent = T.digits_only(F.col("year")) & (F.col("year").try_cast("int") >= 2022)
    out = hits.agg(
        F.max(F.when(F.col("lang") == "en", 1).otherwise(0)).alias("has_en"),
        F.max(F.when(F.col("lang") == "de", 1).otherwise(0)).alias("has_de"),
        F.round(F.count_distinct("id") / F.count("*"), 6).alias("unique_ratio"),
        F.round(F.sum(recent.cast("int")) / F.count("*"), 6).alias("recent_ratio"),
        F.count_distinct("qid").alias("answered"),
    )
    asked = query_set(spark, d).agg(F.count("*").alias("asked"))
    return out.crossJoin(F.broadcast(asked)).select("*", (F.col("has_en") == 0).alias("warn_en"), (F.col("has_de") == 0).alias("warn_de"), (F.col("unique_ratio") < 0.5).alias("warn_unique"), (F.col("recent_ratio") < 0.3).alias("warn_recent"), (F.col("asked") > F.col("answered")).alias("warn_failed"))


def health_run(spark: SparkSession, d: str) -> DataFrame:
    """Five hits for each of the fixed queries, by intent: hits, different ids, queries with none, and the share of hits from 2022 on."""
    q = fixed_set(spark, d, HEALTH)
    hits = strategies(spark, d, q)["D"].withColumn("recent", ((2015 + F.col("id") % 12) >= 2022).cast("int"))
    of = q.select("qid", "intent").join(hits, "qid", "left")
    each = of.groupBy("intent").agg(F.count("id").alias("hits"), F.count_distinct("id").alias("different"), F.count_distinct("qid").alias("asked"), F.count_distinct(F.when(F.col("id").isNotNull(), F.col("qid"))).alias("answered"), F.coalesce(F.sum("recent"), F.lit(0).cast("long")).alias("recent"))
    return each.select("*", (F.col("asked") > F.col("answered")).alias("warn_failed"), (F.col("different") < 0.5 * F.col("hits")).alias("warn_unique"), (F.col("recent") < 0.3 * F.col("hits")).alias("warn_recent"))


def ablation_run(spark: SparkSession, d: str) -> DataFrame:
    """The four systems' five best ids for each fixed query, how far dense and sparse agree, and how many reranking brought in."""
    q = fixed_set(spark, d, [("", x) for x in ABLATION])
    got = runs(spark, d, q).groupBy("qid").pivot("strategy", ["A", "B", "C", "D"]).agg(F.array_sort(F.collect_set("id")))
    empty = F.array().cast("array<long>")
    found = q.select("qid", F.col("qtext").alias("query")).join(got, "qid", "left").select("query", *[F.coalesce(c, empty).alias(c) for c in "ABCD"])
    joined = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(name) for c, name in zip("ABCD", ("dense", "sparse", "hybrid", "reranked"), strict=True)]
    return found.select("query", F.round(M.jaccard(F.col("A"), F.col("B")), 6).alias("jaccard"), F.size(F.array_except("D", "C")).alias("rerank_new"), *joined)


def judge_grades(spark: SparkSession, d: str) -> DataFrame:
    """(qid, id, rel) of the pooled ten best of both legs: known grades first, then the stand-in judge's."""
    q, c = query_set(spark, d), corpus(spark, d)
    dense, sparse = legs(spark, d, 10)
    pool = dense.select("qid", "id").unionByName(sparse.select("qid", "id")).distinct()
    known = table(spark, d, "labels").filter("quality = 1").groupBy(F.col("doc_id").alias("id")).agg(F.lit(2).alias("known"))
    pairs = pool.join(q.select("qid", "qtext"), "qid").join(c.select("id", "text"), "id", "left").join(known, "id", "left")
    return providers.judged(pairs, providers.by_words).select("qid", "id", "rel")


def effective_scores(spark: SparkSession, d: str) -> DataFrame:
    """Of every hit of the sparse leg, of fusion and of reranking the score that counts: the last stage's that it reached."""
    q, c = query_set(spark, d), corpus(spark, d)
    dense, sparse = legs(spark, d)
    fused = R.rrf(dense, sparse, 20)
    one = lambda hits, name: hits.select("qid", "id", F.col(name))
    hits = one(sparse, "score").join(one(fused, "rrf_score"), ["qid", "id"], "full_outer").join(one(R.rerank(fused, q, c, 5), "rerank_score"), ["qid", "id"], "full_outer")
    return hits.select("qid", "id", F.round(R.effective_score("rerank_score", "rrf_score", "score"), 6).alias("score"))


#: The health run's queries, by intent.
HEALTH = [
    ("机制", "autonomic dysfunction mechanism in long covid"),
    ("机制", "SARS-CoV-2 spike protein persistence chronic symptoms"),
    ("机制", "microbiome dysbiosis long covid pathophysiology"),
    ("症状", "post-exertional malaise fatigue long covid"),
    ("症状", "brain fog cognitive impairment long covid"),
    ("症状", "long covid cardiovascular symptoms palpitations"),
    ("治疗", "antivirals treatment long covid clinical trial"),
    ("治疗", "low dose naltrexone long covid"),
    ("治疗", "rehabilitation exercise therapy post-covid"),
    ("流行病学", "long covid prevalence omicron variant"),
    ("流行病学", "long covid risk factors age sex comorbidities"),
    ("流行病学", "long covid incidence vaccination effect"),
    ("综述", "long covid systematic review meta-analysis"),
    ("综述", "post-acute sequelae SARS-CoV-2 overview"),
]
#: The ablation run's queries.
ABLATION = [
    "autonomic dysfunction treatment long covid",
    "post-exertional malaise mechanism pathophysiology",
    "long covid prevalence omicron variant 2022 2023",
    "brain fog cognitive impairment intervention",
    "mast cell activation long covid symptoms",
    "antivirals paxlovid long covid clinical trial results",
    "gut microbiome dysbiosis long covid",
    "long covid systematic review meta-analysis outcomes",
]

QUERIES = {
    "dense_topk": lambda s, d: flat(R.dense_topk(query_set(s, d), vectors(s, d), 20)),
    "dense_topk_filtered": lambda s, d: flat(R.dense_topk(query_set(s, d), vectors(s, d), 20, {"label": 3})),
    "dense_topk_batch": lambda s, d: flat(R.dense_topk(query_set(s, d), vectors(s, d), 5)),
    "sparse_topk": lambda s, d: flat(R.sparse_topk(query_set(s, d), corpus(s, d), 20)),
    "sparse_topk_filtered": lambda s, d: flat(R.sparse_topk(query_set(s, d), corpus(s, d), 20, {"lang": "en", "journal": "src1"})),
    "sparse_topk_batch": lambda s, d: flat(R.sparse_topk(query_set(s, d), corpus(s, d), 5)),
    "hybrid_rrf": lambda s, d: R.hybrid(query_set(s, d), corpus(s, d), vectors(s, d), 20).select("qid", "id", F.round("rrf_score", 9).alias("rrf_score"), "rank"),
    "hybrid_rerank": lambda s, d: R.search(query_set(s, d), corpus(s, d), vectors(s, d), 20, 5).select("qid", "id", "rerank_score", "rank"),
    "search_preview": lambda s, d: R.preview(R.search(query_set(s, d), corpus(s, d), vectors(s, d), 20, 10), corpus(s, d)),
    "ablation_jaccard": ablation_jaccard,
    "rerank_churn": rerank_churn,
    "pooled_hits": pooled_hits,
    "ir_metrics": ir_metrics,
    "metric_advice": lambda s, d: M.advice(ir_metrics(s, d)),
    "result_diversity": result_diversity,
    "health_warnings": health,
    "health_run": health_run,
    "ablation_run": ablation_run,
    "judge_grades": judge_grades,
    "effective_scores": effective_scores,
}

WITH = """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
q AS (SELECT item_id AS qid, text AS qtext, vec AS qvec, label AS qlabel FROM benchmark LEFT JOIN v ON item_id = id),
dot AS (SELECT q.qid, v.id, v.label, round(list_dot_product(v.vec, q.qvec) / (sqrt(list_dot_product(v.vec, v.vec)) * sqrt(list_dot_product(q.qvec, q.qvec))), 6) AS score FROM q CROSS JOIN v WHERE qvec IS NOT NULL),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM dot),
qt AS (SELECT qid, term, ln(1 + count(*)) AS qw FROM (SELECT qid, unnest(regexp_extract_all(lower(qtext), '[a-z0-9]+')) AS term FROM q) GROUP BY ALL),
dt AS (SELECT id, lang, journal, term, ln(1 + count(*)) AS dw FROM (SELECT doc_id AS id, lang, source AS journal, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL),
terms AS (SELECT qid, id, lang, journal, round(sum(qw * dw), 4) AS score FROM qt JOIN dt ON qt.term = dt.term GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM terms),
"""
RRF = """{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, dr NULLS LAST, sr NULLS LAST) - 1 AS rank FROM (
  SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, a.rank AS dr, b.rank AS sr, coalesce(1.0e0 / (60 + a.rank), 0e0) + coalesce(1.0e0 / (60 + b.rank), 0e0) AS rrf_score
  FROM (SELECT * FROM dense WHERE rank < {n}) a FULL JOIN (SELECT * FROM sparse WHERE rank < {n}) b ON a.qid = b.qid AND a.id = b.id)) WHERE rank < {k}),
"""
HYBRID = WITH + RRF.format(name="fused", n=40, k=20)
RERANK = """pairs AS (SELECT f.qid, f.id, f.rank AS hr, list_distinct(regexp_extract_all(lower(q.qtext), '[a-z0-9]+')) AS qwords, list_distinct(regexp_extract_all(lower(coalesce(d.text, '')), '[a-z0-9]+')) AS dwords
  FROM fused f JOIN q ON f.qid = q.qid LEFT JOIN documents d ON d.doc_id = f.id),
rescored AS (SELECT qid, id, hr, round(CASE WHEN len(qwords) = 0 THEN 0 ELSE len(list_intersect(qwords, dwords)) * 1.0e0 / len(qwords) END, 6) AS rerank_score FROM pairs),
reranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, hr) - 1 AS rank FROM rescored),
"""
ALL = (
    HYBRID + RRF.format(name="short", n=10, k=5) + RERANK
    + """runs AS (SELECT 'A' AS strategy, qid, id, score, rank FROM dense WHERE rank < 5 UNION ALL SELECT 'B', qid, id, score, rank FROM sparse WHERE rank < 5
  UNION ALL SELECT 'C', qid, id, rrf_score, rank FROM short UNION ALL SELECT 'D', qid, id, rerank_score, rank FROM reranked WHERE rank < 5 UNION ALL SELECT 'E', qid, id, rrf_score, rank FROM fused WHERE rank < 5),
sets AS (SELECT qid, coalesce(list(DISTINCT id) FILTER (WHERE strategy = 'A'), []) AS a, coalesce(list(DISTINCT id) FILTER (WHERE strategy = 'B'), []) AS b,
  coalesce(list(DISTINCT id) FILTER (WHERE strategy = 'C'), []) AS c, coalesce(list(DISTINCT id) FILTER (WHERE strategy = 'D'), []) AS d FROM runs GROUP BY qid),
sizes AS (SELECT qid, len(a) AS na, len(b) AS nb, len(c) AS nc, len(d) AS nd, len(list_intersect(a, b)) AS ab, len(list_intersect(c, d)) AS cd FROM sets),
qrels AS (SELECT q.qid, v.id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END AS rel FROM q JOIN v ON q.qlabel = v.label LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = v.id),
ideal AS (SELECT qid, sum(CASE WHEN i <= 5 THEN rel / log2(i + 1) ELSE 0 END) AS idcg, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, id) AS i FROM qrels) GROUP BY qid),
ranked AS (SELECT strategy, qid, id, row_number() OVER (PARTITION BY strategy, qid ORDER BY score DESC, id) AS i FROM runs),
per AS (SELECT strategy, r.qid, sum(CASE WHEN i <= 5 THEN coalesce(rel, 0) / log2(i + 1) ELSE 0 END) AS dcg, count(*) FILTER (WHERE rel > 0 AND i <= 5) AS hits, coalesce(1.0e0 / min(i) FILTER (WHERE rel > 0), 0) AS rr
  FROM ranked r LEFT JOIN qrels ON r.qid = qrels.qid AND r.id = qrels.id GROUP BY strategy, r.qid),
metrics AS (SELECT s.strategy, round(avg(coalesce(dcg, 0) / idcg), 6) AS ndcg, round(avg(coalesce(hits, 0) * 1.0e0 / n), 6) AS recall, round(avg(coalesce(hits, 0) / 5.0e0), 6) AS precision, round(avg(coalesce(rr, 0)), 6) AS mrr
  FROM ideal CROSS JOIN (SELECT DISTINCT strategy FROM runs) s LEFT JOIN per ON per.strategy = s.strategy AND per.qid = ideal.qid GROUP BY s.strategy)
"""
)
LIMITED = "SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM "


def end(text: str) -> str:
    return text.rstrip().rstrip(",") + "\n"


BENCHMARK = "q AS (SELECT item_id AS qid, text AS qtext, vec AS qvec, label AS qlabel FROM benchmark LEFT JOIN v ON item_id = id)"


def asking(sql: str, texts: list[str]) -> str:
    """sql over fixed queries, numbered from 0, in place of the benchmark."""
    values = ", ".join("(CAST({} AS BIGINT), '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(texts))
    out = sql.replace(BENCHMARK, f"f(qid, qtext) AS (VALUES {values}), q AS (SELECT f.qid, qtext, vec AS qvec, label AS qlabel FROM f LEFT JOIN v ON f.qid = id)")
    if out == sql:
        raise ValueError("no query set to replace")
    return out


INTENTS = ", ".join(f"(CAST({i} AS BIGINT), '{x}')" for i, (x, _) in enumerate(HEALTH))
IDS = "coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM runs WHERE runs.qid = f.qid AND strategy = '{}'), '')"
ORACLE_SQL = {
    "dense_topk": end(WITH) + LIMITED + "dense WHERE rank < 20",
    "dense_topk_filtered": end(WITH) + LIMITED + "(SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM dot WHERE label = 3) WHERE rank < 20",
    "dense_topk_batch": end(WITH) + LIMITED + "dense WHERE rank < 5",
    "sparse_topk": end(WITH) + LIMITED + "sparse WHERE rank < 20",
    "sparse_topk_filtered": end(WITH) + LIMITED + "(SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM terms WHERE lang = 'en' AND journal = 'src1') WHERE rank < 20",
    "sparse_topk_batch": end(WITH) + LIMITED + "sparse WHERE rank < 5",
    "hybrid_rrf": end(HYBRID) + "SELECT qid, id, round(rrf_score, 9) AS rrf_score, CAST(rank AS INTEGER) AS rank FROM fused",
    "hybrid_rerank": end(HYBRID + RERANK) + "SELECT qid, id, rerank_score, CAST(rank AS INTEGER) AS rank FROM reranked WHERE rank < 5",
    "search_preview": end(HYBRID + RERANK) + """SELECT qid, id, CAST(rank AS INTEGER) AS rank, coalesce(source, '') AS journal, coalesce(lang, '') AS lang, round(rerank_score, 3) AS score, substr(coalesce(text, ''), 1, 150) AS text
  FROM reranked LEFT JOIN documents ON doc_id = id WHERE rank < 10""",
    "ablation_jaccard": ALL + "SELECT qid, round(CASE WHEN na + nb - ab = 0 THEN 0 ELSE ab * 1.0e0 / (na + nb - ab) END, 6) AS jaccard, CAST(na - ab AS INTEGER) AS dense_only, CAST(nb - ab AS INTEGER) AS sparse_only FROM sizes",
    "rerank_churn": ALL + "SELECT round(avg(nd - cd), 6) AS mean_new, round(avg(nc - cd), 6) AS mean_dropped, round(avg(CASE WHEN na + nb - ab = 0 THEN 0 ELSE ab * 1.0e0 / (na + nb - ab) END), 6) AS mean_jaccard FROM sizes",
    "pooled_hits": ALL + "SELECT qid, id, strategy, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY strategy DESC, rank DESC) AS n FROM runs WHERE strategy < 'E') WHERE n = 1",
    "ir_metrics": ALL + "SELECT * FROM metrics",
    "metric_advice": ALL + """, g AS (SELECT coalesce(max(ndcg) FILTER (WHERE strategy = 'D'), 0) AS nd, coalesce(max(ndcg) FILTER (WHERE strategy = 'A'), 0) AS na, coalesce(max(ndcg) FILTER (WHERE strategy = 'C'), 0) AS nc, coalesce(max(recall) FILTER (WHERE strategy = 'D'), 0) AS recall FROM metrics),
h AS (SELECT round(nd - na, 6) AS hybrid_gain, round(nd - nc, 6) AS rerank_gain, recall FROM g) SELECT *, hybrid_gain > 0.05 AS hybrid_helps, rerank_gain > 0.03 AS rerank_helps, recall < 0.4 AS recall_low FROM h""",
    "result_diversity": ALL + "SELECT count(*) AS n, count(DISTINCT id) AS n_distinct, round(count(DISTINCT id) * 1.0e0 / count(*), 6) AS unique_ratio FROM runs WHERE strategy = 'D'",
    "health_warnings": ALL + """, h AS (SELECT r.*, lang, 2015 + id % 12 AS year FROM runs r LEFT JOIN documents ON doc_id = id WHERE strategy = 'D'),
s AS (SELECT CAST(max(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS INTEGER) AS has_en, CAST(max(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) AS INTEGER) AS has_de, round(count(DISTINCT id) * 1.0e0 / count(*), 6) AS unique_ratio,
  round(count(*) FILTER (WHERE year >= 2022) * 1.0e0 / count(*), 6) AS recent_ratio, count(DISTINCT qid) AS answered, (SELECT count(*) FROM q) AS asked FROM h)
SELECT *, has_en = 0 AS warn_en, has_de = 0 AS warn_de, unique_ratio < 0.5 AS warn_unique, recent_ratio < 0.3 AS warn_recent, asked > answered AS warn_failed FROM s""",
    "health_run": asking(ALL, [x for _, x in HEALTH]) + f""", i(qid, intent) AS (VALUES {INTENTS}), h AS (SELECT i.qid, intent, id FROM i LEFT JOIN (SELECT * FROM runs WHERE strategy = 'D') r ON i.qid = r.qid),
e AS (SELECT intent, count(id) AS hits, count(DISTINCT id) AS different, count(DISTINCT qid) AS asked, count(DISTINCT qid) FILTER (WHERE id IS NOT NULL) AS answered, count(id) FILTER (WHERE 2015 + id % 12 >= 2022) AS recent FROM h GROUP BY intent)
SELECT *, asked > answered AS warn_failed, different < 0.5 * hits AS warn_unique, recent < 0.3 * hits AS warn_recent FROM e""",
    "ablation_run": asking(ALL, ABLATION) + f"""SELECT f.qtext AS query, round(CASE WHEN coalesce(na + nb - ab, 0) = 0 THEN 0 ELSE ab * 1.0e0 / (na + nb - ab) END, 6) AS jaccard, CAST(coalesce(nd - cd, 0) AS INTEGER) AS rerank_new,
  {IDS.format('A')} AS dense, {IDS.format('B')} AS sparse, {IDS.format('C')} AS hybrid, {IDS.format('D')} AS reranked FROM f LEFT JOIN sizes ON sizes.qid = f.qid""",
    "judge_grades": end(WITH) + """, pool AS (SELECT DISTINCT qid, id FROM (SELECT qid, id FROM dense WHERE rank < 10 UNION ALL SELECT qid, id FROM sparse WHERE rank < 10)),
w AS (SELECT pool.qid, pool.id, list_distinct(regexp_extract_all(lower(qtext), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(substr(coalesce(text, ''), 1, 600)), '[a-z0-9]+')) AS b, quality FROM pool JOIN q ON pool.qid = q.qid LEFT JOIN documents ON doc_id = pool.id LEFT JOIN (SELECT DISTINCT doc_id AS l, 1 AS quality FROM labels WHERE quality = 1) ON l = pool.id)
SELECT qid, id, CAST(CASE WHEN quality = 1 THEN 2 WHEN len(a) = 0 THEN 0 WHEN len(list_intersect(a, b)) * 2 >= len(a) THEN 2 WHEN len(list_intersect(a, b)) * 4 >= len(a) THEN 1 ELSE 0 END AS INTEGER) AS rel FROM w""",
    "effective_scores": end(HYBRID + RERANK) + """, s AS (SELECT qid, id FROM sparse WHERE rank < 40 UNION SELECT qid, id FROM fused)
SELECT s.qid, s.id, round(coalesce(r.rerank_score, f.rrf_score, p.score, 0), 6) AS score FROM s LEFT JOIN (SELECT * FROM reranked WHERE rank < 5) r ON s.qid = r.qid AND s.id = r.id LEFT JOIN fused f ON s.qid = f.qid AND s.id = f.id LEFT JOIN (SELECT * FROM sparse WHERE rank < 40) p ON s.qid = p.qid AND s.id = p.id""",
}
