"""Persisted indexes against scans: exact hits, what is read, recall, filters, rows of all kinds."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import inverted, ivf, markup
from quarry.operators import retrieval as R


def rows(hits):
    return sorted((r.qid, r["rank"], r.id, r.score) for r in hits.collect())


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{min(int(rng.expovariate(0.04)), 199)}" for _ in range(4000)]
    return [(i, None if i % 60 == 7 else "" if i % 60 == 8 else "!! ..." if i % 60 == 9 else " ".join(rng.choices(words, k=rng.choice([1, 3, 10, 60, 200])))) for i in range(n)]


@pytest.mark.parametrize(("block", "held"), [(2048, 16), (3, 5)])
def test_inverted_index_equals_a_scan(spark, tmp_path, block, held):
    corpus = spark.createDataFrame([*texts(1, 900), (None, "w1 w2")], "id long, text string").repartition(5)
    queries = spark.createDataFrame([(i, None if i == 3 else t) for i, t in texts(2, 12)] + [(50, "nothing that occurs"), (51, "w0"), (None, "w0")], "qid long, qtext string")
    inverted.build(inverted.terms(corpus), f"file://{tmp_path}/i", held, 7)
    counted = []
    index = inverted.Index(spark, f"file://{tmp_path}/i")
    got = rows(index.search(queries, 10, block, counted))
    scan = corpus.filter("id IS NOT NULL")
    assert got and got == rows(R.sparse_topk(queries, scan, 10, None, block))
    assert all(0 < read <= of for read, of in counted)
    assert rows(index.search(queries.limit(0), 10)) == [] and index.facts.rows == 900 - 900 // 60 * 3


def test_block_maxima_leave_most_postings_out(spark, tmp_path):
    """One long row in a hundred: for a short query the blocks of short rows can't reach what the long ones have."""
    rng = random.Random(5)
    corpus = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(40)}" for _ in range(400 if i % 100 == 0 else 6))) for i in range(6000)], "id long, text string").repartition(4)
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w7")], "qid long, qtext string")
    inverted.build(inverted.terms(corpus), f"file://{tmp_path}/i")
    counted = []
    assert rows(inverted.Index(spark, f"file://{tmp_path}/i").search(queries, 10, counted=counted)) == rows(R.sparse_topk(queries, corpus, 10))
    assert counted[0][0] * 4 < counted[0][1]


def test_only_the_terms_buckets_are_read(spark, tmp_path):
    corpus = spark.createDataFrame([(i, f"w{i} all") for i in range(300)], "id long, text string")
    inverted.build(inverted.terms(corpus), f"file://{tmp_path}/i", buckets=16)
    read = inverted.Index(spark, f"file://{tmp_path}/i").postings(["w5"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert read.count() == 1 and "bucket" in re.search(r"PartitionFilters: \[(.*?)\]", plan)[1]


def test_stored_sparse_vectors_are_indexed(spark, tmp_path):
    held = spark.createDataFrame([(1, ([3, 9], [0.5, 2.0])), (2, ([9], [1.0])), (3, None), (4, ([5, 5], [1.0, 1.0]))], "id long, sparse struct<indices: array<int>, values: array<double>>")
    inverted.build(inverted.stored(held), f"file://{tmp_path}/i")
    assert rows(inverted.Index(spark, f"file://{tmp_path}/i").search(spark.createDataFrame([(1, "9 5")], "qid long, qtext string"), 5)) == [(1, 0, 1, round(2 * math.log(2), 4)), (1, 1, 4, round(2 * math.log(2), 4)), (1, 2, 2, round(math.log(2), 4))]


def vectors(spark, n, clusters, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (clusters, 16))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(0, 0.15 if clusters > 1 else 1.0, (n, 16))
    return spark.createDataFrame([(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)], "id long, vec array<float>, kind int").repartition(4)


def test_vector_index_recall_and_files(spark, tmp_path):
    """Clustered vectors: few cells are asked, and nearly all neighbours found; the exact search has the scan's hits."""
    v = vectors(spark, 3000, 40)
    q = v.filter("id % 50 = 0").selectExpr("id AS qid", "vec AS qvec")
    ivf.build(v, f"file://{tmp_path}/i")
    index, read = ivf.Index(spark, f"file://{tmp_path}/i"), []
    want = rows(R.dense_topk(q, v, 20))
    got = rows(index.search(q, 20))
    assert len({(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}) >= 0.95 * len(want)
    one = q.filter("qid = 100")
    assert rows(index.search(one, 20, exact=True, read=read)) == [r for r in want if r[0] == 100]
    assert sum(n for n, _ in read) * 3 < read[0][1]  # cells read of those there are
    assert rows(index.search(q, 20, probes=1, exact=True)) == want
    files = index.rows([3]).inputFiles()
    assert rows(index.search(q, 20, exact=True, filters={"kind": 1})) == rows(R.dense_topk(q, v, 20, {"kind": 1}))
    assert files and spark.read.parquet(f"{tmp_path}/i/probes").first().recall >= 0.97


def test_vectors_without_structure_still_reach_the_recall(spark, tmp_path):
    v = vectors(spark, 1200, 1)
    q = v.filter("id % 40 = 0").selectExpr("id AS qid", "vec AS qvec")
    ivf.build(v, f"file://{tmp_path}/i")
    want, got = (rows(x) for x in (R.dense_topk(q, v, 20), ivf.Index(spark, f"file://{tmp_path}/i").search(q, 20)))
    assert len({(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}) >= 0.95 * len(want)


def test_vectors_of_all_kinds(spark, tmp_path):
    """Zeros, other lengths, none, nulls within, few values and so many ties; queries of zeros and of a length that no row has."""
    rng = random.Random(1)
    vector = lambda: [float(rng.randrange(-2, 3)) for _ in range(4)]
    held = [(i, None if i % 50 == 7 else [0.0] * 4 if i % 50 == 8 else [1.0] if i % 50 == 9 else [0.0] * 2 if i % 50 == 10 else vector(), i % 3) for i in range(800)]
    v = spark.createDataFrame(held, "id long, vec array<float>, kind int")
    q = spark.createDataFrame([(i, None if i == 4 else [0.0] * 4 if i == 5 else [2.0] if i == 6 else [1.0] * 9 if i == 7 else vector()) for i in range(9)], "qid long, qvec array<double>")
    ivf.build(v.unionByName(spark.createDataFrame([(None, [1.0] * 4, 0), (9000, [None, 1.0, 1.0, 1.0], 0)], v.schema)), f"file://{tmp_path}/i")
    index = ivf.Index(spark, f"file://{tmp_path}/i")
    for filters in (None, {"kind": 1}):
        assert rows(index.search(q, 12, exact=True, filters=filters, block=3)) == rows(R.dense_topk(q, v, 12, filters))


def test_empty_indexes(spark, tmp_path):
    ivf.build(spark.createDataFrame([], "id long, vec array<float>"), f"file://{tmp_path}/v")
    inverted.build(inverted.terms(spark.createDataFrame([], "id long, text string")), f"file://{tmp_path}/t")
    q = spark.createDataFrame([(1, "a", [1.0])], "qid long, qtext string, qvec array<double>")
    assert rows(ivf.Index(spark, f"file://{tmp_path}/v").search(q, 5, exact=True)) == rows(inverted.Index(spark, f"file://{tmp_path}/t").search(q, 5)) == []


def test_postings_of_blocks_that_span_batches():
    """A row for each term of each block, ids rising, whatever the batches; a text's own pmid is looked for only where it can stand."""
    rows = [(7, 1, ["a", "b"], [1.0, 2.0]), (7, 3, ["b"], [0.5]), (9, 2, ["b", "a"], [3.0, 0.25])]
    schema = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("terms", pa.list_(pa.string())), ("weights", pa.list_(pa.float64()))])
    held = pa.table([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(4)], schema=schema)
    want = [("a", 7, 1.0, [1], [1.0]), ("b", 7, 2.0, [1, 3], [2.0, 0.5]), ("b", 9, 3.0, [2], [3.0]), ("a", 9, 0.25, [2], [0.25])]
    for size in (1, 2, 3):
        made = list(inverted.posted(iter(held.to_batches(size))))
        assert [tuple(r.values()) for b in made for r in b.to_pylist()] == want and all(len(b.schema) == 5 for b in made)
    assert list(inverted.posted(iter([]))) == []


def test_own_pmid_is_parsed_only_where_it_can_stand(monkeypatch):
    text = "<article><article-meta><article-id pub-id-type='p&#109;id'> 5 </article-id></article-meta></article>"
    assert markup.own_pmid(text) == "5" == markup.own_pmid(text.replace("&#109;", "m")) and markup.own_pmid(None) is None
    monkeypatch.setattr(markup.ET, "fromstring", None)
    assert markup.own_pmid("<article><body/></article>") is None
