"""Mixing: blocks of a real size, chosen by seed; targets met to within a block; the stage's spans are what is taken."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing
from quarry.llm.common import written
from tests.compare import same

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    """One source with a third of all rows and equal or null ids, others of all sizes; 1.1 million words, so blocks have 100 and more."""
    rows = [(None if i % 5 == 0 else 7, "hot", f"t{i} " + "w " * (i % 300)) for i in range(4000)] + [(i, f"s{i % 9}", "w " * (i % 90 + 5 * (i % 9))) for i in range(8000)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("own")).withColumn("note", F.lit(1))


def test_targets_to_within_a_block(spark, docs):
    got = mixing.mixed(docs.select("doc_id", "source", "text"), carry=["source", "doc_id"]).toPandas()
    each = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    words = int(got["size"].sum())
    block = min(512, words // (1000 * len(each)))
    assert block >= 50 and (abs(each.taken - each.target) <= block).all()
    assert (got.taken == got.passes * got["size"] + got.spans.map(lambda s: sum(r["stop"] - r["first"] for r in s))).all()
    assert got.spans.map(lambda s: all(0 <= r["first"] < r["stop"] for r in s)).all() and (got.taken <= 3 * got["size"]).all()


def test_documents_come_whole_or_not_at_all(spark):
    """At sf0.1 blocks have 100 to 200 words: most documents' shares are far from their source's ratio, another seed takes others."""
    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    one, two = (mixing.mixed(frame, seed=s, block=512).toPandas().sort_values("doc_id") for s in (11, 12))
    ratio = one.taken / one["size"].clip(lower=1) - one.target / one.source_size
    assert (abs(ratio) > 0.05).mean() > 0.5 and (one.taken.values != two.taken.values).mean() > 0.3


def test_hot_source_has_shards_by_its_size(spark, docs):
    z = written(mixing.sizes(docs), "sizes")
    d = mixing.Dialect()
    targets = mixing.run(spark, mixing.targets_sql(d, 3, 512), sizes=z)
    cells = mixing.run(spark, mixing.cells_sql(d), sizes=z, targets=written(targets, "targets")).toPandas()
    rows = cells.groupby("k").agg(n=("c", "size"), most=("c", "max"), words=("c", "sum"))
    assert rows.loc["shot"].n > 100 and rows.loc["shot"].most < 0.05 * rows.loc["shot"].words


def test_stage_keeps_columns_and_replaces_clashing_ones(spark, docs):
    out = mixing.stage(spark, docs, "")
    assert out.columns == ["doc_id", "source", "text", "note", "size", "source_size", "target", "taken", "passes", "spans"]
    assert out.count() == 12000 and dict(out.dtypes)["target"] == "double"


def test_seats_against_one_at_a_time(spark, tmp_path):
    """The CTEs' seats, for random votes, equal seats given one by one to the highest quotient."""
    import random

    rng = random.Random(3)
    for n in (1, 7, 100):
        votes = [(f"k{i}", rng.randint(1, 10 ** rng.randint(1, 5))) for i in range(12)]
        frame = spark.createDataFrame(votes, "k string, v long")
        got = mixing.run(spark, "WITH one AS (SELECT * FROM votes)," + mixing.seats(mixing.Dialect(), "quota", "one", ["k"], "v", str(n), "") + " SELECT * FROM quota", votes=frame)
        held = dict.fromkeys([k for k, _ in votes], 0)
        for _ in range(n):
            held[min(votes, key=lambda x: (-x[1] / (2 * held[x[0]] + 1), x[0]))[0]] += 1
        assert {r.k: r.q for r in got.collect()} == held


def test_against_sql_with_other_parameters(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for cap, block, seed in ((1, 512, 5), (2, 1, 11)):
        same(mixing.mixed(docs, cap, block, seed), mixing.oracle(cap, block, seed), DATA)
