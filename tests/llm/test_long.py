"""A text of some MB, and one of a single word of some MB, among short ones, through every operator that reads texts."""

import pytest

import corpus_pipeline
from quarry.llm import queries

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    words = WORDS.split()
    long = " ".join(words[(i * i + i // 7) % 12] + str(i % 977) for i in range(700_000))
    rows = [(1, long, "en", "a"), (2, "x" * 3_000_000, "en", "a"), (3, WORDS, "en", "b"), (4, long[:4_000_000] + " " + WORDS, "en", "b"), (5, None, None, None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(3, 1), (5, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, f"{WORDS} nu")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}"


@pytest.mark.parametrize("name", ["op2_quality", "op3_langid", "op4_sketch", "op5_mixing", "op7_notices", "op8_simhash", "op10_decontaminate"])
def test_operator(spark, folder, name):
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    if name == "op10_decontaminate":
        assert rows[1].n_words == 700_000 and rows[2].n_words == 1 and not any(r.contaminated for r in rows.values())
    if name == "op4_sketch":
        assert rows[1].n_chars > 5_000_000 and 0.7 < rows[1].near_edited <= 1


def test_pipeline(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() <= 5
