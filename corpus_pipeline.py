"""A corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents. SQL cannot express the classifier, the language model or the
fingerprints, so ORACLE_SQL is None; the tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, langid, mixing, neardup, quality
from quarry.llm.common import WRITTEN, deleted, written

STAGES = [
    ("quality classifier", quality.stage),
    ("language ID", langid.stage),
    ("SimHash near-dedup", neardup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", mixing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's input, and what it wrote on the way, go when its output is written."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(WRITTEN)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
        deleted(spark, WRITTEN[start:-1])
    return docs
