"""The streaming ingest as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.corpus import RAW, raw_records
from quarry.sources.shared import fresh_path
from quarry.streaming import incremental


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records arrive in two deliveries, the second with all of the first again; the log has each key once."""
    folder = fresh_path(spark, "ingest")
    raw = raw_records(spark, sf_dir)
    schema = raw.schema
    raw.filter("pmcid < 'PMC5'").write.parquet(f"{folder}/in/a")
    incremental.ingest(spark, f"{folder}/in/*", schema, f"{folder}/status", f"{folder}/checkpoint")
    raw.write.parquet(f"{folder}/in/b")
    incremental.ingest(spark, f"{folder}/in/*", schema, f"{folder}/status", f"{folder}/checkpoint")
    return incremental.log(spark, f"{folder}/status").select("pmcid", "status")


QUERIES = {"incremental_ingest": incremental_ingest}
ORACLE_SQL: dict = {"incremental_ingest": RAW + "SELECT pmcid, status FROM dates"}
