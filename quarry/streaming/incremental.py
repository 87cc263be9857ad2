"""Resumable ingest as a stream: every document is processed once, whatever is restarted, and each step is idempotent."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.records import validity
from quarry.sources.shared import exists


STATUS = "pmcid string, status string, run string, batch long"
#: Statuses from the best to the worst; of a key that comes twice in a batch the best counts.
ORDER = ["valid", "no_title", "article_types_invalid", "no_pmid"]


def ingest(spark: SparkSession, source: str, schema: str, status: str, checkpoint: str, outcome: Callable = None, files: int = 4) -> None:
    """Reads new files of `source` (Parquet), `files` at a time, and appends (pmcid, status, run, batch) of unseen keys to `status`.

    A key already in the log is skipped by an anti-join against the log's keys alone. A batch's folder bears the name of its
    checkpoint and its number, and is overwritten: a batch that runs again after a failure leaves the log as if it had run
    once, and a new checkpoint adds to an old log.
    """
    outcome = validity() if outcome is None else outcome
    run = hashlib.sha1(checkpoint.encode(), usedforsecurity=False).hexdigest()[:12]

    def step(batch: DataFrame, number: int) -> None:
        rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("status")), F.lit(0))
        new = batch.withColumn("status", outcome).groupBy("pmcid").agg(F.min(F.struct(F.when(rank > 0, rank).otherwise(len(ORDER) + 1).alias("rank"), "status")).alias("x")).select("pmcid", "x.status")
        name = f"{status}/batch={run}-{number:08d}-rows"
        seen = log(spark, status).filter((F.col("run") != run) | (F.col("batch") < number)).select("pmcid") if exists(spark, status) else None
        if seen is not None:
            new = new.join(seen, "pmcid", "left_anti")
        new.withColumns({"run": F.lit(run), "batch": F.lit(number).cast("long")}).write.mode("overwrite").parquet(name)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def log(spark: SparkSession, status: str) -> DataFrame:
    return spark.read.schema(STATUS).parquet(f"{status}/*")


def totals(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """(day, event_type, n) of a stream or a table of events (ts, event_type): counts by window; the watermark closes a stream's."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("day"), "event_type", "n")


def totals_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> None:
    """Appends the closed windows of a stream of events to sink (Parquet)."""
    rows = totals(spark.readStream.schema(schema).parquet(source))
    rows.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
