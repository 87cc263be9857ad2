"""Progress of a fetch as keyed state: a status for each key, retries after growing waits, and final states.

Outcomes arrive as a stream (pmcid, status). A key's state (status, attempt) is in the state store, so a micro-batch looks
at the keys that it brings, however long the log is. A status in `FINAL` ends a key: what comes later of it is ignored. Any
other counts an attempt and tells how long to wait before the next, twice as long with each; after `attempts` of them
the key is `given_up`, which is final. What is written is the changes alone: (pmcid, status, attempt, at, wait_ms); `due`
says which keys are to be asked again by now. No timers are used: with them a run over what is there would never end.

The state store is RocksDB in the checkpoint's folder, as `transformWithStateInPandas` asks; a restart goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.fetch import FINAL
from quarry.operators.records import latest

CHANGES = "pmcid string, status string, attempt int, wait_ms long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Progress(StatefulProcessor):
    def __init__(self, final: tuple[str, ...] = (*FINAL, "given_up"), wait_ms: int = 60_000, attempts: int = 8):
        self.final, self.wait_ms, self.attempts = final, wait_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", "status string, attempt int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempt = self.state.get() if self.state.exists() else (None, 0)
        if status in self.final:
            return
        # Of several outcomes in one batch a final one counts, else the last by its name: not by the order in which they came.
        told = sorted({x for batch in rows for x in batch.status if isinstance(x, str)}, key=lambda x: (x in self.final, x))
        if not told:
            return
        attempt, status = attempt + 1, told[-1]
        if status not in self.final and attempt >= self.attempts:
            status = "given_up"
        self.state.update((status, attempt))
        wait = None if status in self.final else self.wait_ms << (attempt - 1)
        yield pd.DataFrame({"pmcid": [key[0]], "status": [status], "attempt": pd.array([attempt], "Int32"), "wait_ms": pd.array([wait], "Int64")})

    def close(self) -> None:
        pass


def track(outcomes: DataFrame, sink: str, checkpoint: str, processor: Progress | None = None) -> None:
    """Appends the changes (CHANGES) that a stream of outcomes (pmcid, status) makes to sink (Parquet); what is there is processed, then it ends."""
    spark = outcomes.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        known = outcomes.filter("pmcid IS NOT NULL").groupBy("pmcid")
        changes = known.transformWithStateInPandas(processor or Progress(), CHANGES, "Update", "None")
        changes.writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{sink}/batch={n:08d}-rows")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def current(spark: SparkSession, sink: str) -> DataFrame:
    """(pmcid, status, attempt, at, wait_ms): each key's last change."""
    return latest(spark.read.schema(f"{CHANGES}, at timestamp").parquet(f"{sink}/*"), "pmcid", "attempt").select("pmcid", "status", "attempt", "at", "wait_ms")


def due(spark: SparkSession, sink: str) -> DataFrame:
    """The keys (pmcid) without a final status whose wait is over."""
    return current(spark, sink).filter(F.unix_millis("at") + F.col("wait_ms") <= F.unix_millis(F.current_timestamp())).select("pmcid")
