"""Fetching raw records: what a remote answers for each key, what comes of it, and resuming where it stopped.

A remote is asked from the executors, a partition's keys one after the other with a pause between requests; a request that
fails is a null, never a failed task. What the answers mean is column functions over them, so stored answers (a table) and
fresh ones are judged alike.

Outcomes of a key, in this order: `failed` (to be tried again) without an acceptable full text; `no_pmid` (final) if neither
the mapping nor the full text's own metadata has one; `failed` if the record can't be had or read; else `fetched` (final).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import markup
from quarry.operators.records import latest

FINAL = ["fetched", "no_pmid"]
ANSWERS = "pmcid string, xml string, mapped string, record_xml string"


class Remote(Protocol):
    """Each answers None if it has nothing; it may raise."""

    def fulltext(self, pmcid: str) -> str | None: ...

    def pmid(self, pmcid: str) -> str | None: ...

    def record(self, pmid: str) -> str | None: ...


class Search(Protocol):
    """A paged search: how many ids there are, and those from `start` on, `size` at most; either may raise."""

    def total(self) -> int: ...

    def page(self, start: int, size: int) -> list[str]: ...


def repeated(call: Callable, wait: float, attempts: int, sleep: Callable[[float], None] = time.sleep, growth: float = 1.0) -> object:
    """call, again after a wait (`growth` times as long with each) for as long as it fails; the last failure is raised, and the task tried elsewhere."""
    for n in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001  a request may fail in any way; the same page is asked for again
            if n + 1 == attempts:
                raise
            sleep(wait * growth**n)
    raise ValueError("no attempt")


def search_ids(spark: SparkSession, make: Callable[[], Search], page: int = 200, pause: float = 0.15, wait: float = 5.0, attempts: int = 1000) -> DataFrame:
    """(page, pmcid): all ids that a remote search finds, a task for each of its pages; a page that fails is asked for again.

    The first request tells how many there are; ids get the prefix PMC, in the search's order within their page.
    """
    total = int(repeated(make().total, wait, attempts))
    pages = -(-total // page)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = make()
        for batch in batches:
            for n in batch.id.tolist():
                time.sleep(pause)
                ids = repeated(lambda n=n, search=search: search.page(n * page, page), wait, attempts)
                yield pd.DataFrame({"page": n, "pmcid": [f"PMC{i}" for i in ids]}).astype({"page": "int64"})

    return spark.range(0, pages, 1, max(1, min(pages, 200))).mapInPandas(ask, "page long, pmcid string")


def accepted(xml: Column) -> Column:
    """Whether a full-text answer is one: it holds an article or a set of them."""
    return F.coalesce(F.contains(xml, F.lit("<article")) | F.contains(xml, F.lit("<pmc-articleset")), F.lit(False))


def asked(call: Callable[[str], str | None], key: str | None) -> str | None:
    if not key:
        return None
    try:
        return call(key)
    except Exception:  # noqa: BLE001  a request may fail in any way; the key is tried again another time
        return None


def answers(keys: DataFrame, make: Callable[[], Remote], pause: float = 0.15) -> DataFrame:
    """(pmcid, xml, mapped, record_xml): a remote's answers for keys (pmcid); it is made once a task."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remote = make()

        def waited(call: Callable[[str], str | None], key: str | None) -> str | None:
            time.sleep(pause if key else 0)
            return asked(call, key)

        for batch in batches:
            rows = []
            for key in batch.pmcid:
                xml = waited(remote.fulltext, key)
                pmid = waited(remote.pmid, key) if xml else None
                rows.append((key, xml, pmid, waited(remote.record, pmid or markup.own_pmid(xml)) if xml else None))
            yield pd.DataFrame(rows, columns=["pmcid", "xml", "mapped", "record_xml"], dtype=object)

    return keys.select("pmcid").mapInPandas(ask, ANSWERS)


def outcomes(rows: DataFrame) -> DataFrame:
    """(pmcid, outcome, pmid, xml, record): what answers come to. record: the parsed metadata of a fetched key, else null."""
    known = rows.withColumn("ok", accepted(F.col("xml")))
    pmid = F.when(F.col("ok"), F.coalesce(F.nullif(F.trim("mapped"), F.lit("")), F.nullif(markup.column(markup.own_pmid, "string")("xml"), F.lit(""))))
    known = known.withColumn("pmid", pmid).withColumn("record", markup.column(markup.parse_pubmed, markup.RECORD)("record_xml"))
    outcome = (
        F.when(~F.col("ok"), "failed")
        .when(F.col("pmid").isNull(), "no_pmid")
        .when(F.col("record_xml").isNull() | F.col("record.parse_error").isNotNull(), "failed")
        .otherwise("fetched")
    )
    known = known.withColumn("outcome", outcome)
    return known.select("pmcid", "outcome", "pmid", F.when(F.col("ok"), F.col("xml")).alias("xml"), F.when(F.col("outcome") == "fetched", F.col("record")).alias("record"))


def todo(keys: DataFrame, log: DataFrame) -> DataFrame:
    """The distinct keys (pmcid) whose latest status in log (pmcid, status, attempt) is not final."""
    final = latest(log, "pmcid", "attempt").filter(F.col("status").isin(FINAL))
    return keys.select("pmcid").distinct().join(final, "pmcid", "left_anti")


def logged(log: DataFrame, found: DataFrame) -> DataFrame:
    """log with one more entry for each key of found (pmcid, outcome): its next attempt."""
    so_far = log.groupBy("pmcid").agg(F.max("attempt").alias("attempt"))
    new = found.select("pmcid", "outcome").join(so_far, "pmcid", "left").select("pmcid", F.col("outcome").alias("status"), (F.coalesce("attempt", F.lit(0)) + 1).cast("int").alias("attempt"))
    return log.select("pmcid", "status", "attempt").unionByName(new)
