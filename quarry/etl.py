"""The stages from raw answers to vector rows, each a step over tables in one folder; and reprocessing of papers without paragraphs.

1. What a remote answered becomes raw metadata and full texts, and a status for each key.
2. Valid metadata become rows of `papers`; abstracts become chunks with vectors.
3. Full texts become paragraphs, chunks with their paper's journal and year, vectors, and rows of `chunks` by id.

Every table is written under a new name and read from there, and keys decide what replaces what, so a stage that is run again
leaves what it left before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, fetch, markup, providers, records
from quarry.sources.shared import deleted


def put(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fetch_raw(spark: SparkSession, answers: DataFrame, out: str) -> dict[str, DataFrame]:
    """Raw metadata, full texts and the status of each key from answers (pmcid, xml, mapped, record_xml)."""
    found = put(fetch.outcomes(answers), f"{out}/outcomes")
    metadata = found.filter("outcome = 'fetched'").select("pmcid", "pmid", F.lit(False).alias("no_pubmed_record"), "record.*")
    made = {"metadata": put(metadata, f"{out}/metadata"), "fulltext": put(found.filter("xml IS NOT NULL").select("pmcid", "xml"), f"{out}/fulltext"), "status": put(found.select("pmcid", F.col("outcome").alias("status")), f"{out}/status")}
    deleted(spark, f"{out}/outcomes")
    return made


def vectors(chunks: DataFrame, dense: Callable, sparse: Callable, batch: int = 200, wait: float = 1.0) -> DataFrame:
    """Chunks with both vectors, and a number that orders them: a later chunk of equal id stays."""
    return providers.embedded_both(chunks, dense, sparse, batch, wait).withColumn("seq", F.col("chunk_index"))


def kept(spark: SparkSession, chunks: DataFrame, out: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Vector rows of chunks, and the papers that lack a vector. The chunks are embedded once, into a table that goes when both are written."""
    rows = put(chunks, f"{out}/{kind}_vectors")
    made = put(records.points(rows, stored=True), f"{out}/{kind}_chunks"), put(records.failed(rows, "pmcid", "dense", "sparse"), f"{out}/{kind}_failed")
    deleted(spark, f"{out}/{kind}_vectors")
    return made


def process_metadata(spark: SparkSession, metadata: DataFrame, out: str, dense: Callable, sparse: Callable, wait: float = 1.0) -> dict[str, DataFrame]:
    papers = put(records.papers(metadata), f"{out}/papers")
    chunks, failed = kept(spark, vectors(chunking.abstract_chunks(papers), dense, sparse, wait=wait), out, "abstract")
    return {"papers": papers, "abstract chunks": chunks, "failed": failed}


def fulltext_vectors(fulltext: DataFrame, papers: DataFrame, dense: Callable, sparse: Callable, batch: int = 200, wait: float = 1.0) -> DataFrame:
    chunks = chunking.chunks(markup.paragraphs(fulltext.select("pmcid", "xml")))
    return vectors(records.lookup(chunks, papers, "pmcid", ["pub_year", "journal"]), dense, sparse, batch, wait)


def process_fulltext(spark: SparkSession, fulltext: DataFrame, papers: DataFrame, out: str, dense: Callable, sparse: Callable, wait: float = 1.0) -> dict[str, DataFrame]:
    chunks, failed = kept(spark, fulltext_vectors(fulltext, papers, dense, sparse, wait=wait), out, "fulltext")
    return {"fulltext chunks": chunks, "failed": failed}


def run(spark: SparkSession, answers: DataFrame, out: str, dense: Callable = providers.letters, sparse: Callable = providers.term_weights, wait: float = 1.0) -> dict[str, DataFrame]:
    """All three stages; the tables by name."""
    raw = fetch_raw(spark, answers, out)
    meta = process_metadata(spark, raw["metadata"], out, dense, sparse, wait)
    full = process_fulltext(spark, raw["fulltext"], meta["papers"], out, dense, sparse, wait)
    return {"papers": meta["papers"], "abstract chunks": meta["abstract chunks"], "fulltext chunks": full["fulltext chunks"], "status": raw["status"]}


def summary(spark: SparkSession, made: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table, and of each status."""
    out = made["status"].groupBy(F.concat(F.lit("status "), F.col("status")).alias("name")).agg(F.count("*").alias("n"))
    for name in ("papers", "abstract chunks", "fulltext chunks"):
        out = out.unionByName(made[name].agg(F.lit(name).alias("name"), F.count("*").alias("n")))
    return out


def reprocess(report: DataFrame, files: DataFrame, papers: DataFrame, dense: Callable, sparse: Callable, dry_run: bool = False, batch: int = 200, wait: float = 1.0) -> DataFrame:
    """What comes of the papers that report (pmcid, status) calls FAIL, from files (pmcid, xml) that are there.

    dry_run: (pmcid, present) alone, nothing is parsed or embedded. Else (pmcid, outcome, n_chunks, n_written): `missing`,
    `still_empty`, `embed_failed` if a chunk lacks a vector, or `success`.
    """
    failed = report.filter("status = 'FAIL'").select("pmcid").distinct()
    present = failed.join(files.select("pmcid", F.lit(True).alias("present")).distinct(), "pmcid", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    if dry_run:
        return present
    chunks = fulltext_vectors(files.join(failed, "pmcid", "left_semi"), papers, dense, sparse, batch, wait)
    whole = F.col("dense").isNotNull() & F.col("sparse").isNotNull()
    each = chunks.groupBy("pmcid").agg(F.count("*").alias("n_chunks"), F.sum(whole.cast("long")).alias("n_written"))
    rows = present.join(each, "pmcid", "left").na.fill(0, ["n_chunks", "n_written"])
    outcome = F.when(~F.col("present"), "missing").when(F.col("n_chunks") == 0, "still_empty").when(F.col("n_written") < F.col("n_chunks"), "embed_failed").otherwise("success")
    return rows.select("pmcid", outcome.alias("outcome"), "n_chunks", "n_written")
