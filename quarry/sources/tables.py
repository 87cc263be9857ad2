"""Tables by name, and readers and sinks for raw records and markup."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.records import validity
from quarry.sources.keyed import KeyedTable, Taken
from quarry.sources.shared import exists, written

METADATA_SCHEMA = (
    "pmcid string, pmid string, doi string, title string, abstract string, authors array<string>, journal string, pub_year string, "
    "pub_month string, pub_day string, keywords array<string>, article_types array<string>, no_pubmed_record boolean, parse_error string, _corrupt string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stem() -> Column:
    """A file's key: that of its folder (`pmcid=KEY`), else its name without its ending."""
    path = F.col("_metadata.file_path")
    folder, name = F.regexp_extract(path, r"pmcid=([^/]+)/[^/]*$", 1), F.regexp_extract(path, r"([^/]+?)(\.[a-z]+)?$", 1)
    return F.when(folder != "", folder).otherwise(name)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per file, with an explicit schema; `stem` is the file's key, and a malformed file has only `_corrupt`."""
    rows = spark.read.schema(METADATA_SCHEMA).option("recursiveFileLookup", "true").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return rows.withColumn("stem", stem()).withColumn("pmcid", F.coalesce("pmcid", "stem"))


def scanned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw records as read: those that could be, and (pmcid, status) of every one, `parse_error` for malformed files. One reading, two outputs."""
    status = F.when(F.col("_corrupt").isNotNull(), "parse_error").otherwise(validity())
    marked = rows.withColumn("status", status)
    return marked.filter("status = 'valid'").drop("status", "_corrupt"), marked.select(F.col("stem").alias("pmcid"), "status")


def read_markup(spark: SparkSession, path: str) -> DataFrame:
    """(pmcid, xml): one file per document, its key the file's."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(stem().alias("pmcid"), F.col("value").alias("xml"))


def write_keyed(rows: DataFrame, path: str, value: str) -> None:
    """One file for each key (pmcid) and its text, in a folder of its own; writing a key again replaces its folder alone."""
    rows.select("pmcid", value).repartition("pmcid").write.partitionBy("pmcid").option("partitionOverwriteMode", "dynamic").mode("overwrite").text(path)


def packed(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """A keyed store of texts in which many keys share a file: as many files as buckets, whatever the number of keys; made if absent.

    Writing keys again replaces their bodies in one step; a lookup reads the keys' buckets, and of these the parts whose statistics
    hold them. Buckets should hold some ten MB each.
    """
    held = KeyedTable(spark, path)
    if not held.versions():
        with contextlib.suppress(Taken):
            held.create(spark.createDataFrame([], "pmcid string, body string"), "pmcid", buckets)
    return held


def pack(rows: DataFrame, path: str, value: str, buckets: int = 64) -> KeyedTable:
    """rows (pmcid, value) in the packed store at path."""
    held = packed(rows.sparkSession, path, buckets)
    held.upsert(rows.select("pmcid", F.col(value).alias("body")))
    return held


def packed_metadata(held: KeyedTable) -> DataFrame:
    """The store's bodies as records, like `read_metadata`: a malformed one has only `_corrupt` and its key."""
    parsed = F.from_json("body", METADATA_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = held.read().select(F.col("pmcid").alias("stem"), parsed.alias("x")).select("stem", "x.*")
    return rows.withColumn("pmcid", F.coalesce("pmcid", "stem"))


def packed_markup(held: KeyedTable) -> DataFrame:
    return held.read().select("pmcid", F.col("body").alias("xml"))


def write_metadata(records: DataFrame, path: str) -> None:
    """Keyed JSON sink: a record is the one JSON file in its key's folder."""
    write_keyed(records.select("pmcid", F.to_json(F.struct("*")).alias("json")), path, "json")


def write_fulltext(rows: DataFrame, path: str) -> None:
    """Keyed markup sink of rows (pmcid, xml)."""
    write_keyed(rows, path, "xml")


def write_report(rows: DataFrame, path: str) -> None:
    """A report, a few rows at most, as one JSON file; a new one replaces the old."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def cached_ids(spark: SparkSession, path: str, search: Callable[[], DataFrame]) -> DataFrame:
    """The id list at path if there is one, else what search gives, kept there first."""
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        search().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Tables that are made if they are absent; key columns first.
TABLES = {
    "papers": "pmcid string not null, pmid string, doi string, title string not null, authors array<string>, journal string, pub_year string, pub_month string, pub_day string, pub_date date, keywords array<string>, article_types array<string>, abstract string",
    "agent_sessions": "session_id string not null, summary string not null, history string not null, retrieved_chunks string not null, updated_at timestamp not null",
    "chunks": "id string not null, pmcid string, source_type string, section string, chunk_index int, text string, pub_year string, journal string, dense array<float>, sparse struct<indices: array<int>, values: array<float>>",
}


def columns_of(columns: str) -> list[str]:
    """The columns of a definition, cut at commas outside of brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [c.strip() for c in out]


def ensure_tables(spark: SparkSession, database: str, tables: dict[str, str] = TABLES) -> None:
    """The tables of a database, and it, where they are absent; what is there stays as it is."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def id_pages(spark: SparkSession, ids: DataFrame, page: int = 200) -> DataFrame:
    """(page, pmcid): a paged scan of distinct ids in order, `page` ids a page. The offline stand-in of a remote paged search.

    Ids are dealt to ranges and numbered there; a range's first number is the size of those before it. Nothing is sorted in
    one task; only the ranges' sizes meet. The ranges are written first, so that both readings see the same ones.
    """
    ranges = ids.select("pmcid").filter("pmcid IS NOT NULL").distinct().repartitionByRange("pmcid").sortWithinPartitions("pmcid")
    rows = written(ranges.select("pmcid", F.monotonically_increasing_id().alias("n")).select("pmcid", F.shiftright("n", 33).alias("part"), F.col("n").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ranges")
    sizes = rows.groupBy("part").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = rows.join(sizes.select("part", before.alias("skip")), "part")
    return place.select(F.floor((F.col("at") + F.col("skip")) / page).cast("long").alias("page"), "pmcid")
