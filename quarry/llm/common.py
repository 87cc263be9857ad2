"""What the operators of this subpackage share: the shared folder, folds, and text as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import fresh_path, shared_folder  # noqa: F401  operators take both from here


#: The tables written so far, by path; what a caller no longer reads can be deleted (`deleted`).
WRITTEN: list[str] = []


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives the loss of any executor. options: the writer's."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


def input_bytes(df: DataFrame) -> int:
    """What the planner takes the size of df to be: that of its files, scaled to its columns; 0 where it has no idea."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def unused(df: DataFrame, name: str) -> str:
    """name, or with as many more underscores before it as it takes to be none of df's columns."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of UTF-8 to bytes: A-Z to a-z, 0-9 and a-z and all of 0x80 and above as they are, the rest to a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A-Z to a-z, the rest as it is.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Texts that a task has as Python strings at once, if it takes them from Arrow.
SLICE = 256


def slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """A batch as Spark sends it (10,000 rows) is held as Arrow alone; its texts come SLICE at a time."""
    for at in range(0, len(texts), SLICE):
        yield texts.slice(at, SLICE).to_pylist()


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
