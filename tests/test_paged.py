"""The paged data source: batches, streams and writes, against a search and a sink that keep files."""

import json
import os
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from quarry.sources import paged


class Counted:
    """A search of n ids (n is in a file), which notes every request; each of the `broken` pages fails the first time that it is asked for."""

    def __init__(self, folder, broken=()):
        self.folder, self.broken = pathlib.Path(folder), broken

    def total(self):
        return int((self.folder / "n").read_text())

    def page(self, start, size):
        seen = any(x.name.startswith(f"asked-{start}-") for x in self.folder.iterdir())
        (self.folder / f"asked-{start}-{size}-{time.time_ns()}").touch()
        if start // 100 in self.broken and not seen:
            raise OSError("busy")
        return [str(i) for i in range(start, min(self.total(), start + size))]


def asked(folder):
    """The requests so far, (start, size), and forgets them."""
    found = [x for x in pathlib.Path(folder).iterdir() if x.name.startswith("asked")]
    out = sorted(tuple(int(v) for v in x.name.split("-")[1:3]) for x in found)
    for x in found:
        x.unlink()
    return out


class Files:
    """A sink in a folder: staged files, and one list of what is shown."""

    def __init__(self, folder, fails=None):
        self.folder, self.fails = pathlib.Path(folder), fails

    def put(self, run, batch, rows):
        if self.fails is not None and any(r["id"] == self.fails for r in rows):
            raise OSError("full")
        (self.folder / "staged" / run).mkdir(parents=True, exist_ok=True)
        (self.folder / "staged" / run / batch).write_text(json.dumps(rows))

    def publish(self, run, batches, name, overwrite):
        at = self.folder / "staged" / run
        rows = [r for b in batches for r in json.loads((at / b).read_text())]
        shown = {} if overwrite else self.shown()
        (self.folder / "new").write_text(json.dumps(shown | {name: rows}))
        os.replace(self.folder / "new", self.folder / "shown")
        self.discard(run)

    def discard(self, run):
        at = self.folder / "staged" / run
        for x in at.iterdir() if at.exists() else ():
            x.unlink()

    def shown(self):
        at = self.folder / "shown"
        return json.loads(at.read_text()) if at.exists() else {}

    def left(self):
        return [x for x in self.folder.glob("staged/*/*")]


def read(spark, folder, n, broken=(), **options):
    (folder / "n").write_text(str(n))
    place = str(folder)
    paged.register(spark, "counted", make=lambda: Counted(place, broken))
    return spark.read.format("counted").options(page=100, task=2, pause=0, wait=0, **options).load()


def test_every_page_is_asked_for_once(spark, tmp_path):
    df = read(spark, tmp_path, 450)
    assert df.rdd.getNumPartitions() == 3
    asked(tmp_path)
    assert sorted(map(tuple, df.collect())) == sorted((i // 100, f"PMC{i}") for i in range(450))
    assert asked(tmp_path) == [(0, 100), (100, 100), (200, 100), (300, 100), (400, 50)]
    assert read(spark, tmp_path, 0).collect() == []
    with pytest.raises(Exception, match="page must be at least 1"):
        spark.read.format("counted").option("page", 0).load().collect()


@pytest.mark.parametrize(
    ("where", "pages"),
    [("page = 2", [2]), ("page > 1 AND page <= 3", [2, 3]), ("page >= 4", [4]), ("page < 0", []), ("page > 3 AND page < 3", []), ("page IN (1, 3)", [1, 2, 3]), ("page = 2 AND pmcid LIKE '%7'", [2]), ("page > 90", []), ("page IS NOT NULL AND page < 1", [0]), ("page <> 3", [0, 1, 2, 3, 4]), ("page = 1 OR page = 3", [0, 1, 2, 3, 4])],  # Spark hands no OR to a source
)
def test_pages_that_a_filter_rules_out_are_not_asked_for(spark, tmp_path, where, pages):
    all_rows = spark.createDataFrame([(i // 100, f"PMC{i}") for i in range(450)], "page long, pmcid string")
    df = read(spark, tmp_path, 450).filter(where)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, all_rows.filter(where).collect()))
    assert sorted({s // 100 for s, _ in asked(tmp_path)}) == pages


def test_a_page_that_fails_is_asked_for_again_alone(spark, tmp_path):
    df = read(spark, tmp_path, 450, broken=(1, 3))
    assert df.count() == 450
    assert [s for s, _ in asked(tmp_path)] == [0, 100, 100, 200, 300, 300, 400]


def test_a_stream_asks_for_what_was_added(spark, tmp_path):
    read(spark, tmp_path, 250)

    def run():
        rows = spark.readStream.format("counted").options(page=100, task=2, pause=0, wait=0).load()
        rows.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start(f"file://{tmp_path}/sink").awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/sink").collect()))

    assert run() == sorted((i // 100, f"PMC{i}") for i in range(250))
    asked(tmp_path)
    (tmp_path / "n").write_text("610")
    assert run() == sorted((i // 100, f"PMC{i}") for i in range(610))
    assert asked(tmp_path) == [(250, 50), (300, 100), (400, 100), (500, 100), (600, 10)]
    assert len(run()) == 610 and asked(tmp_path) == []


def test_writes_appear_whole_or_not_at_all(spark, tmp_path):
    place = str(tmp_path)
    rows = spark.range(0, 730, 1, 3).select("id", F.when(F.col("id") % 2 == 0, F.struct(F.col("id").alias("x"))).alias("inner"))
    paged.register(spark, "kept", sink=lambda: Files(place))
    paged.register(spark, "refusing", sink=lambda: Files(place, 500))
    write = lambda df, name, mode: df.write.format(name).mode(mode).option("batch", 100).option("wait", 0).save()
    write(rows, "kept", "append")
    shown = lambda: sorted((r["id"], (r["inner"] or {}).get("x")) for rows in Files(place).shown().values() for r in rows)
    whole = [(i, i if i % 2 == 0 else None) for i in range(730)]
    assert shown() == whole and Files(place).left() == []
    with pytest.raises(Exception, match="full"):
        write(rows, "refusing", "append")
    assert shown() == whole and Files(place).left() == []
    write(rows.filter("id < 5"), "kept", "append")
    assert sorted(shown(), key=str) == sorted(whole + whole[:5], key=str)
    write(rows.filter("id < 5"), "kept", "overwrite")
    assert shown() == whole[:5]
    write(rows.filter("id < 0"), "kept", "overwrite")
    assert shown() == []


def test_a_stream_that_is_written_again_replaces_its_batches(spark, tmp_path):
    place = str(tmp_path)
    paged.register(spark, "kept", sink=lambda: Files(place))
    spark.range(40).write.parquet(f"file://{tmp_path}/in/a")

    def run(checkpoint):
        rows = spark.readStream.schema("id long").parquet(f"file://{tmp_path}/in/*")
        rows.writeStream.format("kept").options(stream="ids", batch=7, wait=0).option("checkpointLocation", f"file://{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
        return {k: sorted(r["id"] for r in v) for k, v in Files(place).shown().items()}

    assert run("one") == {"ids/0": list(range(40))}
    spark.range(40, 50).write.parquet(f"file://{tmp_path}/in/b")
    assert run("one") == {"ids/0": list(range(40)), "ids/1": list(range(40, 50))}
    assert run("two") == {"ids/0": list(range(50)), "ids/1": list(range(40, 50))}  # from the start: batch 0 is made again
    assert Files(place).left() == []
