"""A remote collection as a Spark data source: read in pages, followed as a stream, written in batches that appear all at once.

    register(spark, "ids", make=Search)          spark.read.format("ids"), spark.readStream.format("ids")
    register(spark, "points", sink=Sink)         df.write.format("points"), df.writeStream.format("points")

Reading gives (page, pmcid), ids with the prefix PMC. A partition is a range of pages; each request is repeated with growing
waits, and when it keeps failing the task fails and Spark asks again for that partition's pages only. Comparisons of `page`
with a number are pushed down: pages that they rule out are not asked for. A stream's offset is the number of ids given out
so far; it asks for those that were added behind them, so the search must keep its order and only grow. Nothing else is
remembered, hence a restart from the checkpoint goes on where it stopped.

Writing stages batches of rows under the name of a run. When all tasks are done the batches of the attempts that counted are
published in one call; else the run is discarded. A stream publishes each micro-batch under its number and the option
`stream`, which must name one query alone, so a micro-batch that runs again replaces itself.

Options (reading): page = 200 ids a request, task = 10 pages a partition, pause = 0.15 s before and wait = 1 s after a failed
request (doubled with each), attempts = 6. Options (writing): batch = 100 rows, wait, attempts, stream.
An empty search and an empty table have no rows and no pages; nulls and repeated rows are written as they are.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from quarry.operators.fetch import Search, repeated

SCHEMA = "page long, pmcid string"
ARROW = pa.schema([("page", pa.int64()), ("pmcid", pa.string())])


class Sink(Protocol):
    """Where batches go. Each call may raise and be repeated, so each must leave the same if it is made again."""

    def put(self, run: str, batch: str, rows: list[dict]) -> None:
        """Keeps rows under a run's batch, unseen by readers."""

    def publish(self, run: str, batches: list[str], name: str, overwrite: bool) -> None:
        """Shows exactly these batches of a run under a name, in one step, in place of what had that name (overwrite: of all).

        Other batches of the run, of attempts that did not count, are forgotten.
        """

    def discard(self, run: str) -> None:
        """Forgets what a run has staged; what was published stays."""


class Settings:
    """The options of a source, checked."""

    def __init__(self, options: dict):
        self.page, self.task, self.batch = (self.whole(options, *x) for x in (("page", 200), ("task", 10), ("batch", 100)))
        self.attempts = self.whole(options, "attempts", 6)
        self.pause, self.wait = float(options.get("pause", 0.15)), float(options.get("wait", 1.0))
        self.stream = options.get("stream")

    @staticmethod
    def whole(options: dict, name: str, usual: int) -> int:
        value = int(options.get(name, usual))
        if value < 1:
            raise ValueError(f"{name} must be at least 1, not {value}")
        return value

    def again(self, call: Callable) -> object:
        return repeated(call, self.wait, self.attempts, growth=2.0)


class Ids(InputPartition):
    """Ids from `start` to before `end`, by their places in the search's order."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class Asking:
    """What both readers do: cut ranges of ids into tasks, and ask for a task's."""

    def __init__(self, make: Callable[[], Search], settings: Settings):
        self.make, self.settings = make, settings

    def total(self) -> int:
        return int(self.settings.again(self.make().total))

    def cut(self, start: int, end: int) -> list[Ids]:
        """Tasks between two places; their inner bounds are those of pages."""
        size = self.settings.page * self.settings.task
        bounds = [start, *range((start // size + 1) * size, end, size), end]
        return [Ids(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if a < b]

    def ask(self, part: Ids) -> Iterator[pa.RecordBatch]:
        search, page, at = self.make(), self.settings.page, part.start
        while at < part.end:
            size = min(part.end, (at // page + 1) * page) - at
            time.sleep(self.settings.pause)
            # A search may give more than it was asked for, or (at its end) less.
            ids = self.settings.again(lambda at=at, size=size: search.page(at, size))[:size]
            yield pa.RecordBatch.from_arrays([pa.array([at // page] * len(ids), pa.int64()), pa.array([f"PMC{i}" for i in ids], pa.string())], schema=ARROW)
            at += size


def narrowed(low: float, high: float, f: Filter) -> tuple[float, float] | None:
    """The range [low, high] of pages under one more filter; None if the filter says nothing of it."""
    if not isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) or f.attribute != ("page",):
        return None
    values = [v for v in f.value if v is not None] if isinstance(f, In) else [f.value]
    if not all(isinstance(v, int) and not isinstance(v, bool) for v in values):
        return None
    if isinstance(f, EqualTo | In):
        return (max(low, min(values)), min(high, max(values))) if values else (1, 0)
    if isinstance(f, GreaterThan | GreaterThanOrEqual):
        return max(low, f.value + isinstance(f, GreaterThan)), high
    return low, min(high, f.value - isinstance(f, LessThan))


class PageReader(Asking, DataSourceReader):
    low, high = 0, math.inf

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the pages that are asked for. What is not exactly a range stays with Spark as well."""
        for f in filters:
            found = narrowed(self.low, self.high, f)
            if found is not None:
                self.low, self.high = found
            if found is None or isinstance(f, In):
                yield f

    def partitions(self) -> list[InputPartition]:
        page = self.settings.page
        end = self.total() if self.high >= self.low else 0
        return self.cut(min(end, self.low * page), int(min(end, (self.high + 1) * page)))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.ask(partition) if partition is not None else iter(())


class PageStream(Asking, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"ids": 0}

    def latestOffset(self) -> dict:
        return {"ids": self.total()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.cut(start["ids"], end["ids"])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.ask(partition)

    def commit(self, end: dict) -> None:
        """The remote keeps no place for us."""


class Staged(WriterCommitMessage):
    """The batches of a task that ended well."""

    def __init__(self, batches: list[str]):
        self.batches = batches


class Staging:
    """What both writers do: a task's rows go to the sink batch by batch, never more than one batch in memory."""

    def __init__(self, make: Callable[[], Sink], settings: Settings, overwrite: bool):
        self.make, self.settings, self.overwrite, self.run = make, settings, overwrite, uuid.uuid4().hex

    def staged(self, run: str, rows: Iterator[Row]) -> Staged:
        sink, task, names, held = self.make(), uuid.uuid4().hex, [], []

        def flush() -> None:
            name = f"{task}-{len(names):06d}"
            self.settings.again(lambda: sink.put(run, name, held))
            names.append(name)

        for row in rows:
            held.append(row.asDict(recursive=True))
            if len(held) == self.settings.batch:
                flush()
                held = []
        if held:
            flush()
        return Staged(names)

    def publish(self, run: str, messages: list[Staged | None], name: str) -> None:
        batches = sorted(b for m in messages if m is not None for b in m.batches)
        self.settings.again(lambda: self.make().publish(run, batches, name, self.overwrite))

    def discard(self, run: str) -> None:
        self.settings.again(lambda: self.make().discard(run))


class PageWriter(Staging, DataSourceWriter):
    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        return self.staged(self.run, iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        self.publish(self.run, messages, self.run)

    def abort(self, messages: list[Staged | None]) -> None:
        self.discard(self.run)


class PageStreamWriter(Staging, DataSourceStreamWriter):
    """Micro-batches come one after the other, so all that is staged under the stream's name is the present one's."""

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        return self.staged(self.settings.stream or self.run, iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        run = self.settings.stream or self.run
        self.publish(run, messages, f"{run}/{batchId}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.discard(self.settings.stream or self.run)


def register(spark: SparkSession, name: str, make: Callable[[], Search] | None = None, sink: Callable[[], Sink] | None = None) -> None:
    """A data source of a name of one's own; `make` and `sink` are called in the tasks, once each, and travel by value."""

    class Remote(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return PageReader(make, Settings(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return PageStream(make, Settings(self.options))

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return PageWriter(sink, Settings(self.options), overwrite)

        def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
            return PageStreamWriter(sink, Settings(self.options), overwrite)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Remote)
