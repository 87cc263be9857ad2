"""Progress as keyed state: restarts, final states, retries that become due, and what a batch writes."""

import os
import time

import pytest

from quarry.streaming import progress


@pytest.fixture
def run(spark, tmp_path):
    def step(rows, name, **options):
        spark.createDataFrame(rows, "pmcid string, status string").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema("pmcid string, status string").parquet(f"file://{tmp_path}/in/*")
        progress.track(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check", progress.Progress(**options))
        return {r.pmcid: (r.status, r.attempt) for r in progress.current(spark, f"file://{tmp_path}/out").collect()}

    step.written = lambda: sorted(os.listdir(f"{tmp_path}/out"))
    step.rows = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}").count()
    return step


def test_statuses_over_restarts(run):
    first = [(f"P{i}", "fetched" if i % 3 else "failed") for i in range(60)] + [("Q", "failed"), ("Q", "no_pmid"), (None, "fetched"), ("N", None)]
    got = run(first, "a")
    assert got == {f"P{i}": ("fetched" if i % 3 else "failed", 1) for i in range(60)} | {"Q": ("no_pmid", 1)}
    got = run([("P0", "fetched"), ("P1", "failed"), ("P3", "failed"), ("R", "fetched")], "b")
    assert (got["P0"], got["P1"], got["P3"], got["R"]) == (("fetched", 2), ("fetched", 1), ("failed", 2), ("fetched", 1))
    # A batch tells what it changed, not the log.
    assert max(run.rows(name) for name in run.written()[1:]) <= 3


def test_keys_become_due_and_are_given_up(spark, tmp_path, run):
    due = lambda: sorted(r.pmcid for r in progress.due(spark, f"file://{tmp_path}/out").collect())
    assert run([("A", "failed"), ("B", "fetched"), ("D", "failed")], "a", wait_ms=1, attempts=3)["A"] == ("failed", 1)
    time.sleep(0.1)
    assert due() == ["A", "D"]
    assert run([("A", "failed")], "c", wait_ms=3_600_000, attempts=3)["A"] == ("failed", 2) and due() == ["D"]
    assert run([("A", "failed"), ("D", "fetched")], "d", attempts=3) == {"A": ("given_up", 3), "B": ("fetched", 1), "D": ("fetched", 2)}
    assert run([("A", "fetched")], "e")["A"] == ("given_up", 3) and due() == []
