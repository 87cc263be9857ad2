"""Decontamination: the suffix array itself, longest matches, a benchmark in parts, crowds of equal items and places."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate as D
from tests.compare import same


def corpus(rng, n=60):
    """Documents over few words, with pieces of items of all lengths, whole ones, and pieces of two items run together."""
    words = [f"w{i}" for i in range(30)]
    items = [[rng.choice(words) for _ in range(rng.choice((1, 2, 5, 12, 13, 14, 40, 90)))] for _ in range(25)]
    items += [[*items[-1][:20], *items[-2][:20]], items[0], list(items[3])]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            item = rng.choice(items)
            a = rng.randrange(len(item))
            parts += [[rng.choice(words) for _ in range(rng.randrange(30))], item[a : a + rng.randrange(1, 60)]]
        docs.append(" ".join(w for p in parts for w in p))
    return docs, [" ".join(i) for i in items]


def test_suffix_array_is_sorted_by_whole_windows():
    rng = random.Random(1)
    texts, _ = corpus(rng)
    shard = D.Shard([*texts, None, "", "a a a a a a a a a a a a a a a a"])
    padded = np.concatenate([shard.words, np.zeros(D.WINDOW, np.int64)])
    keys = [tuple(padded[s : s + D.WINDOW]) for s in shard.suffix]
    # Suffixes that reach into the next document are ordered by its number 0 first, as everything here is.
    assert keys == sorted(keys) and sorted(shard.suffix.tolist()) == list(range(len(shard.words)))


def longest(text, items):
    """(words, place) of the longest match of a document that starts with a whole window, by trying every pair of places."""
    w = text.split()
    best = (0, None)
    for p in range(len(w)):
        for item in items:
            x = item.split()
            n = min(D.WINDOW, len(x))
            for o in range(len(x) - n + 1) if n else ():
                k = 0
                while p + k < len(w) and o + k < len(x) and w[p + k] == x[o + k]:
                    k += 1
                if k >= n and k > best[0]:
                    best = (k, p)
    return best


@pytest.mark.parametrize("seed", [2, 3])
def test_longest_matches_of_documents(seed):
    texts, items = corpus(random.Random(seed))
    block = D.Items(list(enumerate(items)))

    class One:
        window = D.WINDOW

        def each(self):
            yield block

    assert [(r[3], r[4]) for r in D.judged(texts, One())] == [longest(t, items) for t in texts]


def test_sql_and_parts_agree(spark, tmp_path):
    texts, items = corpus(random.Random(4), 200)
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)] + [(None, None, "own"), (7, "", "own")], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(items)] + [(90, None), (91, " ")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = D.op10_decontaminate(spark, f"file://{tmp_path}")
    same(got, D.ORACLE_SQL, str(tmp_path))
    for most, block in ((1 << 30, 500), (1500, 500)):  # many blocks at once; a few at a time, with what was found written between
        parts = D.with_hits(docs, bench, block_bytes=block, most_bytes=most)
        out = parts.select("doc_id", *[f"hits.{c}" for c in D.named(D.HITS)[:4]], D.contaminated("hits").alias("contaminated"), "hits.longest", "hits.longest_first")
        assert sorted(map(str, out.collect())) == sorted(map(str, got.collect()))


def test_equal_short_items_and_places_do_not_multiply():
    """20,000 equal items of one word against 20,000 places of it, and a passage of many items in many documents."""
    passage = " ".join(f"p{i}" for i in range(30))
    items = [(i, "one") for i in range(20000)] + [(20000 + i, f"{passage} tail{i}") for i in range(2000)]
    block = D.Items(items)

    class One:
        window = D.WINDOW

        def each(self):
            yield block

    start = time.time()
    got = D.judged(["one " * 20000, *[passage] * 2000], One())
    assert time.time() - start < 20
    assert len(got[0][2]) == 20000 and got[0][1] == [0, 20000] and got[0][3:] == (1, 0)
    assert all(r[1] == [0, 30] and len(r[2]) == 2000 and r[3:] == (30, 0) for r in got[1:])


def test_stage_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "clean", 1), (2, " ".join(f"p{i}" for i in range(20)), 2)], "doc_id long, text string, hits long")
    folder = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(20)))], "item_id long, text string")
    out = D.with_hits(docs, folder, "__hits").filter(~D.contaminated("__hits")).drop("__hits")
    assert [tuple(r) for r in out.collect()] == [(1, "clean", 1)]
    assert D.with_hits(docs, folder.limit(0)).select(F.sum("hits.n_hit")).first()[0] == 0
