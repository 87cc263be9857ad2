"""Removal of repeated passages against brute force: every way that hot keys and many keys take, ids that are missing or repeat."""

import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, window=13):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    least = {}
    for i, w in words:
        for a in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[a : a + window])
            least[key] = min(least.get(key, i), i)
    out = Counter()
    for i, w in words:
        gone = set()
        for a in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[a : a + window])] < i:
                gone |= set(range(a, a + window))
        out[i, len(w), len(gone), " ".join(x for a, x in enumerate(w) if a not in gone)] += 1
    return out


def got(spark, docs, **options):
    frame = spark.createDataFrame([(i, t, "x", i, 3) for i, t in docs], "doc_id long, text string, kept string, __token long, n_words int")
    out = substrings.with_kept(frame, **options)
    assert out.columns == ["doc_id", "text", "__token", "n_words", "n_removed", "kept"]
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect())


def corpus(seed, n=120, vocabulary=60):
    """Documents made of shared passages of 1 to 40 words and own words; a line that half of them hold."""
    rng = np.random.default_rng(seed)
    say = lambda k: [f"w{x}" for x in rng.integers(0, vocabulary, k)]
    shared, line = [say(rng.integers(1, 40)) for _ in range(30)], say(16)
    docs = []
    for i in rng.permutation(n).tolist():
        parts = [shared[rng.integers(0, 30)] if rng.random() < 0.5 else say(rng.integers(1, 30)) for _ in range(rng.integers(0, 6))]
        docs.append((i, " ".join(sum(parts + ([line] if rng.random() < 0.5 else []), []))))
    return docs


@pytest.mark.parametrize(("seed", "options"), [(0, {}), (1, {"crowded": 3}), (2, {"most_rows": 5, "shard_words": 400}), (3, {"most_keys": 0}), (4, {"crowded": 3, "most_rows": 5, "most_keys": 0, "shard_words": 300}), (5, {"window": 4})])
def test_against_brute_force(spark, seed, options):
    docs = corpus(seed)
    assert got(spark, docs, **options) == plain(docs, options.get("window", 13))


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(40))
    docs = [(5, long), (3, long), (3, long), (4, long.upper()), (None, long), (None, None), (6, None), (7, ""), (8, " \n\t"), (9, "a b"), (10, "a b"), (11, "word " * 3000), (12, "word " * 12), (13, "word " * 13), (2, "word  word\tword"), (14, f"ü {long} ß"), (-1, f"before {long}")]
    assert got(spark, docs) == plain(docs)


def test_empty(spark):
    assert not got(spark, [])


def test_automaton_is_that_of_its_passages():
    """Every window's smallest id, for passages that share much and split states."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        a, least = substrings.Automaton(3), {}
        for doc_id in sorted(rng.integers(0, 6, 12).tolist()):
            words = [str(x).encode() for x in rng.integers(0, 3, rng.integers(1, 12))]
            own = a.numbers(words)
            smaller, new = a.match(own, doc_id)
            windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
            assert smaller == [i for i, w in enumerate(windows) if least.get(w, doc_id) < doc_id]
            assert new == [i for i, w in enumerate(windows) if w not in least]
            a.add(own, doc_id)
            for w in windows:
                least.setdefault(w, doc_id)
