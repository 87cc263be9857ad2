"""The near-dedup stage against brute force: five-word shingles, Jaccard similarity of 0.8 or more."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quarry.llm import common, neardup

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def shingles(text):
    w = (text or "").translate(LOWER).split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def kept(docs):
    """The smallest doc_id of each component."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return set(least.values())


@pytest.mark.parametrize("copies", [3, 60])
def test_stage_against_brute_force(spark, copies):
    """Copies with a few words changed, on both sides of 0.8; 60 of one text fill buckets over neardup.MOST."""
    rng, docs = np.random.default_rng(7), []
    for n in (6, 30, 120, 400):
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        docs.append(" ".join(base))
        for _ in range(copies):
            other = list(base)
            for i in rng.choice(n, rng.integers(1, max(2, n // 25)), replace=False):
                other[i] = f"z{rng.integers(0, 5000)}"
            docs.append(" ".join(other))
    docs = [*enumerate(docs), (9000, None), (9001, " "), (9002, docs[0].upper())]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in neardup.stage(spark, frame, "").collect()} == kept(docs)


def test_families_in_parts(spark):
    """Every bucket is a family here, dealt out in parts of a few sets: what no hub links is linked all the same."""
    rng, docs = np.random.default_rng(13), []
    for n in (40, 200):
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        for _ in range(60):
            other = list(base)
            for i in rng.choice(n, rng.integers(1, max(3, n // 22)), replace=False):
                other[i] = f"z{rng.integers(0, 5000)}"
            docs.append(" ".join(other))
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in neardup.stage(spark, frame, "", most=1, part=7).collect()} == kept(docs)


def test_differences_from_a_hub_tell_likeness():
    """The edges between two components, from differences alone, against whole sets."""
    rng = np.random.default_rng(17)
    hub = np.unique(rng.integers(0, 4000, 300))
    sets = [np.unique(np.concatenate([rng.permutation(hub)[: rng.integers(200, len(hub))], rng.integers(0, 4000, rng.integers(0, 40))])) for _ in range(60)]
    rows = [(1, 0, left, i, i, len(s), np.setxor1d(hub, s)) for left in (False, True) for i, s in enumerate(sets)]
    got = pd.concat(neardup.joined(iter([pd.DataFrame(rows, columns=["hub", "part", "left", "fp", "root", "n", "differs"])])))
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))}
    assert want and set(map(tuple, got.to_numpy().tolist())) == want


def test_anchors_are_nearest_codewords_of_the_fingerprint():
    """Sets at 0.8 meet at an anchor and differ in few bits; unrelated ones do not; a codeword is the best of all 4,096 for its sums."""
    rng, anchors, apart = np.random.default_rng(19), neardup.Anchors(), 0
    assert len({tuple(x) for x in anchors.signs.T.astype(int).tolist()}) == 4096
    for n in (9, 45, 450):
        for _ in range(100):
            base = rng.integers(0, 1 << 63, n + n // 9).astype(np.uint64)
            x, y = (neardup.sums(np.sort(s)) for s in (base[:n], base[n // 9 :]))
            other = neardup.sums(rng.integers(0, 1 << 63, n).astype(np.uint64))
            assert (anchors.of(x) == anchors.of(y)).any()
            assert ((x > 0) != (y > 0))[: neardup.COMPARED_BITS].sum() <= neardup.FAR < ((x > 0) != (other > 0))[: neardup.COMPARED_BITS].sum()
            apart += not (anchors.of(x) == anchors.of(other)).any()
        agree = anchors.signs.T[anchors.of(x) >> 12] * x.reshape(neardup.PARTS, -1)
        assert (agree.sum(1) == (x.reshape(neardup.PARTS, -1) @ anchors.signs).max(1)).all()
    assert apart >= 299


def test_stage_drops_all_near_copies_of_the_small_tables(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    got = {r.doc_id for r in neardup.stage(spark, frame, "").collect()}
    assert got == kept(docs) and not {145, 177} & got


@pytest.mark.parametrize("shape", ["star", "chain", "two"])
def test_large_groups_of_near_copies(spark, shape):
    """Groups of 600 whose copies are near what they were made from, not each other: every bucket of theirs is over neardup.MOST."""
    rng, docs = np.random.default_rng(11), []
    for n, most in ((300, 12), (120, 5)):
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        bases = [base, [*base[: n // 2], *(f"v{x}" for x in rng.integers(0, 5000, n - n // 2))]][: 2 if shape == "two" else 1]
        for i in range(300):
            own = list(bases[i % len(bases)])
            for j in rng.choice(n, rng.integers(1, most), replace=False):
                own[j] = f"z{rng.integers(0, 10**6)}"
            if shape == "chain" and i % 10 == 0:
                bases = [own]
            docs.append(" ".join(own))
        docs += [" ".join(b) for b in bases]
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in neardup.stage(spark, frame, "").collect()} == kept(docs)


def test_texts_are_not_sorted_to_find_those_to_keep(spark):
    """Rows to keep are hashed: no join of theirs sorts whole texts, which took hundreds of MB of an executor's heap."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = neardup.stage(spark, frame, "")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ShuffledHashJoin") == 2


def test_a_batch_is_turned_into_python_texts_by_slices():
    """Of a batch that Spark sends, SLICE texts at most are Python strings at once; order, nulls and an empty batch stay."""
    texts = [None, "", *(f"t{i}" for i in range(2 * common.SLICE))]
    parts = list(common.slices(pa.array(texts, pa.string())))
    assert [len(p) for p in parts] == [common.SLICE, common.SLICE, 2] and [t for p in parts for t in p] == texts
    assert list(common.slices(pa.array([], pa.string()))) == []
