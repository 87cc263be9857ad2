"""Sketches of short texts still tell how alike they are."""

import bisect
import random
import time

import pytest

from quarry.llm import sketch


def test_likeness_of_short_texts():
    own, rng, off, zero = sketch.Powers(), random.Random(4), 0, 0
    for _ in range(200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 50))]
        n = len(words)
        k = n // 5
        a, b = (sketch.sketch(" ".join(x), own) for x in (words, [*words[: n - k], *(f"z{i}" for i in range(k))]))
        true = (n - k - 4) / (n - 4 + k)
        got = sketch.likeness(a, b)
        off, zero = off + (abs(got - true) > 0.25), zero + (got == 0)
    assert zero == 0 and off <= 20


def exact(a, b):
    """Jaccard similarity of the sets of five-word shingles."""
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} if t.split() else set()
    x, y = shingles(a), shingles(b)
    return 1.0 if a == b else len(x & y) / len(x | y) if x | y else 0.0


def test_likeness_with_every_hash_retained_is_exact():
    """With the whole range retained the estimate is the similarity itself, so hashes of shingles are those of their words."""
    own, rng = sketch.Powers(), random.Random(9)
    for _ in range(60):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(40))]
        b = a[: rng.randrange(len(a) + 1)] + [rng.choice("abcdefgh") for _ in range(rng.randrange(10))]
        a, b = " ".join(a), "  ".join(b)
        assert abs(sketch.likeness(sketch.sketch(a, own, 1), sketch.sketch(b, own, 1)) - exact(a, b)) < 1e-9


def test_next_documents(spark):
    """near_next and the fixed edges of ranges against the exact similarity, with few and many ranges, repeated and null ids."""
    rng = random.Random(10)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(rng.choice([None, 3, i, i]), " ".join(base[: rng.randrange(200, 400)] + [f"x{rng.randrange(99)}" for _ in range(rng.randrange(100))])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()))
    want = {(d, t): exact(t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order)}
    for n in (1, 7):
        got = sorted((r.doc_id is not None, r.doc_id or 0, round(r.near_next, 9)) for r in sketch.with_next(frame, n).collect())
        first = first if n > 1 else got
        assert got == first
        assert abs(sum(x for *_, x in got) / len(got) - sum(want.values()) / len(want)) < 0.03


@pytest.mark.parametrize("piece", [3, 64, 1000])
def test_pieces_change_nothing(monkeypatch, piece):
    rng = random.Random(piece)
    texts = ["", " \n", "a", "a b\tc d", "x" * 5000 + " y z", " ".join(f"w{rng.randrange(999)}" for _ in range(2000)), "é\x0b" * 99]
    whole = [sketch.packed(sketch.sketch(t, sketch.Powers())) for t in texts]
    monkeypatch.setattr(sketch, "PIECE", piece)
    assert [sketch.packed(sketch.sketch(t, sketch.Powers())) for t in texts] == whole


def test_an_id_that_many_rows_share_is_cut(spark):
    """A third of the rows without an id and a third with one id: their ranges are cut by the texts' first bytes; nothing changes."""
    rng = random.Random(12)
    text = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(99)}" for _ in range(rng.randrange(30)))
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i, text()) for i in range(900)] + [(50, "same text")] * 40
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = sorted(rows, key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()))
    own = sketch.Powers()
    want = sorted(str((d, len(t), sketch.packed(sketch.sketch(sketch.edited(t, order[(i + 1) % len(order)][1]), own)).hex())) for i, (d, t) in enumerate(order))
    assert sorted(str((r.doc_id, r.n_chars, bytes(r.edited_sketch).hex())) for r in sketch.with_next(frame, 12).collect()) == want
    keyed = frame.selectExpr("coalesce(doc_id, -9223372036854775808L) AS key", "cast(conv(rpad(hex(substring(encode(text, 'utf-8'), 1, 6)), 12, '0'), 16, 10) AS long) AS prefix")
    bounds = sketch.ranges(keyed, 12)
    sizes = [r["count"] for r in keyed.withColumn("part", sketch.numberer(bounds)(keyed.key, keyed.prefix)).groupBy("part").count().collect()]
    assert len(bounds) >= 9 and max(sizes) < 250


def test_very_many_ranges(spark):
    """20,000 ranges: numbered as by a binary search over pairs, with a plan of a line."""
    rng = random.Random(15)
    bounds = sorted({(rng.randrange(-(10**6), 10**6), 0) for _ in range(16_000)} | {(77, rng.randrange(1 << 48)) for _ in range(4000)} | {(77, 0)})
    rows = [(rng.choice([77, rng.randrange(-(10**6), 10**6), rng.choice(bounds)[0]]), rng.randrange(1 << 48)) for _ in range(5000)]
    start = time.time()
    numbered = spark.createDataFrame(rows, "key long, prefix long").withColumn("part", sketch.numberer(bounds)("key", "prefix"))
    assert "CASE" not in numbered._jdf.queryExecution().executedPlan().toString() and time.time() - start < 5
    assert all(r.part == bisect.bisect_right(bounds, (r.key, r.prefix)) for r in numbered.collect())
