"""The methods against brute force, held-out accuracy, exact round trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, langid, mixing, notices, quality, queries, simhash, sketch, urlfilter, warc

DATA = "/root/testdata/sf0.01"


def test_arc_versions_and_declared_lengths():
    body = b"HTTP/1.1 200 OK\r\n\r\nhttp://fake 1.2.3.4 20200101000000 text/html 3\nabc"
    one = f"filedesc://x 0.0.0.0 20200101000000 text/plain {len('1 0 t') + len(warc.ARC_FIELDS[1]) + 2}\n1 0 t\n{warc.ARC_FIELDS[1]}\n\nhttp://a/b c 192.0.2.7 20200102030405 text/html {len(body)}\n".encode() + body + b"\n"
    two = f"\nfiledesc://y 0.0.0.0 20200101000000 text/plain 200 - - 0 y {len('2 0 t') + len(warc.ARC_FIELDS[2]) + 2}\n2 0 t\n{warc.ARC_FIELDS[2]}\n\ndns:x 192.0.2.8 20210102030405 text/dns 200 - - 9 y 3\nabc\n".encode()
    got = list(warc.arc_records(one + two))
    assert [(v, f["URL"]) for v, f, _ in got] == [(1, "filedesc://x"), (1, "http://a/b c"), (2, "filedesc://y"), (2, "dns:x")]
    assert got[1][2] == body and got[3][1]["Result-code"] == "200" and warc.iso(got[1][1]["Archive-date"]) == "2020-01-02T03:04:05Z"
    with pytest.raises(ValueError):
        list(warc.arc_records((one + two)[:-3]))


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, "http://x/", "192.0.2.1", "20240101000000", "text/html", f"page {i} " * 300 if i % 3 else "same " * 300) for i in range(30)]
    df = spark.createDataFrame(rows, "key long, url string, ip string, ts14 string, mime string, payload string")
    arc, out = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    warc.write_arc(df, arc, archive_bytes=5000)
    warc.convert(spark, arc, out)
    got = warc.read_warc(spark, out).filter("kind in ('response', 'revisit')").collect()
    assert all(r.intact for r in got) and len(got) == 30
    assert {r.key: bytes(r.payload).decode() for r in got if r.kind == "response"} == {r[0]: r[5] for r in rows if r[0] % 3 or r[0] == 27}
    assert {(r.key, r.refers_to_key) for r in got if r.kind == "revisit"} == {(i, 27) for i in range(0, 27, 3)}


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    m = queries.QUERIES["op2_quality"](spark, DATA).join(labels, "doc_id").filter("held_out").toPandas()
    assert (m.predicted == m.quality).mean() > 0.97


def test_non_negative_risk_learns_from_positives_alone():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1, 1, (2000, 5)), rng.normal(-1, 1, (2000, 5))
    u = np.vstack([rng.normal(1, 1, (1000, 5)), n[:1000]])
    w, mean, scale = quality.fit(p, u, 0.5)
    score = lambda x: ((x - mean) * scale) @ w[:-1] + w[-1]
    assert ((score(p) > 0).mean() + (score(n) < 0).mean()) / 2 > 0.95


def test_language_held_out_and_spans(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    m = queries.QUERIES["op3_langid"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (m.lang_pred == m.lang).mean() > 0.98
    model = langid.learn(docs)
    text = {r.lang: r.text for r in docs.filter("n_chars between 400 and 900").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    got = langid.spans(text["en"] + " " + text["de"], model)
    assert [g[2] for g in got][0] == "en" and [g[2] for g in got][-1] == "de" and len(got) <= 6


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(0, 14, size=rng.integers(1, 12))
        first = np.concatenate([[0], np.cumsum(sizes)])
        scores = (rng.normal(size=(first[-1], 3)) * 4).astype(np.float32)
        label = langid.viterbi(scores, first, 3.0)
        for a, b in zip(first, first[1:], strict=False):
            s, path = scores[a:b].astype(float), label[a:b]
            if len(s):
                v = s[0]
                for row in s[1:]:
                    v = np.maximum(v, v.max() - 3.0) + row
                assert abs(s[np.arange(len(s)), path].sum() - 3.0 * (path[1:] != path[:-1]).sum() - v.max()) < 1e-3


def test_sketch_estimates():
    own, rng = sketch.Powers(), random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40000)]
    whole, part = sketch.sketch(" ".join(words), own), sketch.sketch(" ".join(words[:4000]), own)
    assert abs(sketch.containment(part, whole) - 1) < 0.02 and abs(sketch.likeness(part, whole) - 0.1) < 0.02
    assert set(sketch.merged(part, whole)) == set(whole[1]) and sketch.unpacked(sketch.packed(part))[0] == part[0]


def seats(votes, n):
    out = [0] * len(votes)
    for _ in range(n):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def test_mixing_targets_and_blocks(spark):
    rows = [(i, f"s{i % 7}" if i % 11 else None, "w " * (i % 50 + (400 if i % 7 == 3 else 0))) for i in range(700)] + [(900, "zero", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(docs).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    size = {s: g["size"].sum() for s, g in got.groupby(got.source.fillna("~"))}
    names, weights = sorted(size), [5, 2, 1]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(size.values()))
    while True:  # share by weight, stop at three times, share the rest again
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full
    for s, g in got.groupby(got.source.fillna("~")):
        assert abs(g.target.iloc[0] - target[s]) < 1e-6 and abs(g.taken.sum() - target[s]) <= 0.02 * target[s] + 16
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.mixed(docs.repartition(5)).toPandas().sort_values("doc_id").taken.tolist()
    assert again == got.sort_values("doc_id").taken.tolist()


def test_apportionment_is_sainte_lague(spark):
    """The quick start plus last seats by quotients gives what one seat at a time gives."""
    rng = random.Random(4)
    for _ in range(4):
        votes, n = [rng.choice([1, 5, 40, 900, 20000]) * rng.random() + 0.01 for _ in range(9)], rng.randint(3, 400)
        total, m = sum(votes), len(votes)
        base = [max(0, int(np.floor(v * max(n - m / 2, 0) / total + 0.5))) for v in votes]
        tries = sorted((-v / (2 * (b + j) - 1), i) for i, (v, b) in enumerate(zip(votes, base, strict=True)) for j in range(1, int(np.ceil(v / total * m)) + 3))
        got = list(base)
        for _, i in tries[: n - sum(base)]:
            got[i] += 1
        assert got == seats(votes, n)


def test_notices_spans():
    spans = notices.Scanner().spans("Some words. Licenced under the Apache licence, see the file. All rights reservd!")
    assert {(s["label"], s["edits"] > 0) for s in spans} == {("apache-2", True), ("all-rights-reserved", True)}
    assert all(s["first_word"] <= s["last_word"] for s in spans)
    places = notices.Scanner().places(notices.Scanner.normal("cc by nc cc by nc by")[0])
    assert places == [(0, "cc-by-nc"), (3, "cc-by-nc")]


def test_notices_that_repeat():
    """Each of many near notices is found, beside exact ones and beyond them, in time that grows with the text."""
    near, scanner = "permission is hereby grante free of charge", notices.Scanner()
    many = scanner.spans(f"{near} " * 3000)
    assert len(many) == 3000 and {s["edits"] for s in many} == {1} and [s["first_word"] for s in many] == list(range(0, 21000, 7))
    both = [(s["edits"], s["first_word"]) for s in scanner.spans(f"{near} permission is hereby granted free of charge {near}") if s["label"] == "mit"]
    assert both == [(1, 0), (0, 7), (1, 14)]
    assert scanner.judge("under the mit license " * 2000)[:4] == (8000, 2000, 0, 7996)


def test_every_pair_within_two_bits_meets_at_an_anchor():
    rng, anchors = np.random.default_rng(5), simhash.Anchors()
    for _ in range(300):
        x = rng.integers(-(1 << 63), 1 << 63, 1, dtype=np.int64)
        flips = rng.choice(64, rng.integers(0, 3), replace=False)
        y = (x.view(np.uint64) ^ np.uint64(sum(1 << int(b) for b in flips))).view(np.int64)
        assert anchors.home(x)[0] in anchors.all(y)[1] and anchors.home(y)[0] in anchors.all(x)[1]


@pytest.mark.parametrize("most", [4096, 3])
def test_links_and_components_against_brute_force(spark, most):
    rng = np.random.default_rng(6)
    base = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64).view(np.uint64)
    fps = set(base.tolist())
    for x in base[:20].tolist():  # clouds and chains around some
        for _ in range(12):
            x ^= 1 << int(rng.integers(64))
            x ^= 1 << int(rng.integers(64))
            fps.add(x)
    fps |= {1 << i for i in range(64)} | {0}  # a crowd at one anchor
    fps = np.array(sorted(fps), np.uint64)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2):
            parent[root(int(j))] = root(i)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(df, 2, most)).collect()}
    of = lambda x: found.get(int(x), int(x))
    ours, theirs = {}, {}
    for i, x in enumerate(fps.view(np.int64)):
        ours.setdefault(of(x), set()).add(i)
        theirs.setdefault(root(i), set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_star_sends_no_more_than_members():
    a, b = simhash.star(np.arange(8, dtype=np.uint64), np.arange(8, dtype=np.uint64), 2)
    assert len(a) == 7 and set(b) == {0}


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"h{i}.com/" for i in range(5000)]
    listed = keys[::97]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = urlfilter.build(universe, listed)
    assert cascade.has(urlfilter.hashes(keys)).tolist() == [k in set(listed) for k in keys]
    assert len(cascade.filters) >= 2


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f y"), (2, "a b c d z"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g")], "item_id long, text string")
    got = {(r.offset): (r.n_words, r.doc_id, r.first_word) for r in decontaminate.longest_matches(docs, bench).collect()}
    assert got == {0: (6, 1, 1), 1: (5, 1, 2), 2: (4, 1, 3), 3: (3, 1, 4)}  # matches of three words and more, whatever a window holds
    bench = spark.createDataFrame([(7, "a b c d e f g h i j k l m n")], "item_id long, text string")
    got = {(r.offset): (r.n_words, r.doc_id, r.first_word) for r in decontaminate.longest_matches(docs, bench).collect()}
    assert got[0] == (6, 1, 1) and got[1] == (5, 1, 2) and got[3] == (3, 1, 4)


def test_blocks_of_the_benchmark_agree(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [r.text for r in docs.select("text").collect()]
    one, many = decontaminate.Blocks(bench), decontaminate.Blocks(bench, block_bytes=2000)
    assert len(one.parts) == 1 < len(many.parts)
    assert decontaminate.judged(texts, one) == decontaminate.judged(texts, many)
