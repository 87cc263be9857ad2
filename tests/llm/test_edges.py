"""Every operator and stage on a small hand-made set: nulls in every column, empty and long texts, repeated rows, clashing columns, empty tables."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import queries, sketch
from tests.compare import same
from tests.llm.test_neardup import kept as near_copies_left

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"

DOCS = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, "   \n\t", "en", None), (4, "x", "en", "b"), (4, "x", "en", "b"), (4, "another text under the same number", "de", "b"),
    (5, "Word " * 30000, "en", "a"), (6, "Wörter über Straße und Ähnliches " * 20, "de", "c"), (7, f"before {NOTE} after", "en", "a"), (8, f"{NOTE} " + "filler words of all kinds " * 100, "en", "a"),
    (9, "Released UNDER the MIT license. Also Apache License, Version 2.0 and apache lisense version 2", "en", None), (10, "1234 5678 !!", None, None), (11, "ночь улица фонарь аптека " * 10, "ru", "d"),
    (None, "a text without a number", None, "a"), (None, None, None, None), (12, f"before {NOTE} after", "en", "é"), (13, "short note", "en", "a"), (14, "THE QUICK BROWN FOX " * 40, "en", "a"), (15, "the quick brown fox " * 40, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, h long, target double, fp long, language string, anchor long"


VECTORS = [(i, [((i * 37 + j * 11) % 41 - 20) / 64 for j in range(64)], i % 3) for i in range(220)]
VECTORS += [(100, VECTORS[100][1], 1), (300, None, 1), (301, [], 1), (302, [1.0], 1), (303, [None] * 64, 1), (304, [float("nan")] * 64, 1), (None, VECTORS[3][1], 0), (305, VECTORS[5][1], None), (200, VECTORS[200][1], 2)]


def write(spark, folder, docs, labels, bench, pages, turns, vectors=()):
    rows = [(*d, len(d[1] or ""), 0.5, 1, 2, 3.0, 4, "clash", 5) for d in docs]
    put = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    put("documents", rows, SCHEMA)
    put("labels", labels, "doc_id long, quality int, toxic int, score double")
    put("benchmark", bench, "item_id long, text string, doc_id long")
    put("pages", pages, "page_id long, url string, html string, host string, digest string")
    put("conversations", turns, "conv_id long, turn long, role string, text string, part long")
    put("embeddings", [(*v, 0, 0.0) for v in vectors], "vec_id long, embedding array<float>, label int, cluster int, score double")
    return f"file://{folder}"


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    big = "é" * 600
    pages = [(1, "https://WWW.Example.com/en/x?q#f", None, "c", "c"), (2, None, big, "c", "c"), (3, "http://a.net/es/", big, "c", "c"), (4, "no scheme", "small", "c", "c"), (5, "http://net/fr", "small", "c", "c"), (6, "https://m.example.com/en/ü z", big + "WARC/1.0\r\n\r\n", "c", "c"), (7, "x://com", "z" * 300000, "c", "c"), (8, "ftp://q.com/?a=://", "", "c", "c"), (9, "http://a.net/es/", big, "c", "c")]
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello <|im_end|>"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello <|im_end|>"), (4, 0, None, None), (5, 0, "", ""), (6, None, "user", "q"), (6, None, "user", "q"), (7, 0, "user", "hi"), (7, 3, "assistant", "other")]
    turns += [(8, i, "user", f"turn {i}") for i in range(600)] + [(9, i, "user", f"turn {i}") for i in range(300)] + [(None, 0, "user", "unnumbered")]
    labels = [(d, q, 0, 0.0) for d, q in ((2, 0), (4, 1), (5, 0), (6, 1), (7, 1), (8, 1), (9, 1), (10, 0), (13, 1), (14, 0), (None, 1), (6, None))]
    bench = [(0, NOTE, 1), (1, None, 1), (2, "", 1), (3, "short note", 1), (10, NOTE.upper(), 1), (None, NOTE, 1)]
    return write(spark, tmp_path_factory.mktemp("edges"), DOCS, labels, bench, [(*p,) for p in pages], [(*t, 0) for t in turns], VECTORS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [], [])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op1_warc", "op5_mixing", "op6_chat", "op9_urlfilter", "op10_decontaminate", "op11_hardneg", "op12_clustering", "op13_substrings"])
def test_against_sql(spark, edges, name):
    same(queries.QUERIES[name](spark, edges), queries.ORACLE_SQL[name], edges.removeprefix("file://"))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql_small_tables(spark, name):
    same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.ORACLE_SQL[name], "/root/testdata/sf0.001")


def key(r):
    return (r.doc_id is not None, r.doc_id or 0)


def ids(rows):
    return Counter(r.doc_id for r in rows) == Counter(d[0] for d in DOCS)


def test_quality(spark, edges):
    rows = queries.QUERIES["op2_quality"](spark, edges).collect()
    assert ids(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1  # null is the empty text


def test_language(spark, edges):
    rows = queries.QUERIES["op3_langid"](spark, edges).collect()
    assert ids(rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 10))
    assert all(r.lang_pred != "und" for r in rows if r.doc_id in (5, 6, 11))


def test_sketch(spark, edges):
    rows = queries.QUERIES["op4_sketch"](spark, edges).collect()
    order = sorted(((d[0], d[1] or "") for d in DOCS), key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()))
    want = Counter()
    own = sketch.Powers()
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b = sketch.sketch(text, own), sketch.sketch(edited, own)
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), sketch.packed(a).hex(), sketch.packed(b).hex(), round(sketch.likeness(a, b), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9)) for r in rows) == want


def test_chat(spark, edges):
    rows = queries.QUERIES["op6_chat"](spark, edges).collect()
    assert sorted({r.conv_id for r in rows if r.conv_id is not None}) == [2, 4, 5, 6, 7, 8]
    assert any(r.conv_id is None for r in rows)
    two = next(r for r in rows if r.conv_id == 2)
    assert two.text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello < |im_end|><|im_end|>\n"
    eight = sorted((r for r in rows if r.conv_id == 8), key=lambda r: r.part)
    assert [r.part_turns for r in eight] == [256, 256, 88] and eight[0].n_turns == 600
    assert "".join(r.text for r in eight) == "".join(f"<|im_start|>user\nturn {i}<|im_end|>\n" for i in range(600))


def test_notices(spark, edges):
    rows = {r.doc_id: r for r in queries.QUERIES["op7_notices"](spark, edges).collect()}
    nine = rows[9]
    assert (nine.n_words, nine.n_base, nine.first_word, nine.last_word, nine.base_labels, nine.labels) == (16, 2, 1, 6, "apache-2,mit", "apache-2,mit")
    assert (rows[1].n_words, rows[1].n_base, rows[1].first_word, rows[1].labels, rows[1].score) == (0, 0, None, "", 0.0)


def bits(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum((sum(x >> i & 1 for x in h) * 2 > len(h)) << i for i in range(64))


def test_simhash(spark, edges):
    docs = [d for d in DOCS if d[0] != 5]
    rows = [r for r in queries.QUERIES["op8_simhash"](spark, edges).collect() if r.doc_id != 5]
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == Counter((d[0], f"{bits(d[1]):016x}") for d in docs)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in rows if r.doc_id in (14, 15)} == {14} and {r.component_id for r in rows if r.doc_id in (7, 12)} == {7}


def brute_hits(docs, bench):
    windows = {}
    for item, text in bench:
        w = tuple(WORD.findall((text or "").translate(LOWER)))
        for a in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(w[a : a + 13], set()).add(item)
    for doc_id, text in docs:
        w, hit, items = WORD.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    items |= windows[x] - {None}
        yield doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, edges):
    rows = queries.QUERIES["op10_decontaminate"](spark, edges).collect()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{edges}/benchmark.parquet").collect()]
    assert Counter(tuple(r)[:6] for r in rows) == Counter(brute_hits([(d[0], d[1]) for d in DOCS], bench))


def test_stages_keep_columns_and_repeat_safely(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, edges)
        kept[name] = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
    flagged = {r.doc_id for r in queries.QUERIES["op10_decontaminate"](spark, edges).collect() if r.contaminated}
    assert Counter(r.doc_id for r in kept["benchmark decontamination"]) == Counter(d[0] for d in DOCS if d[0] not in flagged)
    assert not {1, 2, 3, 10} & {r.doc_id for r in kept["language ID"]}
    near = Counter((r.doc_id, r.text) for r in kept["SimHash near-dedup"])
    assert max(near.values()) == 1 and near[4, "x"] == near[4, "another text under the same number"] == 1
    assert {r.doc_id for r in kept["SimHash near-dedup"]} >= {6, 7, 9, 11, 13, 14} and not {12, 15} & {r.doc_id for r in kept["SimHash near-dedup"]}


def test_pipeline_stages_follow_their_queries(spark):
    """Over the smallest tables: each stage keeps what its query, on the same input, does not reject."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [{r.doc_id for r in stage(spark, docs, folder).collect()} for _, stage in corpus_pipeline.STAGES[:4]]
    run = lambda n: queries.QUERIES[n](spark, folder).collect()
    assert kept[0] == {r.doc_id for r in run("op2_quality") if r.predicted}
    assert kept[1] == {r.doc_id for r in run("op3_langid") if r.lang_pred != "und" and r.score * 3 >= 1}
    assert kept[2] == near_copies_left([(r.doc_id, r.text) for r in docs.collect()])  # five words, 0.8, by brute force; op8 has a contract of its own
    assert kept[3] == {r.doc_id for r in run("op10_decontaminate") if not r.contaminated}
    final = corpus_pipeline.run(spark, folder).toPandas()
    assert 0 < len(final) <= len(set.intersection(*kept)) + 40 and (final.taken <= 3 * final["size"]).all() and np.isfinite(final.target).all()


def test_stages_leave_own_columns_of_any_name(spark, edges):
    """Columns that are named like those that stages work with keep their values."""
    docs = spark.read.parquet(f"{edges}/documents.parquet").filter("doc_id IN (6, 7, 9, 13)").dropDuplicates(["doc_id"])
    names = ["__score", "__language", "__hits", "___hits", "__id", "__token", "passes", "k", "doc"]
    own = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, own, edges)
        kept = [n for n in names if n != "passes" or name != corpus_pipeline.STAGES[-1][0]]
        assert all(r[n] == f"{n} of {r.doc_id}" for r in out.collect() for n in kept), name
        assert set(own.columns) <= set(out.columns)
