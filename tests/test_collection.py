"""A collection of chunks: scans and indexes give the same hits, filters hold, and the agent and the command line search it."""

import random

import pytest
from pyspark.sql import functions as F

import quarry.__main__ as cli
from quarry.operators import collection, providers, records
from quarry.plans import raw

CHUNK = "pmcid string, source_type string, section string, chunk_index int, text string, dense array<float>"


def tables_of(spark, rows):
    """What `etl.run` returns, of chunks (pmcid, section, index, text); every tenth paper has no row, so no year."""
    some = random.Random(5)
    full = [(p, "fulltext", s, i, t, providers.letters([t])[0] if t and some.random() < 0.95 else None) for p, s, i, t in rows]
    numbers = sorted({int(p[1:]) for p, *_ in rows if p and int(p[1:]) % 10})
    papers = spark.createDataFrame([(f"P{i}", str(2015 + i % 4), f"j{i % 3}") for i in numbers], "pmcid string, pub_year string, journal string")
    chunks = spark.createDataFrame(full, CHUNK).join(papers, "pmcid", "left").na.fill("", ["pub_year", "journal"])
    abstracts = spark.createDataFrame([(f"P{i}", "abstract", "abstract", 0, f"about fox {i}", providers.letters([f"about fox {i}"])[0]) for i in numbers], CHUNK)
    return {"papers": papers, "abstract chunks": abstracts, "fulltext chunks": chunks}


@pytest.fixture(scope="module")
def made(spark):
    some = random.Random(3)
    words = ["fox", "hen", "red", "blue", "runs", "sits", "über", "farm"]
    rows = [(f"P{i}", section, j, " ".join(some.choice(words) for _ in range(some.randint(1, 30)))) for i in range(60) for section in ("Methods", "Results") for j in range(3)]
    return tables_of(spark, [*rows, rows[0], ("P7", "Methods", 9, None), (None, "Methods", 0, "red fox of nobody"), ("P8", "Methods", 9, "")])


@pytest.fixture(scope="module")
def held(spark, made, tmp_path_factory):
    at = tmp_path_factory.mktemp("held")
    return collection.build(made, f"file://{at}/scanned", indexed=False), collection.build(made, f"file://{at}/indexed")


QUERIES = [(1, "red fox"), (2, "blue hen runs"), (3, "   "), (4, None), (5, "zzz"), (6, "über farm farm")]


def told(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("filters", [None, {"section": "Methods"}, {"pub_year": "2016", "source_type": "abstract"}, {"journal": "none such"}])
def test_indexes_and_scans_agree(spark, held, filters):
    scanned, indexed = held
    assert scanned.cells is None and scanned.postings is None and indexed.cells is not None and indexed.postings is not None
    q = spark.createDataFrame(QUERIES, "qid long, qtext string")
    a, b = scanned.search(q, filters=filters), indexed.search(q, filters=filters)
    assert told(a) == told(b)
    rows = a.collect()
    assert {r.qid for r in rows} <= {1, 2, 5, 6} and ((filters or {}).get("journal") is None) == bool(rows)
    for k, v in (filters or {}).items():
        assert all(r[k] == v for r in rows)


def test_hits_are_those_of_brute_force(spark, held):
    """Every chunk scored one by one: fused ranks of 40 hits a leg, then the share of the query's words."""
    rows = sorted(held[0].rows.collect(), key=lambda r: r.id)
    texts = {r.id: r.text or "" for r in rows}

    def unit(v):
        n = sum(x * x for x in v) ** 0.5
        return [x / n if n else 0.0 for x in v]

    def counts(t):
        import math
        import re

        found = re.findall("[a-z0-9]+", t.lower())
        return {w: math.log1p(found.count(w)) for w in found}

    for qid, q in ((1, "red fox"), (6, "über farm farm")):
        v, c = unit([float(x) for x in spark.createDataFrame([(providers.letters([q])[0],)], "v array<float>").first().v]), counts(q)
        dense = sorted((-round(sum(a * b for a, b in zip(unit(r.vec), v, strict=True)), 6), r.id) for r in rows if r.vec is not None)[:40]
        sparse = sorted((-round(sum(w * counts(texts[i]).get(t, 0) for t, w in c.items()), 4), i) for i in texts)
        sparse = [x for x in sparse if x[0] < 0][:40]
        dr, sr = ({i: n for n, (_, i) in enumerate(leg)} for leg in (dense, sparse))
        fused = sorted({*dr, *sr}, key=lambda i: (-(1 / (60 + dr[i]) if i in dr else 0) - (1 / (60 + sr[i]) if i in sr else 0), dr.get(i, 99), sr.get(i, 99)))[:20]
        best = sorted(range(len(fused)), key=lambda n: (-round(len(set(c) & set(counts(texts[fused[n]]))) / len(c), 6), n))[:5]
        by_id = {r.id: (r.pmcid, r.source_type, r.section, r.chunk_index, r.text) for r in rows}
        got = held[1].search(spark.createDataFrame([(qid, q)], "qid long, qtext string")).orderBy("rank").collect()
        assert [(r.pmcid, r.source_type, r.section, r.chunk_index, r.text) for r in got] == [by_id[fused[n]] for n in best]


def test_numbers_ascend_with_the_key(held):
    rows = held[0].rows.orderBy("id").collect()
    keys = [tuple("" if v is None else v for v in (r.pmcid, r.source_type, r.section, r.chunk_index)) for r in rows]
    assert keys == sorted(keys) and len({r.id for r in rows}) == len(rows)
    assert any(not r.pub_year for r in rows) and any(r.pub_year for r in rows)


def test_empty_collections_and_unknown_filters(spark, made, tmp_path):
    empty = collection.build({k: v.limit(0) for k, v in made.items()}, f"file://{tmp_path}/empty")
    q = spark.createDataFrame(QUERIES, "qid long, qtext string")
    assert empty.search(q).collect() == [] and empty.search(q.limit(0)).collect() == []
    with pytest.raises(ValueError, match="no filters"):
        empty.search(q, filters={"color": "red"})


def test_points_of_stored_chunks_are_the_same(spark, tmp_path):
    """Repeated ids (sections with equal slugs, rows written again), nulls, missing vectors, no rows."""
    sparse = "struct<indices: array<int>, values: array<float>>"
    rows = [(p, "fulltext", s, i, f"{s} {i} {n}", [1.0], ([1], [2.0]) if n != 3 else None, n) for n, (p, s, i) in enumerate([("A", "My part", 0), ("A", "my_part", 0), ("A", "My part", 1), ("B", "x", 0), ("B", "x", 0), (None, "x", 0), (None, "x", 0), ("C", None, 0)])]
    chunks = spark.createDataFrame(rows, f"pmcid string, source_type string, section string, chunk_index int, text string, dense array<float>, sparse {sparse}, seq int")
    chunks.write.parquet(f"file://{tmp_path}/chunks")
    kept = spark.read.parquet(f"file://{tmp_path}/chunks")
    plain, stored = records.points(kept), records.points(kept, stored=True)
    assert plain.columns == stored.columns and told(plain) == told(stored) and plain.count() == 5
    assert records.points(kept.limit(0), stored=True).count() == 0


def test_agents_search_it(held):
    for each in held:
        own = each.agent()
        hits = own.hits("red fox", top_n=3, filters={"pub_year": "2016"})
        assert len(hits) == 3 and all(h["pub_year"] == "2016" and h["pmcid"].startswith("P") and h["source_type"] for h in hits)
        assert "P7" in own.paper(None, "P7") and "no paper" in own.paper(None, "7")


def test_command_line(spark, tmp_path, capfd):
    out = f"file://{tmp_path}/out"
    assert cli.main(["--data", "/root/testdata/sf0.001", "--pipeline", "--out", out]) == 0
    said = capfd.readouterr().out
    place = said.split("--collection ")[1].split()[0]
    n = collection.Collection(spark, place).rows.count()
    made = raw.etl_run(spark, "/root/testdata/sf0.001").filter(F.col("name").endswith("chunks")).agg(F.sum("n")).first()[0]
    assert n > 0 and made > 0
    assert cli.main(["--data", "/root/testdata/sf0.001", "--collection", place, "--search", "license version", "--top", "2"]) == 0
    assert len([x for x in capfd.readouterr().out.splitlines() if "PMC" in x]) == 2
