"""Edge cases by hand, and independent restatements in plain Python."""

import datetime
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import agent, chunking, markup, memory, metrics, providers, records, retrieval, service
from quarry.streaming import incremental


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


def test_scalars(spark):
    c = F.col
    assert one(spark, T.collapse(c("a")), a=" a\t  b\n") == "a b"
    assert one(spark, T.slug(c("a")), a="A Long Section Title That Goes On And On") == "a_long_section_title_that_goes"
    assert one(spark, T.uuid5(c("a")), a="PMC1_abstract_x_0") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "PMC1_abstract_x_0"))
    assert one(spark, T.author(c("f"), c("l")), f="Ada", l="Byron") == "Ada Byron"
    assert one(spark, T.author(c("f"), c("l")), f="Ada", l="") is None
    assert one(spark, T.unfenced(c("a")), a='```json\n{"x": 1}\n```') == '{"x": 1}'
    assert [one(spark, T.garbage(c("a")), a=a) for a in ("a;b;c;d;e", "coronaVacWibp", "plain text here", "x;" * 300)] == [True, True, False, False]
    assert one(spark, T.strip_numbering(c("a")), a="2.1 Methods") == "1 Methods"


def test_dates(spark):
    cases = {("2024", "Sep", "31"): (2024, 9, 28), ("2024", "9", "2"): (2024, 9, 2), ("2024", "September", ""): (2024, 9, 1), ("2024", "Winter", "1"): None, ("2024", "13", "1"): None, ("", "9", "1"): None, ("2024", "", "1"): None, ("2024", "2", "0"): None}
    for (y, m, d), want in cases.items():
        assert one(spark, T.pub_date(F.col("y"), F.col("m"), F.col("d")), y=y, m=m, d=d) == (want and datetime.date(*want)), (y, m, d)


def fold(paragraphs, limit, least):
    """Written from the description: close a chunk before what does not fit; cut what is over the limit at its sentences."""
    done, held = [], ""

    def close():
        nonlocal held
        done.extend([held] if held else [])
        held = ""

    for p in paragraphs:
        pieces = re.split(r"(?<=[.!?])\s+", p) if len(p) > limit else [p]
        if len(p) > limit:
            close()
        for x in pieces:
            if len(held) + len(x) + 1 > limit:
                close()
                held = x
            else:
                held = f"{held} {x}".strip()
        if len(p) > limit:
            close()
    close()
    return [x for x in done if len(x) >= least]


def test_chunk_fold(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    docs = [["x" * n] for n in (3199, 3200, 3201)] + [["s" * 100, ". ".join(word(50) for _ in range(90)), "t" * 100], ["u" * 79], ["v" * 80], ["w" * 4000]]
    docs += [[". ".join(word(rng.randint(1, 60)) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 12))] for _ in range(40)]
    rows = [(i, [("s", p, "paragraph") for p in d]) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "pmcid long, paragraphs array<struct<section: string, text: string, type: string>>")
    for limit, least in ((3200, 80), (120, 30)):
        got = {}
        for r in chunking.chunks(df, limit, least).orderBy("pmcid", "chunk_index").collect():
            got.setdefault(r.pmcid, []).append(r.text)
        assert got == {i: f for i, d in enumerate(docs) if (f := fold(d, limit, least))}


def test_captions_and_equal_sections(spark):
    p = [("A", "a" * 100, "paragraph"), ("B", "b" * 100, "paragraph"), ("A", "c" * 100, "paragraph"), ("A", "d" * 90, "figure_caption"), ("A", "e" * 79, "table_caption"), (None, " ", "paragraph")]
    df = spark.createDataFrame([(1, p)], "pmcid long, paragraphs array<struct<section: string, text: string, type: string>>")
    got = {(r.section, r.chunk_index): r.text for r in chunking.chunks(df).collect()}
    assert got == {("A", 0): "a" * 100 + " " + "c" * 100, ("A", 1): "d" * 90, ("B", 0): "b" * 100}


def test_markup():
    long = "a long enough text of words"
    xml = f"""<article><body><p>{long} zero</p><sec><title>One</title><p>{long} <i>in</i>line</p>
      <sec><p>{long} below</p></sec><p>Leading text before the list <b>lost</b><list><list-item><p>{long} item</p><list><list-item><p>{long} nested</p></list-item></list></list-item></list> tail</p>
      <fig><caption><p>{long} figure</p></caption></fig><boxed-text><p>{long} boxed</p></boxed-text><p>19 characters here.</p></sec>
      <sec><title>References</title><sec><p>{long} skipped</p></sec></sec><sec><title>Supplementary Material</title><p>{long} kept</p></sec></body></article>"""
    got = markup.parse_fulltext(xml)
    assert got == [
        ("body", f"{long} zero", "paragraph"), ("One", f"{long} inline", "paragraph"), ("One", f"{long} below", "paragraph"), ("One", "Leading text before the list", "paragraph"),
        ("One", f"{long} item", "paragraph"), ("One", f"{long} nested", "paragraph"), ("One", f"{long} figure", "figure_caption"), ("Supplementary Material", f"{long} kept", "paragraph"),
    ]
    assert markup.parse_fulltext("<article xmlns='u'><body><p>long enough text, in a name space</p></body></article>") == []
    assert markup.parse_fulltext("<broken") == markup.parse_fulltext(None) == []
    assert [markup.diagnose(x) for x in (None, "<a", "<a/>", "<a xmlns='u'><body/></a>", "<a><body/></a>", "<a><body><p/></body></a>", "<a><body><sec/></body></a>")] == ["missing file", "malformed", "no body", "namespaced body", "neither sec nor p", "p without sec", "other"]


def test_pubmed(spark):
    xml = """<S><PubmedArticle><ArticleTitle>T <i>x</i></ArticleTitle><AbstractText Label="AIM">one</AbstractText><AbstractText>two</AbstractText><AbstractText> </AbstractText>
      <Author><LastName>Byron</LastName><ForeName>Ada</ForeName></Author><Author><ForeName>None</ForeName></Author><PubDate><Year>2024</Year></PubDate><ArticleDate><Month>5</Month></ArticleDate>
      <ArticleId IdType="doi"> 10.1/x </ArticleId><Keyword> k </Keyword><PublicationType>Journal Article</PublicationType><Journal><Title>J</Title></Journal></PubmedArticle></S>"""
    r = spark.createDataFrame([(xml,), ("<a",)], "xml string").select(markup.column(markup.parse_pubmed, markup.RECORD)("xml").alias("r")).select("r.*").collect()
    assert (r[0].title, r[0].abstract, r[0].authors, r[0].pub_year, r[0].pub_month, r[0].pub_day, r[0].doi, r[0].keywords) == ("T x", "AIM: one\ntwo", ["Ada Byron"], "2024", "5", "", "10.1/x", ["k"])
    assert r[1].parse_error and r[1].title is None
    front = "<article><article-meta><article-id pub-id-type='pmc'>9</article-id><article-id pub-id-type='pmid'> 77 </article-id></article-meta></article>"
    assert spark.createDataFrame([(front,)], "xml string").select(markup.pmid_of("xml").alias("x")).first().x == "77"


def test_validity_order(spark):
    rows = [(None, None, ["Erratum"], ""), ("1", None, ["Journal Article", "Erratum"], "t"), ("1", None, None, " "), ("1", True, None, "t"), ("1", False, None, "t")]
    df = spark.createDataFrame(rows, "pmid string, no_pubmed_record boolean, article_types array<string>, title string")
    assert [r.x for r in df.select(records.validity().alias("x")).collect()] == ["no_pmid", "article_types_invalid", "no_title", "no_pmid", "valid"]


def test_upsert_twice_is_once(spark):
    old, new = (spark.createDataFrame(x, "k long, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    once = records.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, records.upsert(once, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_fusion_ties_and_filters(spark):
    leg = lambda ids: spark.createDataFrame([(0, i, n) for n, i in enumerate(ids)], "qid long, id long, rank int")
    got = [r.id for r in retrieval.rrf(leg([5, 7]), leg([9, 7]), 10).orderBy("rank").collect()]
    assert got == [7, 5, 9]  # in both; then the dense hit before the sparse one of the same rank
    best = retrieval.rrf(leg([5]), leg([]), 1).first()
    assert best.rrf_score == 1 / 60
    docs = spark.createDataFrame([(1, "red fox", "en"), (2, "red hen", "de"), (3, None, "en")], "id long, text string, lang string")
    q = spark.createDataFrame([(0, "red"), (1, "  ")], "qid long, qtext string")
    assert [(r.qid, r.id) for r in retrieval.sparse_topk(q, docs, 5, {"lang": "de"}).collect()] == [(0, 2)]


def test_metrics(spark):
    runs = spark.createDataFrame([("A", 1, 10, 0.9), ("A", 1, 11, 0.8), ("A", 2, 12, 0.5)], "strategy string, qid long, id long, score double")
    qrels = spark.createDataFrame([(1, 11, 2), (1, 13, 1), (3, 10, 0)], "qid long, id long, rel int")
    r = metrics.ir_metrics(runs, qrels).first()
    assert (r.recall, r.precision, r.mrr) == (0.5, 0.2, 0.5)
    values = spark.createDataFrame([(x,) for x in (5, 1, 1, 9, 7, 3, 3, 3, 2, 8, 4)], "v long")
    got = metrics.by_index(values, "v", {"m": (1, 2), "a": (1, 10), "z": (9, 10)}).first()
    order = sorted((5, 1, 1, 9, 7, 3, 3, 3, 2, 8, 4))
    assert (got.m, got.a, got.z) == (order[5], order[1], order[9])


@pytest.mark.parametrize("kind", ["different", "few", "skewed", "doubles"])
def test_percentiles_are_selected_in_rounds(spark, kind):
    """Ranges that are cut several times: as many values as rows, few values, one value nearly everywhere; nulls are none."""
    rng = random.Random(3)
    make = {"different": lambda i: i * 7 % 5003, "few": lambda i: i % 3, "skewed": lambda i: 9 if i % 40 else i, "doubles": lambda i: rng.gauss(0, 1)}[kind]
    held = [make(i) for i in range(5003)]
    rows = spark.createDataFrame([(x,) for x in [*held, None, None]], "v double" if kind == "doubles" else "v long").repartition(5)
    points = {"least": (0, 1), "m": (1, 2), "a": (1, 10), "z": (9, 10), "most": (5002, 5003)}
    got = metrics.by_index(rows, "v", points, rest=1 if kind in ("few", "skewed") else 50).first()
    assert [got[name] for name in points] == [sorted(held)[5003 * a // b] for a, b in points.values()]
    assert list(metrics.by_index(rows.filter("v IS NULL"), "v", points).first()) == [None] * 5


def test_labels_and_memory(spark):
    rows = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", None), ("a", 3, None, None), ("a", 4, None, "e"), ("b", 1, None, "e")], "k string, pos long, label string, error string")
    got = {r.k: (r.total, r.valid, r.dominant, r.dominant_count) for r in memory.label_summary(rows, "k").collect()}
    assert got == {"a": (4, 3, "x", 1), "b": (1, 0, None, 0)}
    m = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(4)] + [(2, i, "user", " ") for i in range(5)] + [(3, 0, "user", "only")], "conv_id long, turn long, role string, text string")
    t = {r.conv_id: r.transcript for r in memory.transcripts(m).collect()}
    assert t == {1: "[user]: m0", 2: memory.NOTHING, 3: memory.NOTHING}


def test_stream_and_status(spark, tmp_path):
    schema = "pmcid string, pmid string, no_pubmed_record boolean, article_types array<string>, title string"
    rows = lambda ids: spark.createDataFrame([(f"P{i}", str(i), False, None, "t") for i in ids], schema)
    base = f"file://{tmp_path}"
    for name, ids in (("a", range(3)), ("b", range(5))):
        rows(ids).write.parquet(f"{base}/in/{name}")
        incremental.ingest(spark, f"{base}/in/*", schema, f"{base}/status", f"{base}/check")
    assert sorted(r.pmcid for r in incremental.log(spark, f"{base}/status").collect()) == [f"P{i}" for i in range(5)]


def test_agent_and_service(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox runs", "en", "j"), (2, "blue hen", "en", "j")], "id long, text string, lang string, journal string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>")
    a = agent.Agent(spark, docs, vectors, classify=lambda texts: [{"label": "good"} for _ in texts])
    sessions = service.Sessions(spark, f"file://{tmp_path}/sessions")
    out = service.chat(a, sessions, "red fox", " s1 ")
    assert out["iterations"] == 3 and "red fox" in out["answer"] and out["session_id"] == "s1"
    assert sessions.load("s1")["version"] == 1 and sessions.load("none") is None and sessions.load(" ") is None
    service.chat(a, sessions, "blue hen", "s1")
    assert sessions.load("s1")["version"] == 2
    assert [h["pmcid"] for h in service.search(a, "hen")["results"]] == ["2"]
    state = agent.State()
    assert "error" in a.paper(state, "99") and "error" in a.sentiment(state, "not json") and a.answer(state, "q") == agent.NO_TEXT
    assert agent.sentiment([{"pmcid": 1, "text": "x"}, {"pmcid": 2, "text": "y"}], lambda t: [{"label": "p"}])["valid"] == 1
    assert service.health({"a": lambda: 1, "b": lambda: 1 / 0})["status"] == "degraded"

    class Stuck:
        def next(self, messages, summary):
            return {"tool": "search_literature", "args": {"query": ""}}

    assert agent.Agent(spark, docs, vectors, planner=Stuck()).run("x")["answer"] == ""
    assert providers.attempted(lambda t: 1 / 0, ["a", "b"]) == [None, None] and providers.grade({"a": 2}, "a", 0) == 2 and providers.grade({}, "b", "7") == 0
