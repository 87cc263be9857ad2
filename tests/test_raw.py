"""Fetching, files, pages, tables, providers, reprocessing and the service, on hand-made rows."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

import quarry.__main__ as cli
from quarry import etl, server
from quarry.operators import agent, fetch, markup, providers, records, service
from quarry.plans import raw
from quarry.sources import shared, tables
from quarry.streaming import incremental
from tests.compare import same

PUBMED = "<PubmedArticle><ArticleTitle>T</ArticleTitle></PubmedArticle>"
ARTICLE = "<article><front><article-meta><article-id pub-id-type='pmid'>{}</article-id></article-meta></front></article>"


class Remote:
    """Answers by the key; some requests raise."""

    def fulltext(self, pmcid):
        if pmcid == "A":
            raise OSError("no line")
        return {"B": "<error/>", "C": ARTICLE.format(""), "D": ARTICLE.format("7"), "E": "<pmc-articleset/>", "F": ARTICLE.format("8"), "G": "<article"}.get(pmcid)

    def pmid(self, pmcid):
        if pmcid == "F":
            raise TimeoutError
        return {"E": "5", "G": " 6 "}.get(pmcid)

    def record(self, pmid):
        return {"5": "<broken", "7": f"<S>{PUBMED}</S>", "8": None, " 6 ": f"<S>{PUBMED}</S>"}.get(pmid)


class Finder:
    """Finds 450 ids; the second page fails the first two times that one instance is asked for it."""

    def __init__(self):
        self.failed = 0

    def total(self):
        return 450

    def page(self, start, size):
        if start == 200 and self.failed < 2:
            self.failed += 1
            raise OSError("busy")
        return [str(i) for i in range(start, min(450, start + size))]


def test_paged_search(spark):
    rows = fetch.search_ids(spark, Finder, pause=0, wait=0).collect()
    assert sorted((r.page, r.pmcid) for r in rows) == sorted((i // 200, f"PMC{i}") for i in range(450))
    waits = []
    with pytest.raises(ZeroDivisionError):
        fetch.repeated(lambda: 1 / 0, 5.0, 3, waits.append)
    assert waits == [5.0, 5.0]


def test_outcomes_of_a_remote(spark):
    keys = spark.createDataFrame([(x,) for x in "ABCDEFGH"], "pmcid string")
    got = {r.pmcid: (r.outcome, r.pmid) for r in fetch.outcomes(fetch.answers(keys, Remote, pause=0)).collect()}
    assert got == {"A": ("failed", None), "B": ("failed", None), "C": ("no_pmid", None), "D": ("fetched", "7"), "E": ("failed", "5"), "F": ("failed", "8"), "G": ("fetched", "6"), "H": ("failed", None)}


def test_final_keys_are_not_asked_again(spark):
    keys = spark.createDataFrame([(x,) for x in "ABCB"], "pmcid string")
    log = spark.createDataFrame([("A", "failed", 1), ("A", "fetched", 2), ("B", "fetched", 1), ("B", "failed", 2), ("X", "no_pmid", 1)], "pmcid string, status string, attempt int")
    assert sorted(r.pmcid for r in fetch.todo(keys, log).collect()) == ["B", "C"]
    found = spark.createDataFrame([("B", "no_pmid"), ("C", "failed")], "pmcid string, outcome string")
    assert sorted(map(tuple, fetch.logged(log, found).filter("pmcid in ('B', 'C')").collect())) == [("B", "failed", 2), ("B", "fetched", 1), ("B", "no_pmid", 3), ("C", "failed", 1)]


def test_last_writers_win(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(2, "first", 1), (2, "last", 2), (3, "d", 1), (None, "m", 1)], "k long, v string, seq int")
    assert sorted(map(str, records.upsert(old, new, "k", ("seq",)).collect())) == sorted(map(str, spark.createDataFrame([(1, "a"), (2, "last"), (3, "d"), (None, "m")], old.schema).collect()))
    rows = spark.createDataFrame([("P1", "x"), ("P2", "y"), ("", "z"), (None, "w")], "pmcid string, year string")
    newer = spark.createDataFrame([("P1", "2020", 1), ("P1", "2021", 2), ("P1", None, 3), ("", "2022", 1)], "pmcid string, year string, seq int")
    assert sorted(map(str, (tuple(r) for r in records.backfill(rows, newer, "pmcid", "year", ("seq",)).collect()))) == sorted(map(str, [("P1", "2021"), ("P2", "y"), ("", "z"), (None, "w")]))
    assert [tuple(r) for r in records.lookup(rows.filter("pmcid = 'P1'").select("pmcid"), newer, "pmcid", ["year"], ("seq",)).collect()] == [("P1", "")]


def test_grouped_updates_are_bounded(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(5000)], "id long, value string")
    got = records.update_groups(rows, "id", ["value"], 100).collect()
    assert sorted(k for r in got for k in r["keys"]) == list(range(5000)) and max(len(r["keys"]) for r in got) <= 100
    assert {r.value for r in got} == {"hot", None}
    lacking = spark.createDataFrame([(1, None, 1), (1, 2, None), (2, 1, 1), (3, None, None)], "k long, a int, b int")
    assert sorted(r.k for r in records.failed(lacking, "k", "a", "b").collect()) == [1, 3]


def test_files_by_key(spark, tmp_path):
    path = f"file://{tmp_path}/meta"
    rows = spark.createDataFrame([("P1", "1", "Ünï", None), (None, "2", "t", "x")], "pmcid string, pmid string, title string, doi string").withColumn("pmcid", F.coalesce("pmcid", F.lit("P2")))
    tables.write_metadata(rows, path)
    tables.write_metadata(rows.filter("pmcid = 'P1'").withColumn("title", F.lit("again")), path)
    (tmp_path / "meta" / "P9.json").write_text('{"pmid": "9", "title": "by name"}')
    (tmp_path / "meta" / "P8.json").write_text("{")
    valid, status = tables.scanned(tables.read_metadata(spark, path))
    assert {r.pmcid: r.title for r in valid.collect()} == {"P1": "again", "P2": "t", "P9": "by name"}
    assert {r.pmcid: r.status for r in status.collect()} == {"P1": "valid", "P2": "valid", "P9": "valid", "P8": "parse_error"}


def test_pages_and_cache(spark, tmp_path):
    ids = spark.createDataFrame([(f"P{i % 700:04d}",) for i in range(1400)] + [(None,)], "pmcid string")
    got = tables.id_pages(spark, ids, 200).collect()
    assert {(r.page, r.pmcid) for r in got} == {(i // 200, f"P{i:04d}") for i in range(700)} and len(got) == 700
    calls = []

    def search():
        calls.append(1)
        return ids.limit(3)

    for _ in range(2):
        assert tables.cached_ids(spark, f"file://{tmp_path}/ids", search).count() == 3
    assert calls == [1] and shared.exists(spark, f"file://{tmp_path}/ids") and shared.deleted(spark, f"file://{tmp_path}/ids") and not shared.exists(spark, f"file://{tmp_path}/ids")


def test_embedding_waits_and_marks_whole_batches(spark):
    waits, calls = [], []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError
        return [[1.0]] * len(texts)

    assert providers.attempted(flaky, ["a", "b"], sleep=waits.append) == [[1.0], [1.0]] and waits == [1.0, 2.0]
    assert providers.attempted(lambda t: [], ["a"], sleep=waits.append) == [None] and waits == [1.0, 2.0, 1.0, 2.0]
    rows = spark.createDataFrame([(i, None if i == 2 else f"text {i}" + ("\0" if i == 5 else "")) for i in range(8)], "id long, text string").coalesce(1)
    got = providers.embedded_both(rows, providers.letters, providers.term_weights, batch=2, wait=0.0).orderBy("id").collect()
    assert [r.id for r in got if r.dense is None] == [2, 5, 6] and [r.id for r in got if r.sparse is None] == [2]
    assert got[0].sparse.indices == sorted(got[0].sparse.indices) and len(got[0].sparse["values"]) == 2
    made = []
    maker = lambda temperature, max_tokens: made.append(1) or object()
    assert providers.model(maker, 0.0, 800) is providers.model(maker, 0.0, 800) is not providers.model(maker, 0.5, 800) and len(made) == 2


def test_terms_that_share_an_index_are_counted_in_sum(spark, tmp_path):
    """`eahain` and `sheash` have equal first 28 bits of their MD5; an index's value is ln(1 + count) of both, so counts can be told from it."""
    text = "eahain sheash sheash " + "and a text that is long enough for a chunk " * 3
    spark.createDataFrame([(1, text, "en", "web")], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    same(raw.QUERIES["embed_chunks"](spark, str(tmp_path)), raw.ORACLE_SQL["embed_chunks"], str(tmp_path))


def test_a_task_parses_a_slice_at_a_time(spark):
    """However many rows Spark sends at once, Python values of no more than a slice are held; nulls and empty tables go through."""
    rows = spark.range(0, 1000, 1, 1).select(F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("x"))
    got = rows.select("x", markup.sliced(lambda texts: [f"{len(texts)} {t}" for t in texts], "string", 100)("x").alias("y")).collect()
    assert len(got) == 1000 and all(r.y == f"100 {r.x}" for r in got)
    assert rows.limit(0).select(markup.column(markup.parse_pubmed, markup.RECORD)("x").alias("r")).select("r.*").count() == 0


def test_judges_and_questions(spark):
    pairs = spark.createDataFrame([(1, "red fox", "a red fox", None), (2, "red fox", "x", 2), (3, "q", "bad", None), (4, "q", "raise", None), (5, None, None, None)], "id long, qtext string, text string, known int")

    def judge(query, text):
        if text == "raise":
            raise OSError
        return "2!" if text == "bad" else f" {providers.by_words(query, text)} "

    assert {r.id: r.rel for r in providers.judged(pairs, judge).collect()} == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0}
    assert {r.id: r.rel for r in providers.judged(pairs, None).collect()} == {1: 0, 2: 2, 3: 0, 4: 0, 5: 0}
    papers = spark.createDataFrame([("P1", "one two three four five six seven"), ("P2", "few"), ("P3", None)], "pmcid string, abstract string")
    assert [(r.pmcid, r.pos, r["query"], r.relevance) for r in providers.questions(papers, providers.first_words).orderBy("pos").collect()] == [("P1", 0, "one two three four five", 2), ("P1", 1, "three four five six", 2)]
    plain = providers.questions(papers, lambda t: '{"questions": [{"query": "q"}]}' if t else "[]").collect()
    assert [(r.pmcid, r["query"], r.intent) for r in plain] == [("P1", "q", ""), ("P2", "q", "")]


def test_pages_of_html():
    html = "<html><head><title>no</title></head><body><h2>Part  one</h2><p>A paragraph that is &amp; long enough<p>Another one, unclosed, long<script>var x = '</p>'</script><nav>left out of the text, surely</nav><h3></h3><div>Under an empty heading still</div>short"
    assert markup.parse_page(html) == [("Part one", "A paragraph that is & long enough", "paragraph"), ("Part one", "Another one, unclosed, long", "paragraph"), ("Part one", "Under an empty heading still", "paragraph")]
    assert markup.parse_page(None) == []
    assert markup.own_pmid("<a") is None and markup.own_pmid(ARTICLE.format(" 3 ")) == "3"


def test_reprocessing(spark):
    report = spark.createDataFrame([("P1", "FAIL"), ("P2", "FAIL"), ("P3", "FAIL"), ("P4", "OK"), ("P5", "FAIL"), ("P1", "FAIL")], "pmcid string, status string")
    text = "A paragraph that is long enough to be kept as a chunk of its own, which takes eighty characters. "
    body = lambda t: f"<article><body><sec><p>{t}</p></sec></body></article>"
    files = spark.createDataFrame([("P1", body(text)), ("P2", body("short")), ("P4", body(text)), ("P5", body(text + "&#1;"))], "pmcid string, xml string")
    papers = spark.createDataFrame([("P1", "2020", "J")], "pmcid string, pub_year string, journal string")
    assert sorted(map(tuple, etl.reprocess(report, files, papers, providers.letters, providers.term_weights, dry_run=True).collect())) == [("P1", True), ("P2", True), ("P3", False), ("P5", True)]

    def refuse(texts):
        raise OSError

    for embed, outcome in ((providers.letters, "success"), (refuse, "embed_failed")):
        got = {r.pmcid: (r.outcome, r.n_chunks, r.n_written) for r in etl.reprocess(report, files, papers, embed, providers.term_weights, wait=0.0).collect()}
        assert got == {"P1": (outcome, 1, int(outcome == "success")), "P2": ("still_empty", 0, 0), "P3": ("missing", 0, 0), "P5": ("still_empty", 0, 0)}


def test_streams(spark, tmp_path):
    base = f"file://{tmp_path}"
    schema = "pmcid string, pmid string, no_pubmed_record boolean, article_types array<string>, title string"
    rows = lambda ids, title="t": spark.createDataFrame([(f"P{i}", str(i), False, None, title) for i in ids], schema)
    rows(range(3)).unionByName(rows([1], " ")).write.parquet(f"{base}/in/a")
    incremental.ingest(spark, f"{base}/in/*", schema, f"{base}/status", f"{base}/one")
    rows(range(5), " ").write.parquet(f"{base}/in/b")
    incremental.ingest(spark, f"{base}/in/*", schema, f"{base}/status", f"{base}/two")  # a new checkpoint over the old log
    assert sorted((r.pmcid, r.status) for r in incremental.log(spark, f"{base}/status").collect()) == [("P0", "valid"), ("P1", "valid"), ("P2", "valid"), ("P3", "no_title"), ("P4", "no_title")]
    events = lambda days: spark.sql(f"SELECT explode(array({', '.join(days)})) AS ts, 'a' AS event_type")
    events(["timestamp'2024-01-01 10:00'", "timestamp'2024-01-01 11:00'", "timestamp'2024-01-02 01:00'", "timestamp'2024-01-05 01:00'"]).write.parquet(f"{base}/events")
    incremental.totals_stream(spark, f"{base}/events", "ts timestamp, event_type string", f"{base}/days", f"{base}/three")
    events(["timestamp'2024-01-01 12:00'", "timestamp'2024-01-09 12:00'"]).write.mode("append").parquet(f"{base}/events")  # the first comes too late
    incremental.totals_stream(spark, f"{base}/events", "ts timestamp, event_type string", f"{base}/days", f"{base}/three")
    assert sorted((str(r.day)[:10], r.n) for r in spark.read.parquet(f"{base}/days").collect()) == [("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-05", 1)]


@pytest.fixture(scope="module")
def talker(spark):
    docs = spark.createDataFrame([(1, "red fox runs", "en", "j", "2020", "s1"), (2, "blue hen", "en", "k", "2021", "s2")], "id long, text string, lang string, journal string, pub_year string, section string")
    return agent.Agent(spark, docs, spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>"), classify=lambda texts: [{"label": "good"}, "odd"][: len(texts)])


def test_agent_plans_and_filters(talker):
    assert [h["pmcid"] for h in talker.hits("red hen", filters={"pub_year": "2021", "source": "x"})] == ["2"]
    hit = talker.hits("fox")[0]
    assert (hit["pub_year"], hit["section"], hit["journal"]) == ("2020", "s1", "j")
    assert "red fox" in talker.run("tell me of paper 1")["answer"] and "no paper" in talker.run("paper 77")["answer"]
    said = json.loads(talker.run("what is the sentiment on red hen")["answer"])
    assert said["valid"] == 2 and said["distribution"] == {"good": 1, "unknown": 1}

    class Seen:
        def answer(self, system, context, question):
            return f"{system}|{question}|{context}"

    own = agent.Agent(talker.spark, talker.corpus, talker.vectors, chat=Seen())
    review = own.run("a review of red fox")["answer"]
    assert "write a review" in review and "chunks found: 1" in review and "[1 2020 / s1]" in review
    told = agent.Agent.told(agent.State([{"role": "user", "content": "x"}], summary="earlier"))
    assert [m["role"] for m in told] == ["system", "system", "user"] and told[1]["content"].endswith("earlier")
    assert agent.sentiment([{"text": "x"}], lambda t: "no list")["results"][0]["error"] and agent.sentiment([{"text": "x"}], lambda t: 1 / 0)["valid"] == 0


def test_encoded_questions_have_dense_hits(talker):
    own = agent.Agent(talker.spark, talker.corpus, talker.vectors, encode=lambda q: [1.0, 0.0] if "fox" in q else [0.0, 1.0])
    assert [h["pmcid"] for h in own.hits("zzz fox zzz")] == ["1"] and [h["pmcid"] for h in own.hits("blue")] == ["2", "1"]


def test_sessions(spark, tmp_path):
    s = service.Sessions(spark, f"file://{tmp_path}/s")
    assert not s.save(" ", "x", [], []) and s.load("a") is None
    for i in range(3):
        assert s.save(" a ", f"sum {i}", [{"role": "user", "content": "é"}], [{"pmcid": "1"}])
    s.save("b", "other", [], None)
    got = s.load("a")
    assert (got["summary"], got["version"], got["history"]) == ("sum 2", 3, [{"role": "user", "content": "é"}]) and got["updated_at"] is not None
    c = s.compacted(f"file://{tmp_path}/c")
    assert c.rows().count() == 2 and c.load("a")["version"] == 3 and c.load("b")["retrieved_chunks"] == []
    m = [{"role": "user", "content": f"m{i}"} for i in range(4)]
    assert service.summarized("old", m[:2], lambda o, t: f"{o}+{t}") == ("old+", m[:2]) and service.summarized("", m[:2], lambda o, t: 1 / 0) == ("", m[:2])
    assert service.summarized("old", m, lambda o, t: "无。") == ("", m[1:]) and service.summarized("old", m, lambda o, t: 1 / 0) == ("old", m[1:])


def test_turns_at_once_are_all_kept(spark, tmp_path):
    """Ten threads talk in one session: every turn is in its summary or its last messages, and counts one version."""
    from concurrent.futures import ThreadPoolExecutor

    class Echo:
        def run(self, said, history, chunks, summary):
            return {"answer": said, "iterations": 1, "messages": [*history, {"role": "user", "content": said}], "retrieved_chunks": [*chunks, {"pmcid": said}]}

    s = service.Sessions(spark, f"file://{tmp_path}/s")
    with ThreadPoolExecutor(10) as pool:
        list(pool.map(lambda i: service.chat(Echo(), s, f"turn-{i}", "one"), range(10)))
    got = s.load("one")
    told = got["summary"] + " ".join(m["content"] for m in got["history"])
    assert got["version"] == 10 and len(got["history"]) == 3 and all(told.count(f"turn-{i}") == 1 for i in range(10))
    assert sorted(c["pmcid"] for c in got["retrieved_chunks"]) == [f"turn-{i}" for i in range(10)]


def test_service_over_http(spark, talker, tmp_path):
    http = server.served(talker, service.Sessions(spark, f"file://{tmp_path}/s"), {"a": lambda: 1, "b": lambda: 1 / 0}, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def call(path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_address[1]}{path}", json.dumps(body).encode() if body is not None else None)
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/health") == (200, {"status": "degraded", "a": "ok", "b": "error: division by zero"})
        assert call("/search", {"query": "hen"})[1]["results"][0]["pmcid"] == "2"
        assert call("/search", {"query": "hen", "top_k": 500})[0] == call("/search", {})[0] == call("/chat", [1])[0] == 422
        status, said = call("/chat", {"user_input": "red fox", "session_id": "s"})
        assert status == 200 and said["session_id"] == "s" and "red fox" in said["answer"]
        assert call("/none")[0] == call("/none", {})[0] == 404
    finally:
        http.shutdown()
        http.server_close()


def test_command_line(spark, talker, tmp_path, capsys):
    said = []
    assert cli.talk(talker, service.Sessions(spark, f"file://{tmp_path}/s"), "x", ["red fox\n", "  \n", "QUIT\n", "never"], said.append) == 1 and "red fox" in said[0]
    args = cli.arguments().parse_args(["--data", "d", "--pipeline", "--api", "--port", "9"])
    assert args.pipeline and args.api and args.port == 9 and cli.port_of("x") == server.DEFAULT_PORT
