"""What is left to models, behind interfaces, with deterministic offline defaults. The defaults are stand-ins, not models."""

from __future__ import annotations

import collections
import functools
import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quarry.functions.text import unfenced


class ChatModel(Protocol):
    def answer(self, system: str, context: str, question: str) -> str: ...


class Planner(Protocol):
    def next(self, messages: list[dict], summary: str) -> dict: ...


class Extractive:
    """Answers with the first lines of the context."""

    def answer(self, system: str, context: str, question: str) -> str:
        return context[:400]


class RulePlanner:
    """Plans by words of the question: a paper by its id, else a search and then what was asked for: attitudes, a review or an answer."""

    def next(self, messages: list[dict], summary: str) -> dict:
        asked = max(i for i, m in enumerate(messages) if m["role"] == "user")
        said = {m["tool"]: m["content"] for m in messages[asked:] if m["role"] == "tool"}
        question = messages[asked]["content"]
        paper = re.search(r"\bpaper (\w+)", question, re.IGNORECASE)
        if paper:
            steps = [("get_paper_detail", {"pmcid": paper[1]})]
        else:
            last = ("answer_question", {"question": question})
            if re.search(r"\b(sentiment|attitude)", question, re.IGNORECASE):
                last = ("analyze_sentiment", {"papers": found(said.get("search_literature", ""))})
            elif re.search(r"\breview\b", question, re.IGNORECASE):
                last = ("synthesize_review", {"topic": question})
            steps = [("search_literature", {"query": question}), last]
        for tool, args in steps:
            if tool not in said:
                return {"tool": tool, "args": args}
        return {"answer": said[steps[-1][0]]}


def found(said: str) -> list[dict]:
    """The papers and texts of a search's answer."""
    try:
        return [{"pmcid": x["pmcid"], "text": x["text"]} for x in json.loads(said)["results"]]
    except (ValueError, KeyError, TypeError):
        return []


@functools.lru_cache(maxsize=64)
def model(make: Callable[..., object], temperature: float = 0.1, max_tokens: int = 1500) -> object:
    """A model, made once in a process for each maker and setting; workers make their own."""
    return make(temperature=temperature, max_tokens=max_tokens)


def attempted(embed: Callable[[list[str]], list], texts: list[str], attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """embed for a whole batch, tried `attempts` times with waits of wait, 2 * wait... between; after the last failure the whole batch is null."""
    for n in range(attempts):
        try:
            got = list(embed(texts))
            if len(got) == len(texts):
                return got
        except Exception:  # noqa: BLE001, S110  a provider may fail in any way; the batch is marked, the job goes on
            pass
        if n + 1 < attempts:
            sleep(wait * 2**n)
    return [None] * len(texts)


SPARSE = "struct<indices: array<int>, values: array<float>>"


def embedder(embed: Callable[[list[str]], list], schema: str, batch: int = 200, attempts: int = 3, wait: float = 1.0):
    """An Arrow UDF: text to vector, `batch` texts at a time and in order; a null text has no vector."""

    kind = to_arrow_type(DataType.fromDDL(schema))

    def vectors(texts: list) -> list:
        there = [i for i, t in enumerate(texts) if t is not None]
        out: list = [None] * len(texts)
        for i, v in zip(there, attempted(embed, [texts[i] for i in there], attempts, wait) if there else [], strict=True):
            out[i] = v
        return out

    @F.arrow_udf(schema)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """A batch as Spark sends it is held as Arrow alone; texts and vectors are those of `batch` texts that are there."""
        for texts in batches:
            at, nulls = 0, texts.is_null().to_numpy(zero_copy_only=False)
            there = (~nulls).nonzero()[0]
            for end in [*there[batch::batch].tolist(), len(texts)] if len(texts) else []:
                yield pa.array(vectors(texts.slice(at, end - at).to_pylist()), kind)
                at = end

    return apply.asNondeterministic()


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list], name: str = "dense", batch: int = 200, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """chunks with one more column, dense vectors by `embed`; a batch that keeps failing has none."""
    return chunks.withColumn(name, embedder(embed, "array<float>", batch, attempts, wait)(F.col("text")))


def embedded_both(chunks: DataFrame, dense: Callable[[list[str]], list], sparse: Callable[[list[str]], list], batch: int = 200, wait: float = 1.0) -> DataFrame:
    """chunks with `dense` and `sparse` (SPARSE); dense batches are tried three times, sparse ones once."""
    out = embedded(chunks, dense, "dense", batch, 3, wait).withColumn("sparse", embedder(sparse, SPARSE, batch, 1)(F.col("text")))
    return out.withColumn("sparse", F.when(F.col("sparse.indices").isNotNull(), F.col("sparse")))


def letters(texts: list[str]) -> list[list[float]]:
    """The offline stand-in of a dense encoder: shares of some characters. It refuses a batch with a text that has a NUL."""
    if any("\0" in t for t in texts):
        raise ValueError("a text has a NUL")
    return [[t.count(c) / max(1, len(t)) for c in " aeinrst"] for t in texts]


@functools.lru_cache(maxsize=1 << 16)
def term_index(term: str) -> int:
    return int(hashlib.md5(term.encode(), usedforsecurity=False).hexdigest()[:7], 16)


def term_weights(texts: list[str]) -> list[dict]:
    """The offline sparse encoder: a term's index is the first 28 bits of its MD5, an index's value ln(1 + count) of all terms that have it."""
    out = []
    for t in texts:
        counts: dict[int, int] = {}
        for term, n in collections.Counter(re.findall("[a-z0-9]+", t.lower())).items():
            i = term_index(term)
            counts[i] = counts.get(i, 0) + n
        out.append({"indices": sorted(counts), "values": [math.log1p(counts[i]) for i in sorted(counts)]})
    return out


def grade(known: dict[str, int], key: str, judged: object) -> int:
    """A relevance grade: a known label first, then a judged 0, 1 or 2, else 0."""
    return known[key] if key in known else int(judged) if str(judged).strip() in {"0", "1", "2"} else 0


MOST_JUDGED, MOST_ASKED, MOST_TOLD = 600, 1500, 300


def judged(pairs: DataFrame, judge: Callable[[str, str], str] | None) -> DataFrame:
    """pairs (qtext, text, known int, more...) with `rel`: a known label, else what the judge says of the first 600 characters.

    Anything but 0, 1 or 2 counts as 0, and so does a failure; without a judge (the fast mode) what is not known is 0.
    """
    if judge is None:
        return pairs.withColumn("rel", F.coalesce(F.col("known"), F.lit(0)))

    @F.pandas_udf("string")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for known, query, text in batches:
            out = []
            for k, q, t in zip(known, query, text, strict=True):
                try:
                    out.append(None if pd.notna(k) else judge(q or "", t or ""))
                except Exception:  # noqa: BLE001  a judge that fails has not found it relevant
                    out.append(None)
            yield pd.Series(out, dtype=object)

    said = F.trim(ask.asNondeterministic()(F.col("known"), F.col("qtext"), F.substring(F.coalesce("text", F.lit("")), 1, MOST_JUDGED)))
    return pairs.withColumn("rel", F.coalesce(F.col("known"), F.when(said.isin("0", "1", "2"), said.cast("int")), F.lit(0)))


def by_words(query: str, text: str) -> str:
    """The offline judge: 2 for half of the query's words, 1 for a quarter, else 0."""
    q, t = (set(re.findall("[a-z0-9]+", x.lower())) for x in (query, text))
    share = len(q & t) / len(q) if q else 0
    return "2" if share >= 0.5 else "1" if share >= 0.25 else "0"


def questions(papers: DataFrame, generate: Callable[[str], str]) -> DataFrame:
    """(pmcid, pos, query, intent, relevance, source_abstract) of papers (pmcid, abstract): what the model asks of each, as JSON in or out of a code fence.

    It sees 1,500 characters; the paper is relevant (2) to its own questions; an answer that is no such JSON has none.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                try:
                    out.append(generate(t or ""))
                except Exception:  # noqa: BLE001  a paper without questions is left out
                    out.append(None)
            yield pd.Series(out, dtype=object)

    told = unfenced(ask.asNondeterministic()(F.substring(F.coalesce("abstract", F.lit("")), 1, MOST_ASKED)))
    parsed = F.from_json(told, "questions array<struct<query: string, intent: string>>", {"mode": "PERMISSIVE"})
    rows = papers.select("pmcid", F.substring(F.coalesce("abstract", F.lit("")), 1, MOST_TOLD).alias("source_abstract"), parsed.alias("q"))
    out = rows.select("pmcid", "source_abstract", F.posexplode("q.questions").alias("pos", "x"))
    return out.select("pmcid", "pos", F.coalesce("x.query", F.lit("")).alias("query"), F.coalesce("x.intent", F.lit("")).alias("intent"), F.lit(2).alias("relevance"), "source_abstract")


def first_words(text: str) -> str:
    """The offline generator: two questions of a text's first words, in a code fence; none for a text of under five words."""
    words = text.split()
    if len(words) < 5:
        return "no questions"
    asked = [{"query": " ".join(words[:5]), "intent": "mechanism"}, {"query": " ".join(words[2:6]), "intent": "treatment"}]
    return "```json\n" + json.dumps({"questions": asked}, ensure_ascii=False) + "\n```"
