"""The agent: a bounded loop of tool calls on the driver; every tool that touches data is a DataFrame plan.

A turn takes at most `MOST` steps. Its answer is looked for in the turn itself, so a turn that is cut gives an empty answer
rather than an older one. What searches find accumulates without being made distinct.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.operators.providers import ChatModel, Extractive, Planner, RulePlanner

MOST, FILTERS, NO_TEXT = 5, ("pub_year", "journal", "lang"), "nothing found yet; search first"
SYSTEM = "You answer questions about a collection of papers. Search before you answer, and answer only from what was found."
EARLIER = "Summary of the conversation so far:\n"


@dataclass
class State:
    messages: list[dict] = field(default_factory=list)
    chunks: list[dict] = field(default_factory=list)
    summary: str = ""
    iterations: int = 0


def hit_context(chunks: list[dict], most: int, year: bool = False) -> str:
    parts = []
    for c in chunks[:most]:
        p = c.get("payload", c)
        head = f"{p.get('pmcid', '')} {p.get('pub_year', '')}" if year else p.get("pmcid", "")
        parts.append(f"[{head} / {p.get('section', '')}]\n{p.get('text', '')}")
    return "\n\n---\n\n".join(parts)


def sentiment(pairs: list[dict], score, topic: str = "") -> dict:
    """Labels of texts and a summary of valid ones, the first seen label winning ties.

    score takes the texts, one or many, and answers in their order. A missing answer is an error, one that is no record is kept
    as it came and counts without a label; an answer that is no list, or a failure, makes errors of all.
    """
    valid = [p for p in pairs if isinstance(p, dict) and (p.get("text") or "").strip()]
    if not valid:
        return {"error": "no text to analyse"}
    try:
        got = score([p["text"] for p in valid])
        why = "" if isinstance(got, list) else "the answer is no list"
    except Exception as e:  # noqa: BLE001  whatever the model does, each paper gets a result
        got, why = [], str(e) or type(e).__name__
    rows = []
    for i, p in enumerate(valid):
        if why or i >= len(got):
            own = {"error": why or "no result"}
        else:
            own = got[i] if isinstance(got[i], dict) else {"raw": got[i]}
        rows.append({"pmcid": p.get("pmcid", "")} | own)
    counts: dict[str, int] = {}
    for r in rows:
        if "error" not in r:
            counts[r.get("label", "unknown")] = counts.get(r.get("label", "unknown"), 0) + 1
    out = {"topic": topic, "total": len(rows), "valid": sum(counts.values()), "results": rows}
    if counts:
        out |= {"distribution": counts, "dominant": max(counts, key=counts.get)}
    return out


class Agent:
    """Tools over a corpus (id, text, lang, journal; pmcid, section, source_type and pub_year if it has them) and vectors (id, vec), and the loop that calls them.

    legs: gives the dense and the sparse hits of queries (qid, qtext, qvec), a number and filters; without it both tables are scanned.
    """

    def __init__(self, spark: SparkSession, corpus: DataFrame, vectors: DataFrame, encode=None, planner: Planner | None = None, chat: ChatModel | None = None, classify=None, legs=None):
        self.spark, self.corpus, self.vectors, self.legs = spark, corpus, vectors, legs
        self.encode, self.planner, self.chat, self.classify = encode, planner or RulePlanner(), chat or Extractive(), classify
        self.tools = {"search_literature": self.search, "get_paper_detail": self.paper, "analyze_sentiment": self.sentiment, "answer_question": self.answer, "synthesize_review": self.review}

    def hits(self, query: str, top_k: int = 20, top_n: int = 10, filters: dict | None = None) -> list[dict]:
        if not query.strip():
            return []
        used = {k: v for k, v in (filters or {}).items() if k in FILTERS and k in self.corpus.columns and v}
        q = self.spark.createDataFrame([(0, query)], "qid long, qtext string")
        corpus = R.must(self.corpus, used)
        vec = None if self.encode is None else self.spark.createDataFrame([(0, query, [float(x) for x in self.encode(query)])], "qid long, qtext string, qvec array<double>")
        if self.legs is not None and vec is not None:
            dense, sparse = self.legs(vec, 2 * top_k, used)
        else:
            sparse = R.sparse_topk(q, corpus, 2 * top_k)
            dense = sparse.limit(0) if vec is None else R.dense_topk(vec, self.vectors.join(corpus.select("id"), "id", "left_semi") if used else self.vectors, 2 * top_k)
        found = R.rerank(R.rrf(dense, sparse, top_k), q, corpus, top_n).join(self.corpus, "id", "left").orderBy("rank")
        told = [c for c in ("journal", "section", "source_type", "pub_year") if c in found.columns]
        rows = (r.asDict() for r in found.collect())  # top_n rows
        return [{"pmcid": str(r.get("pmcid") or r["id"]), "text": r["text"] or "", "section": r.get("journal") or "", "pub_year": ""} | {c: r[c] or "" for c in told} | {"score": round(r["rerank_score"], 3)} for r in rows]

    def search(self, state: State, query: str, top_k: int = 20, top_n: int = 10, filters: dict | None = None) -> str:
        found = self.hits(query, top_k, top_n, filters)
        state.chunks += found
        return json.dumps({"count": len(found), "results": [c | {"text": c["text"][:150]} for c in found]}, ensure_ascii=False)

    def paper(self, state: State, pmcid: str) -> str:
        key = "pmcid" if "pmcid" in self.corpus.columns else "id"
        row = self.corpus.filter(F.col(key).cast("string") == pmcid).orderBy("id").limit(1).collect()
        return json.dumps({k: v if v is not None else "" for k, v in row[0].asDict().items()} if row else {"error": f"no paper {pmcid}"}, ensure_ascii=False)

    def sentiment(self, state: State, papers: str | list, topic: str = "") -> str:
        try:
            pairs = json.loads(papers) if isinstance(papers, str) else papers
        except ValueError:
            return json.dumps({"error": "not JSON"})
        if not pairs or self.classify is None:
            return json.dumps({"error": "nothing to analyse" if not pairs else "no model"})
        return json.dumps(sentiment(pairs, self.classify, topic), ensure_ascii=False)

    def answer(self, state: State, question: str) -> str:
        return self.chat.answer("answer from the context", hit_context(state.chunks, 15), question) if state.chunks else NO_TEXT

    def review(self, state: State, topic: str, focus: str = "") -> str:
        asked = f"{topic}\nchunks found: {len(state.chunks)}"
        return self.chat.answer("write a review" + (f" on {focus}" if focus else ""), hit_context(state.chunks, 20, year=True), asked) if state.chunks else NO_TEXT

    @staticmethod
    def told(state: State) -> list[dict]:
        """What the planner sees: the messages, under a system message and the summary unless they have one."""
        if any(m["role"] == "system" for m in state.messages):
            return state.messages
        summary = [{"role": "system", "content": EARLIER + state.summary}] if state.summary else []
        return [{"role": "system", "content": SYSTEM}, *summary, *state.messages]

    def run(self, text: str, history: list[dict] | None = None, chunks: list[dict] | None = None, summary: str = "") -> dict:
        state = State([*(history or []), {"role": "user", "content": text}], list(chunks or []), summary)
        answer = ""
        while state.iterations < MOST:
            step = self.planner.next(self.told(state), state.summary)
            state.iterations += 1
            if "tool" not in step:
                answer = step.get("answer", "")
                state.messages.append({"role": "assistant", "content": answer})
                break
            tool = self.tools.get(step["tool"])
            said = tool(state, **step.get("args", {})) if tool else json.dumps({"error": f"no tool {step['tool']}"})
            state.messages.append({"role": "tool", "tool": step["tool"], "content": said})
        return {"answer": answer, "messages": state.messages, "retrieved_chunks": state.chunks, "iterations": state.iterations, "summary": state.summary}
