"""The service's three calls, and sessions that they keep: chat, search, health."""

from __future__ import annotations

import contextlib
import datetime
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarry.operators.agent import Agent
from quarry.sources.keyed import KeyedTable, Taken

log = logging.getLogger(__name__)

SESSION = "session_id string, summary string, history string, retrieved_chunks string, version long, updated_at timestamp"
BUCKETS, VERSIONS = 256, 20
#: How a model says that there is nothing to sum up.
NOTHING = ("无", "无。", "无.")


class Sessions:
    """Sessions as a versioned keyed table: a lookup reads one bucket, and a write rewrites one.

    Of two writers of a session at once, the second builds on what the first has left (`change`), so no turn is lost. Saving and
    loading are best effort: a failure is told, and the turn goes on.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, KeyedTable(spark, path)

    def rows(self) -> DataFrame | None:
        try:
            return self.table.read()
        except ValueError:
            return None

    def load(self, session_id: str) -> dict | None:
        key = (session_id or "").strip()
        if not key or not self.table.versions():
            return None
        found = self.table.lookup([key]).collect()
        return session_of(found[0]) if found else None

    def change(self, session_id: str, update: Callable[[dict | None], dict]) -> bool:
        """Puts update(the session as it is, or None) in its place, as one step; whether it was saved. update may be called again. A blank id is no session."""
        key = (session_id or "").strip()
        if not key:
            return False

        def merged(old: DataFrame, names: list[str], column: str) -> DataFrame:
            found = old.filter(F.col(column) == key).collect()
            now = session_of(found[0]) if found else None
            new = update(now)
            lists = [json.dumps(x if isinstance(x, list) else [], ensure_ascii=False) for x in (new["history"], new["retrieved_chunks"])]
            row = (key, new["summary"] or "", *lists, (now["version"] or 0) + 1 if now else 1, datetime.datetime.now(datetime.UTC))
            return old.filter(~F.col(column).eqNullSafe(F.lit(key))).unionByName(self.spark.createDataFrame([row], SESSION))

        try:
            if not self.table.versions():
                with contextlib.suppress(Taken):
                    self.table.create(self.spark.createDataFrame([], SESSION), "session_id", BUCKETS)
            version = self.table.write(self.spark.createDataFrame([(key,)], "session_id string"), merged)
            if version % VERSIONS == 0:
                self.table.expire(VERSIONS)
        except Exception:
            log.warning("session %s was not saved", key, exc_info=True)
            return False
        return True

    def save(self, session_id: str, summary: str, history: list, chunks: list) -> bool:
        """Whether it was saved, whatever was there before."""
        return self.change(session_id, lambda now: {"summary": summary, "history": history, "retrieved_chunks": chunks})

    def compacted(self, path: str) -> Sessions:
        """The sessions as they are now, under another path, without their earlier versions."""
        rows, out = self.rows(), Sessions(self.spark, path)
        if rows is not None:
            out.table.create(rows, "session_id", BUCKETS).upsert(rows)
        return out


def session_of(row: Row) -> dict:
    listed = lambda x: y if isinstance(y := parsed(x), list) else []
    return {"summary": row.summary or "", "history": listed(row.history), "retrieved_chunks": listed(row.retrieved_chunks), "version": row.version, "updated_at": row.updated_at}


def parsed(text: str | None) -> object:
    try:
        return json.loads(text or "[]")
    except ValueError:
        return None


def summarized(old: str, messages: list[dict], write, keep: int = 3) -> tuple[str, list[dict]]:
    """(new summary, last messages): all but the last `keep` messages join the old summary, which is written anew with them.

    With neither there is nothing to write; a writer that fails keeps the old one, one that finds nothing empties it.
    """
    past, recent = (messages[:-keep], messages[-keep:]) if len(messages) > keep else ([], list(messages))
    if not messages or not (past or (old or "").strip()):
        return old or "", recent
    lines = [f"[{m['role']}]: {m['content'].strip()[:2000]}" for m in past if (m.get("content") or "").strip()]
    try:
        new = write(old or "", "\n".join(lines)[:12000]).strip()
    except Exception:  # noqa: BLE001  whatever a model does, the session goes on
        return old or "", recent
    return ("" if new in NOTHING else new), recent


def chat(agent: Agent, sessions: Sessions, user_input: str, session_id: str = "default", write=lambda old, text: (old + "\n" + text).strip()[-2000:]) -> dict:
    if not user_input:
        raise ValueError("user_input must not be empty")
    key = (session_id or "").strip() or "default"
    past = sessions.load(key) or {"summary": "", "history": [], "retrieved_chunks": []}
    out = agent.run(user_input, past["history"], past["retrieved_chunks"], past["summary"])

    def turned(now: dict | None) -> dict:
        """The session after this turn. If another turn was saved meanwhile, this one's messages come after that one's."""
        base = now or {"summary": "", "history": [], "retrieved_chunks": [], "version": None}
        messages = out["messages"]
        if base.get("version") != past.get("version"):
            old = len(past["history"]) if messages[: len(past["history"])] == past["history"] else 0
            messages = base["history"] + messages[old:]
        summary, recent = summarized(base["summary"], messages, write)
        known = [c for c in base["retrieved_chunks"] if c not in out["retrieved_chunks"]] if base.get("version") != past.get("version") else []
        return {"summary": summary, "history": recent, "retrieved_chunks": known + out["retrieved_chunks"]}

    sessions.change(key, turned)
    return {"answer": out["answer"], "iterations": out["iterations"], "session_id": key}


def search(agent: Agent, query: str, top_k: int = 20, top_n: int = 5, filters: dict | None = None) -> dict:
    if not query or not 1 <= top_k <= 100 or not 1 <= top_n <= 50:
        raise ValueError("query must not be empty, top_k is 1 to 100, top_n 1 to 50")
    return {"results": agent.hits(query, top_k, top_n, filters)}


def health(checks: dict) -> dict:
    """ok if every check passes, else degraded, with each check's own state."""
    state = {}
    for name, check in checks.items():
        try:
            check()
            state[name] = "ok"
        except Exception as e:  # noqa: BLE001  any failure is what is being reported
            state[name] = f"error: {e}"[:200]
    return {"status": "ok" if all(v == "ok" for v in state.values()) else "degraded"} | state
