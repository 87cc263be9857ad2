"""Removal of repeated passages by suffix automata of reference shards, through which documents are streamed.

A window is `WINDOW` consecutive words of one document; a word goes if a window that covers it also starts in a document
with a smaller id. A shard's automaton holds the passages of its part of the key space, added in the order of ids, and each
state knows the smallest id that it occurs in. A document's passages are streamed through it: the matching statistics tell
where a whole window matches, and the state reached tells whether it does in a smaller id. Maximal spans of such windows go.

What makes the work linear: every window has a key, the least hash of its runs of `GRAM` words, so equal windows have equal
keys; consecutive windows of one key travel as one passage. Keys are counted first, and only passages whose key occurs under
several ids are sent; those are about the repeated part of the corpus. The shard of a passage follows from its key, so that a
document meets the few shards that can hold what it repeats, not all of them, and a shard's reference is a bounded number of
words. Its reference goes to every task that streams through it, which is one task but for crowded shards.

Hot keys: a key of over `CROWDED` documents is cut into single windows, each with a key from its own words, so that no
frequent run of words brings its many contexts together. A shard with over `MOST_ROWS` passages is streamed by several tasks,
each of which gets the shard's reference: one row for each different passage, with its smallest id, combined before the shuffle.
Repeated keys go to all tasks as an array up to `MOST_KEYS` of them (32 MB); beyond, they are joined to the documents. The
result is the same, and exact, on every way: hashes only route.

Defined cases: a null text has no words, nor has one of blanks; a row without an id keeps all its words and is no reference; rows
with equal ids never remove each other's words; under 13 words there is no window; `with_kept` keeps further columns, and its
own take the place of those of the same name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_bytes, shuffle_partitions, unused, utf8, written

WINDOW, GRAM, MOST_RUN, CROWDED, MOST_ROWS, MOST_KEYS, SHARD_WORDS, TASK_BYTES = 13, 5, 256, 1 << 16, 1 << 16, 1 << 22, 200_000, 64 << 20
#: Odd multipliers that mix hashes.
MIX, AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PASSAGES = "shard long, doc_id long, token long, at int, words binary"


def keys_of(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """The key of each window."""
    gram, n = min(GRAM, window), len(words)
    if n < window:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    g = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        g = (g ^ h[j : n - gram + 1 + j]) * MIX
        g ^= g >> np.uint64(29)
    least = g[: n - window + 1].copy()
    for j in range(1, window - gram + 1):
        np.minimum(least, g[j : j + len(least)], out=least)
    return least.view(np.int64)


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) window of each run of equal keys, of `MOST_RUN` windows at most."""
    change = np.concatenate([[True], keys[1:] != keys[:-1]])
    at = np.arange(len(keys))
    into = at - np.maximum.accumulate(np.where(change, at, 0))
    first = np.flatnonzero(into % MOST_RUN == 0)
    return first, np.append(first[1:], len(keys))


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def passages(text: str, repeated: np.ndarray, crowded: np.ndarray, shards: int, window: int = WINDOW) -> tuple[list, list, list]:
    """(shards, first words, passages) of a text: what may be repeated. repeated, crowded: sorted keys."""
    words = utf8(text).split()
    keys = keys_of(words, window)
    out: tuple[list, list, list] = ([], [], [])
    if not len(keys):
        return out
    first, last = runs_of(keys)
    some = member(repeated, keys[first])
    first, last = first[some], last[some]
    dense = member(crowded, keys[first])
    of = ((keys[first].view(np.uint64) * AGAIN) >> np.uint64(11)) % np.uint64(shards)
    for a, b, cut, shard in zip(first.tolist(), last.tolist(), dense.tolist(), of.tolist(), strict=True):
        for x, y in [(i, i + 1) for i in range(a, b)] if cut else [(a, b)]:
            held = b" ".join(words[x : y + window - 1])
            out[0].append(xxhash.xxh64_intdigest(held) % shards if cut else shard)
            out[1].append(x)
            out[2].append(held)
    return out


class Automaton:
    """A suffix automaton of word sequences. first: the id with which each state was first reached."""

    def __init__(self, window: int = WINDOW):
        self.window, self.number = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def numbers(self, words: list[bytes]) -> list[int]:
        number = self.number
        return [number.setdefault(w, len(number)) for w in words]

    def state(self, length: int, first: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def split(self, p: int, q: int, c: int) -> int:
        """A copy of q that stands for its strings of at most p's length and one."""
        copy = self.state(self.length[p] + 1, self.first[q], self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], doc_id: int) -> None:
        """Adds a passage; ids must not fall from call to call."""
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self.split(last, q, c)
                continue
            new, p = self.state(self.length[last] + 1, doc_id, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, q, c)
            last = new

    def match(self, words: list[int], doc_id: int) -> tuple[list[int], list[int]]:
        """Matching statistics up to a window: (windows that occur under a smaller id, windows that do not occur)."""
        after, link, length, first, window = self.next, self.link, self.length, self.first, self.window
        v = n = 0
        smaller, new = [], []
        for at, c in enumerate(words, 1 - window):
            q = after[v].get(c)
            while q is None and v:
                v = link[v]
                n = length[v]
                q = after[v].get(c)
            if q is not None:
                v, n = q, n + 1
                if n > window:
                    n = window
                    while length[link[v]] >= window:
                        v = link[v]
            if at < 0:
                continue
            if n < window:
                new.append(at)
            elif first[v] < doc_id:
                smaller.append(at)
        return smaller, new


def spans(starts: list[int], window: int) -> Iterator[tuple[int, int]]:
    """Maximal spans (first word, last word + 1) that windows with these starts cover."""
    a = b = None
    for s in starts:
        if b is not None and s > b:
            yield a, b
            a = None
        a, b = s if a is None else a, s + window
    if a is not None:
        yield a, b


def streamed(batches: Iterator[pd.DataFrame], window: int = WINDOW) -> Iterator[pd.DataFrame]:
    """Passages by (shard, task), references first, then by id. role 0: a reference, 1: streamed only, 2: streamed, then a reference."""
    key, automaton = None, Automaton(window)
    for b in batches:
        out = []
        for shard, task, role, doc_id, token, at, words in zip(b.shard.tolist(), b.task.tolist(), b.role.tolist(), b.doc_id.tolist(), b.token.tolist(), b["at"].tolist(), b.words, strict=True):
            if (shard, task) != key:
                key, automaton = (shard, task), Automaton(window)
            own = automaton.numbers(words.split())
            smaller, new = automaton.match(own, doc_id)
            if role and smaller:
                out += [(doc_id, token, at + x, at + y) for x, y in spans(smaller, window)]
            if role != 1 and new:
                automaton.add(own[new[0] : new[-1] + window], doc_id)
        yield pd.DataFrame(out, columns=["doc_id", "token", "first", "last"]).astype(np.int64)


def repeated_keys(ours: DataFrame, window: int = WINDOW, crowded: int = CROWDED) -> DataFrame:
    """(key, n, crowded): keys that occur under several ids of ours (doc_id, token, text), and in how many rows."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [np.unique(keys_of(utf8(t).split(), window)) for t in b.text]
            yield pd.DataFrame({"key": np.concatenate([np.zeros(0, np.int64), *found]), "doc_id": np.repeat(b.doc_id.to_numpy(np.int64), [len(k) for k in found])})

    ids = F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")
    several = ours.select("doc_id", "text").mapInPandas(told, "key long, doc_id long").groupBy("key").agg(*ids).filter("low < high")
    return written(several.select("key", "n", (F.col("n") > crowded).alias("crowded")), "keys")


def marked(ours: DataFrame, keys: DataFrame, n: int, shards: int, window: int = WINDOW, most_keys: int = MOST_KEYS) -> DataFrame:
    """PASSAGES of ours whose key is one of keys."""

    def cut(batches: Iterator[pd.DataFrame], of) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, (doc_id, token, text) in enumerate(zip(b.doc_id.tolist(), b.token.tolist(), b.text, strict=True)):
                found = passages(text, *of(b, i), shards, window)
                for held, more in zip(rows, (found[0], [doc_id] * len(found[0]), [token] * len(found[0]), found[1], found[2]), strict=True):
                    held += more
            yield pd.DataFrame(dict(zip(("shard", "doc_id", "token", "at", "words"), rows, strict=True)))

    if n <= most_keys:
        table = keys.select("key", "crowded").toArrow()  # not as Python's rows, which take a hundred times as much
        key, dense = table["key"].to_numpy(), table["crowded"].to_numpy()
        sent = ours.sparkSession.sparkContext.broadcast((np.sort(key), np.sort(key[dense])))
        return ours.mapInPandas(lambda batches: cut(batches, lambda b, i: sent.value), PASSAGES)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [np.unique(keys_of(utf8(t).split(), window)) for t in b.text]
            sizes = [len(k) for k in found]
            yield pd.DataFrame({"key": np.concatenate([np.zeros(0, np.int64), *found]), "doc_id": np.repeat(b.doc_id.to_numpy(np.int64), sizes), "token": np.repeat(b.token.to_numpy(np.int64), sizes)})

    # A document's own keys: no more than it has windows.
    held = ours.mapInPandas(told, "key long, doc_id long, token long").join(keys.select("key", "crowded"), "key")
    lists = held.groupBy("doc_id", "token").agg(F.sort_array(F.collect_set("key")).alias("keys"), F.sort_array(F.collect_set(F.when(F.col("crowded"), F.col("key")))).alias("dense"))
    array = lambda x: np.asarray(x, np.int64)
    return ours.join(lists, ["doc_id", "token"]).mapInPandas(lambda batches: cut(batches, lambda b, i: (array(b["keys"].iloc[i]), array(b.dense.iloc[i]))), PASSAGES)


def repeats(ours: DataFrame, window: int = WINDOW, crowded: int = CROWDED, most_rows: int = MOST_ROWS, most_keys: int = MOST_KEYS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, token, first, last): spans of words of ours (doc_id, token, text) to remove; they may overlap."""
    keys = repeated_keys(ours, window, crowded)
    facts = keys.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    shards = 1 + facts["rows"] * (window + GRAM) // shard_words
    found = written(marked(ours, keys, facts["keys"], shards, window, most_keys), "passages", compression="zstd")
    large = written(found.groupBy("shard").count().filter(F.col("count") > most_rows).select("shard", F.ceil(F.col("count") / most_rows).cast("int").alias("tasks")), "large")
    if large.isEmpty():
        dealt = found.withColumns({"task": F.lit(0), "role": F.lit(2)})
    else:
        own = found.join(large, "shard", "left")
        task = F.pmod(F.xxhash64("doc_id", "token", "at"), F.coalesce("tasks", F.lit(1))).cast("int")
        stream = own.withColumns({"task": task, "role": F.when(F.col("tasks").isNull(), 2).otherwise(1)}).drop("tasks")
        first = found.join(large.select("shard"), "shard", "left_semi").groupBy("shard", "words").agg(F.min("doc_id").alias("doc_id"))
        each = first.join(large, "shard").select("shard", "doc_id", F.lit(0).cast("long").alias("token"), F.lit(0).alias("at"), "words", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("role"))
        dealt = stream.unionByName(each)
    n = max(shuffle_partitions(ours.sparkSession), input_bytes(found) // TASK_BYTES)
    ordered = dealt.repartition(n, "shard", "task").sortWithinPartitions("shard", "task", "role", "doc_id")
    return ordered.mapInPandas(lambda batches: streamed(batches, window), "doc_id long, token long, first long, last long")


def with_kept(docs: DataFrame, window: int = WINDOW, **options: int) -> DataFrame:
    """docs (doc_id, text, more...) with n_words, n_removed and kept: the words that stay, joined by one blank."""
    token, spans_ = unused(docs, "__token"), unused(docs, "__spans")
    ours = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("token"), "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = repeats(ours, window, **options).groupBy("doc_id", "token").agg(F.collect_set(F.shiftleft(F.col("first"), 32) + F.col("last")).alias(spans_))
    found = written(found.select(F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), F.col("token").alias(token), spans_), "spans")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            out = []
            for text, own in zip(texts, spans, strict=True):
                words = utf8(text).split()
                gone = np.zeros(len(words), bool)
                for x in [] if own is None else own.tolist():
                    gone[x >> 32 : x & 0xFFFFFFFF] = True
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                out.append((len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    own = docs.drop("n_words", "n_removed", "kept").withColumn(token, F.xxhash64("text")).join(found, ["doc_id", token], "left")
    held = unused(docs, "__kept")
    whole = own.withColumn(held, kept.asNondeterministic()(F.col("text"), F.col(spans_)))
    return whole.select(*[c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept")], *[f"{held}.{c}" for c in ("n_words", "n_removed", "kept")])


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_kept(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
o AS MATERIALIZED (SELECT r, doc_id, o, array_to_string(w[o + 1 : o + {WINDOW}], ' ') AS x FROM (SELECT r, doc_id, w, unnest(range(0, len(w) - {WINDOW - 1})) AS o FROM d)),
m AS (SELECT x, min(doc_id) AS least FROM o GROUP BY x),
gone AS (SELECT DISTINCT r, unnest(range(o, o + {WINDOW})) AS i FROM o JOIN m ON o.x = m.x WHERE o.doc_id > m.least),
n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r),
k AS (SELECT a.r, string_agg(word, ' ' ORDER BY a.i) AS kept FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d) a LEFT JOIN gone g ON a.r = g.r AND a.i = g.i WHERE g.r IS NULL GROUP BY a.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN k ON d.r = k.r
"""
