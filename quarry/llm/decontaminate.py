"""Benchmark decontamination by suffix arrays over shards of the training text.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A shard is a few MB of whole documents as
one array of word numbers, 0 between documents; its suffix array holds every suffix, sorted by its first 13 words at least
(numbers of runs of words are doubled, as in prefix doubling). It is made once and serves all blocks of the benchmark.

Every test suffix that can hold a window is looked up by binary search, word by word: the range of training suffixes that
start with its window gives all verbatim occurrences and their places. Windows are 13 consecutive words of an item; an item
of fewer words is one window. From each place where a window starts, the longest verbatim match with any test suffix is
found among its two neighbours in the joint order of these places and the test suffixes of the items that occur. A document
is contaminated if at least a twentieth of its words lie in occurrences of windows. `longest_matches` tells for every test
suffix, however short, its longest match over all shards.

The items are the stated query set: they go to the executors in blocks of at most `BLOCK_BYTES` of text each, and a worker
holds one block at a time. Their size is summed first; of a benchmark over `MOST_BYTES` as much is sent at once, and what
was found is written before the next part is sent. Documents never meet: there is no shuffle. Windows and items with equal
words are one, and which items a set of windows stands for is worked out once, so occurrences never multiply with items.

Defined cases: a null or empty text has no words and is clean; an item without words has no window; items with equal texts
count each; an item without an id is matched but not listed; `with_hits` keeps further columns, and its own takes the place
of one of the same name; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, unused, utf8, written

WINDOW, LEAST, BLOCK_BYTES, MOST_BYTES, SHARD_BYTES = 13, 3, 16 << 20, 512 << 20, 4 << 20
#: How many sets of windows a worker remembers the items of.
KNOWN = 50_000


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(WORD_BYTES).split()


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of each key's value from 1 on)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(keys)])
    return order, number


def shifted(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    if n < len(x):
        out[: len(x) - n] = x[n:]
    return out


def ragged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all indices low[row] .. high[row] - 1."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Items:
    """A block of the benchmark: its vocabulary, distinct texts, and distinct windows with the texts that hold each."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window = window
        number: dict[bytes, int] = {}
        texts: dict[tuple, list] = {}
        for item_id, text in items:
            words = tuple(number.setdefault(w, len(number)) for w in words_of(text))
            if words:
                texts.setdefault(words, []).append(item_id)
        self.vocabulary = list(number)
        self.texts = [np.array(x, np.int64) for x in texts]
        self.ids = [sorted({str(i) for i in x if i is not None}) for x in texts.values()]
        windows: dict[tuple, list[int]] = {}
        for t, words in enumerate(texts):
            for at in range(max(1, len(words) - window + 1)):
                held = windows.setdefault(words[at : at + window], [])
                if not held or held[-1] != t:
                    held.append(t)
        self.length = np.array([len(w) for w in windows], np.int64)
        self.windows = np.full((len(windows), window), -1, np.int64)
        for i, w in enumerate(windows):
            self.windows[i, : len(w)] = w
        self.texts_of = [np.array(x, np.int64) for x in windows.values()]
        self.known: dict[bytes, tuple] = {}

    def found(self, windows: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(sorted ids, texts) of the items that hold any of the windows (sorted); remembered, as texts repeat."""
        key = windows.tobytes()
        if key not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            texts = np.unique(np.concatenate([self.texts_of[w] for w in windows]))
            self.known[key] = (sorted({i for t in texts for i in self.ids[t]}), texts)
        return self.known[key]


class Shard:
    """Documents as one array of word numbers from 1 on, 0 between and after them, and its suffix array."""

    def __init__(self, texts: list[str | None], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        add, rows = self.number.setdefault, []
        for t in texts:
            rows.append([add(w, len(self.number) + 1) for w in words_of(t)])
        self.size = np.array([len(r) for r in rows], np.int64)
        self.first = np.cumsum(self.size + 1) - self.size - 1
        self.words = np.zeros(int((self.size + 1).sum()) + 1, np.int64)
        for at, r in zip(self.first.tolist(), rows, strict=True):
            self.words[at : at + len(r)] = r
        # As many words as fit go into one number at once, then runs are doubled until they hold a window.
        bits = max(1, int(len(self.number)).bit_length())
        span = min(max(1, 62 // bits), window)
        keys = self.words.copy()
        for i in range(1, span):
            keys = (keys << bits) | shifted(self.words, i)
        while True:
            self.suffix, rank = numbered(keys)
            if span >= window or not len(rank) or rank.max() == len(rank):
                break
            keys = rank * (len(rank) + 1) + shifted(rank, span)
            span *= 2

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def own(self, items: Items) -> np.ndarray:
        """This shard's number of each word of the items, -1 for a word that it does not have; the last is for no word."""
        return np.array([*(self.number.get(w, -1) for w in items.vocabulary), 0], np.int64)

    def narrowed(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ranges of suffixes that share `depth` words: the parts whose next word is `word`, by binary search."""
        out = []
        last = len(self.words) - 1
        for after in (0, 1):
            a, b = low.copy(), high.copy()
            while (open_ := np.flatnonzero(a < b)).size:
                mid = (a[open_] + b[open_]) >> 1
                less = self.words[np.minimum(self.suffix[mid] + depth, last)] < word[open_] + after
                a[open_[less]] = mid[less] + 1
                b[open_[~less]] = mid[~less]
            out.append(a)
        return out[0], out[1]

    def ranges(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each row's first `length` words."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.suffix), np.int64)
        for depth in range(rows.shape[1] if len(rows) else 0):
            some = np.flatnonzero((depth < length) & (low < high))
            low[some], high[some] = self.narrowed(low[some], high[some], depth, rows[some, depth])
        return low, high

    def occurrences(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every verbatim occurrence."""
        rows = self.own(items)[items.windows]
        some = np.flatnonzero((rows >= 0).all(1))
        low, high = self.ranges(rows[some], items.length[some])
        row, index = ragged(low, high)
        return some[row], self.suffix[index]

    def hits(self, items: Items) -> tuple[np.ndarray, list[tuple], np.ndarray, np.ndarray]:
        """Whether each word is hit; (document, item ids) of those hit; (place, words) of the longest matches."""
        window, at = self.occurrences(items)
        n = len(self.words) + 1
        step = np.bincount(at, minlength=n) - np.bincount(at + items.length[window], minlength=n)[:n]
        pairs = np.unique(self.document(at) * np.int64(len(items.length) + 1) + window)
        doc, of = pairs // (len(items.length) + 1), pairs % (len(items.length) + 1)
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else [0]
        found, texts = [], [np.zeros(0, np.int64)]
        for a, b in zip(cut, cut[1:], strict=False):
            ids, held = items.found(of[a:b])
            found.append((int(doc[a]), ids))
            texts.append(held)
        hit = np.cumsum(step)[: len(self.words)] > 0
        full = items.length[window] == items.window
        start, words = self.extended(np.unique(at[full]), hit, items, np.unique(np.concatenate(texts)))
        return hit, found, np.concatenate([start, at[~full]]), np.concatenate([words, items.length[window[~full]]])

    def extended(self, start: np.ndarray, hit: np.ndarray, items: Items, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places where a whole window starts: how many words match on from there in any of the items' texts."""
        if not len(start):
            return start, start
        # One array: the hit runs of the documents, then the texts, each with a number of its own after it.
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        row, index = ragged(edges[::2], edges[1::2])
        own = self.own(items)
        parts = [own[items.texts[t]] for t in texts]
        size = np.array([*(edges[1::2] - edges[::2]), *(len(p) for p in parts)], np.int64)
        first = np.cumsum(size + 1) - size - 1
        joint = np.empty(int((size + 1).sum()), np.int64)
        joint[first + size] = len(self.number) + 2 + np.arange(len(size))
        runs = len(edges) // 2
        joint[first[row] + index - edges[::2][row]] = self.words[index]
        for at, p in zip(first[runs:].tolist(), parts, strict=True):
            joint[at : at + len(p)] = np.where(p < 0, len(self.number) + 1, p)
        ranks, span = [numbered(joint)[1]], 1
        while span < size.max():
            ranks.append(numbered(ranks[-1] * (len(joint) + 1) + shifted(ranks[-1], span))[1])
            span *= 2
        order = np.argsort(ranks[-1], kind="stable")
        test = np.zeros(len(joint), bool)
        test[first[runs] :] = True
        test[first + size] = False
        place = np.arange(len(joint))
        marked = test[order]
        before = np.maximum.accumulate(np.where(marked, place, -1))
        after = np.minimum.accumulate(np.where(marked, place, len(joint))[::-1])[::-1]
        where = np.empty(len(joint), np.int64)
        where[order] = place
        run = np.searchsorted(edges[::2], start, side="right") - 1
        mine = first[run] + start - edges[::2][run]
        best = np.zeros(len(start), np.int64)
        for near in (before, after):
            other = near[where[mine]]
            ok = (other >= 0) & (other < len(joint))
            x, y, n = mine[ok], order[other[ok]], np.zeros(int(ok.sum()), np.int64)
            for level in range(len(ranks) - 1, -1, -1):
                rank = ranks[level]
                inside = (x < len(joint)) & (y < len(joint))
                same = inside & (rank[np.minimum(x, len(joint) - 1)] == rank[np.minimum(y, len(joint) - 1)])
                x, y, n = x + (same << level), y + (same << level), n + (same << level)
            best[ok] = np.maximum(best[ok], n)
        return start, best

    def longest(self, items: Items, least: int = LEAST) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, offset, words, document, first word) of the longest verbatim match of each test suffix, if `least` words long."""
        own = self.own(items)
        for t, words in enumerate(items.texts):
            text = own[words]
            for at in range(len(text) - least + 1):
                low, high, n = 0, len(self.suffix), 0
                while at + n < len(text) and n < items.window and text[at + n] >= 0:
                    a, b = (int(x[0]) for x in self.narrowed(np.array([low]), np.array([high]), n, text[at + n : at + n + 1]))
                    if a >= b:
                        break
                    low, high, n = a, b, n + 1
                if n < least:
                    continue
                alive = np.sort(self.suffix[low:high])
                while n >= items.window and at + n < len(text):
                    more = alive[self.words[np.minimum(alive + n, len(self.words) - 1)] == text[at + n]]
                    if not len(more):
                        break
                    alive, n = more, n + 1
                d = int(self.document(alive[:1])[0])
                yield t, at, n, d, int(alive[0] - self.first[d])


class Blocks:
    """A part of the benchmark in blocks; a worker has one of them prepared at a time."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most_bytes: int = MOST_BYTES, rows: Iterator | None = None):
        self.window, self.parts = window, []
        send, held, size, sent = benchmark.sparkSession.sparkContext.broadcast, [], 0, 0
        for r in benchmark.select("item_id", "text").toLocalIterator() if rows is None else rows:
            held.append((r.item_id, r.text))
            size += len(r.text or "") + 64
            if size >= block_bytes:
                self.parts.append(send(held))
                sent += size
                held, size = [], 0
                if sent >= most_bytes:
                    break
        if held:
            self.parts.append(send(held))
        self.ready: tuple = (None, None)

    def __getstate__(self) -> dict:
        return {"window": self.window, "parts": self.parts, "ready": (None, None)}

    def each(self) -> Iterator[Items]:
        for k, part in enumerate(self.parts):
            if self.ready[0] != k:
                self.ready = (k, Items(part.value, self.window))
            yield self.ready[1]


def benchmark_parts(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most_bytes: int = MOST_BYTES) -> Iterator[Blocks]:
    """The benchmark, as many blocks at a time as may be sent at once."""
    rows = benchmark.select("item_id", "text").toLocalIterator()
    while True:
        blocks = Blocks(benchmark, window, block_bytes, most_bytes, rows)
        if not blocks.parts:
            return
        yield blocks


def shards(texts: list, most: int = SHARD_BYTES) -> Iterator[list]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) if isinstance(t, str) else 0
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def judged(texts: list[str | None], blocks: Blocks) -> list[tuple]:
    """(n_words, hit runs, item ids, longest, longest_first) of each text."""
    shard = Shard(texts, blocks.window)
    hit, found, start, words = np.zeros(len(shard.words), bool), {}, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for items in blocks.each():
        h, f, at, n = shard.hits(items)
        hit |= h
        for d, ids in f:
            found.setdefault(d, []).append(ids)
        start.append(at)
        words.append(n)
    at, n = np.concatenate(start), np.concatenate(words)
    longest: dict[int, tuple[int, int]] = {}
    for d, x, k in zip(shard.document(at).tolist(), at.tolist(), n.tolist(), strict=True):
        longest[d] = max(longest.get(d, (0, 0)), (k, -(x - int(shard.first[d]))))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    of = shard.document(edges[::2]) if len(edges) else edges
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for d, size in enumerate(shard.size.tolist()):
        runs = (edges[2 * cut[d] : 2 * cut[d + 1]] - shard.first[d]).tolist()
        ids = found.get(d, [])
        k, x = longest.get(d, (0, None))
        out.append((size, runs, ids[0] if len(ids) == 1 else sorted(set().union(*ids)), k, None if x is None else -x))
    return out


FOUND = "n_words long, runs array<long>, items array<string>, longest long, longest_first long"
HITS = "n_words long, n_hit long, n_items long, items_sha256 string, longest long, longest_first long"


def named(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def summed(rows: list[tuple]) -> tuple:
    """HITS from what the benchmark's parts found in one text."""
    step: dict[int, int] = {}
    for r in rows:
        for i, x in enumerate(r[1]):
            step[int(x)] = step.get(int(x), 0) + (1 if i % 2 == 0 else -1)
    n_hit = held = since = 0
    for x in sorted(step):
        n_hit += x - since if held else 0
        held, since = held + step[x], x
    ids = list(rows[0][2]) if len(rows) == 1 else sorted({i for r in rows for i in r[2]})
    k, at = max(((r[3], -r[4]) for r in rows if r[3]), default=(0, None))
    return rows[0][0], n_hit, len(ids), digest(ids), k, None if at is None else -at


def finder(blocks: Blocks):
    """A Pandas UDF: text to what a part of the benchmark finds in it (FOUND)."""

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([x for part in shards(list(texts)) for x in judged(part, blocks)], columns=named(FOUND))
            yield out.astype({"longest_first": "Int64"})

    return found.asNondeterministic()


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str = "hits", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs with one more column (HITS): how much of its text the benchmark's windows cover, the longest match and where it starts."""
    docs = docs.drop(name)
    # What a benchmark within the bound needs is one pass; else what each part found is kept in a column until the last.
    one = (benchmark.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) <= most_bytes
    parts = list(benchmark_parts(benchmark, window, block_bytes, most_bytes)) if one else benchmark_parts(benchmark, window, block_bytes, most_bytes)
    kept: list[str] = []
    for k, blocks in enumerate(parts if not one else []):
        kept.append(unused(docs, f"__found{k}"))
        docs = written(docs.withColumn(kept[-1], finder(blocks)(F.col("text"))), "found")
        for p in blocks.parts:
            p.destroy()
    if one:
        blocks = parts[0] if parts else Blocks(benchmark, window, rows=iter(()))

        @F.pandas_udf(HITS)
        def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                out = pd.DataFrame([summed([x]) for part in shards(list(texts)) for x in judged(part, blocks)], columns=named(HITS))
                yield out.astype({"longest_first": "Int64"})

        return docs.withColumn(name, hits.asNondeterministic()(F.col("text")))

    @F.pandas_udf(HITS)
    def joined(batches: Iterator[tuple[pd.DataFrame, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = zip(*[c.astype({"longest_first": "Int64"}).itertuples(index=False, name=None) for c in columns], strict=True)
            out = pd.DataFrame([summed([(r[0], r[1], r[2], r[3], None if pd.isna(r[4]) else int(r[4])) for r in some]) for some in rows], columns=named(HITS))
            yield out.astype({"longest_first": "Int64"})

    return docs.withColumn(name, joined.asNondeterministic()(*kept)).drop(*kept)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, offset, n_words, doc_id, first_word): of each test suffix the longest verbatim match over all shards; ties to the smallest place.

    Meant for a benchmark of up to MOST_BYTES; for a larger one, call it for parts of it. Items with equal texts have a row each.
    """
    blocks = Blocks(benchmark, window, most_bytes=1 << 62)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = list(batch.doc_id)
            at = 0
            for part in shards(list(batch.text)):
                shard = Shard(part, window)
                for items in blocks.each():
                    rows = [(i, off, n, ids[at + d], w) for t, off, n, d, w in shard.longest(items) for i in items.ids[t]]
                    if rows:
                        yield pd.DataFrame(rows, columns=["item_id", "offset", "n_words", "doc_id", "first_word"])
                at += len(part)

    got = docs.select("doc_id", "text").mapInPandas(find, "item_id string, offset long, n_words long, doc_id long, first_word long")
    best = got.groupBy("item_id", "offset").agg(F.max(F.struct("n_words", (-F.col("doc_id")).alias("d"), (-F.col("first_word")).alias("w"))).alias("x"))
    item = F.col("item_id").cast(dict(benchmark.dtypes)["item_id"]).alias("item_id")
    return best.select(item, "offset", F.col("x.n_words").alias("n_words"), (-F.col("x.d")).alias("doc_id"), (-F.col("x.w")).alias("first_word"))


def contaminated(hits: str) -> Column:
    return (F.col(f"{hits}.n_hit") > 0) & (20 * F.col(f"{hits}.n_hit") >= F.col(f"{hits}.n_words"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = named(HITS)
    return out.select("doc_id", *[f"hits.{c}" for c in names[:4]], contaminated("hits").alias("contaminated"), *[f"hits.{c}" for c in names[4:]])


WORDS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
i AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, {WORDS_SQL} AS w FROM benchmark),
iw AS (SELECT i, item_id, o, least({WINDOW}, len(w)) AS n, array_to_string(w[o + 1 : o + least({WINDOW}, len(w))], ' ') AS x FROM (SELECT i, item_id, w, unnest(range(0, greatest(1, len(w) - {WINDOW - 1}))) AS o FROM i WHERE len(w) > 0)),
dw AS (SELECT r, p, n, array_to_string(w[p + 1 : p + n], ' ') AS x FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
occ AS (SELECT DISTINCT r, p, dw.n, i, item_id, o FROM dw JOIN iw ON dw.n = iw.n AND dw.x = iw.x),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS place FROM (SELECT DISTINCT r, p, n FROM occ)) GROUP BY r),
held AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY r),
runs AS (SELECT r, min(p) AS p, CASE WHEN n = {WINDOW} THEN count(*) + {WINDOW - 1} ELSE n END AS k FROM (SELECT *, p - row_number() OVER (PARTITION BY r, i, n, p - o ORDER BY p) AS run FROM occ) GROUP BY r, i, n, p - o, run),
best AS (SELECT r, max(k) AS longest, arg_min(p, k * -1000000000000 + p) AS longest_first FROM runs GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(longest_first AS BIGINT) AS longest_first
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN held ON d.r = held.r LEFT JOIN best ON d.r = best.r
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated."""
    own = unused(docs, "__hits")
    out = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), own)
    return out.filter(~contaminated(own)).drop(own)
