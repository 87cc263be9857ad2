"""Language identification of mixed text: script ranges, scores of words, and a Viterbi path with a switching penalty.

Words are runs of letters (with the marks on them) of one script; digits, signs and blanks are between words, and so is a
change of script. Runs of a script that is written without blanks are cut into words of `PIECE` letters, so that a path can
change language within them. The script of a word (by ranges of code points) narrows the languages it can be in to those
whose learning texts use that script. Its score for each of them is the sum of log probabilities of its n-grams of letters
(1 to 4, blanks at its ends included), hashed into `BUCKETS`. A Viterbi path over the words of a text, with a penalty for
each change of language, labels spans; the language that holds most letters is that of the text.

Learning takes rows whose crc32(doc_id) mod 3 is not 1 and lang is not null: `per_lang` ids of each of the `most_langs` most
frequent languages (stated bounds; ids chosen by a hash), of rows with equal id and language one, counted by the executors.
Labelling covers every whole text.

Defined cases: `und` and score 0 for a text that is null or has no letter; likewise for all if nothing could be learnt; a
tie goes to the language that comes first by code point; a script that no learning text has narrows nothing; marks without
a letter are no words; `with_language` and `with_spans` keep further columns, and their own takes the place of one of the
same name; rows without an id are labelled, not learnt from.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fold, held_out, slices, unused

PER_LANG, MOST_LANGS, BITS, PENALTY, ORDERS, SEED = 1500, 256, 15, 12.0, (1, 2, 3, 4), 29
WORK_BYTES, SCORE_BYTES, FEW, PIECE = 4 << 20, 1 << 17, 4, 4
BUCKETS = 1 << BITS

#: Scripts, by the first word of their letters' Unicode names; `OTHER` is any further letter.
SCRIPTS = ["OTHER", "LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "GEORGIAN", "HEBREW", "ARABIC", "SYRIAC", "THAANA", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "THAI", "LAO", "TIBETAN", "MYANMAR", "KHMER", "ETHIOPIC", "MONGOLIAN", "HANGUL", "HIRAGANA", "KATAKANA", "CJK"]
#: Of these, those that are written without blanks between words.
UNSPACED = ["THAI", "LAO", "TIBETAN", "MYANMAR", "KHMER", "HIRAGANA", "KATAKANA", "CJK"]
#: Kinds of code points: no letter, a mark (of the script of what it stands on), a letter that any script uses; then scripts.
GAP, MARK, SHARED, FIRST = 0, 1, 2, 3


#: What `kinds` has worked out: a plain dictionary, since functions travel by value with the globals that they read.
KNOWN: dict[str, np.ndarray] = {}


def kinds() -> np.ndarray:
    """The kind of every code point: ranges of the scripts, from the names of letters."""
    if "kinds" in KNOWN:
        return KNOWN["kinds"]
    out = KNOWN["kinds"] = np.zeros(sys.maxunicode + 1, np.uint8)
    number = {name: i + FIRST for i, name in enumerate(SCRIPTS)}
    for c in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(c))
        if category[0] == "M":
            out[c] = MARK
        elif category[0] == "L":
            name = unicodedata.name(chr(c), "OTHER").replace("FULLWIDTH ", "").replace("HALFWIDTH ", "").split()
            # Modifiers and the long vowel sign go with the letters before them.
            out[c] = SHARED if category == "Lm" else number.get(name[0], number["OTHER"])
    return out


class Words:
    """Words of several texts as one buffer of code points; all arrays are over words."""

    def __init__(self, texts: list[str | None]):
        raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) if isinstance(t, str) else np.zeros(0, np.uint32) for t in texts]
        gap = np.full(4, 32, np.uint32)
        points = np.concatenate([gap, *(x for r in raw for x in (r, gap))])
        kind = kinds()[points]
        at = np.arange(len(kind))
        kind = kind[np.maximum.accumulate(np.where((kind != MARK) & (kind != SHARED), at, 0))] if (kind <= SHARED).any() else kind
        kind = np.where(kinds()[points] == SHARED, np.where(kind == GAP, FIRST, kind), kind)
        inside = kind > GAP
        # Where a word ends and another begins with nothing between: a change of script, or a piece of a run without blanks.
        change = np.concatenate([[True], kind[1:] != kind[:-1]])
        into = at - np.maximum.accumulate(np.where(change, at, 0))
        unspaced = np.isin(kind, [SCRIPTS.index(x) + FIRST for x in UNSPACED])
        cut = np.flatnonzero(inside & np.concatenate([[False], inside[:-1]]) & (change | (unspaced & (into % PIECE == 0))))
        points = np.where(inside, points, np.uint32(32))
        self.bytes = np.insert(points, cut, np.uint32(32)) if len(cut) else points
        self.inside = self.bytes != 32
        edges = np.flatnonzero(self.inside[1:] != self.inside[:-1]) + 1
        self.start, self.end = edges[::2], edges[1::2]
        self.length = self.end - self.start
        # Where words lie in the texts themselves, and which words are a text's.
        self.place = self.start - np.searchsorted(cut + np.arange(len(cut)), self.start, side="left") if len(cut) else self.start
        self.script = kind[self.place].astype(np.int8) - FIRST
        self.bounds = np.cumsum([4, *(len(r) + 4 for r in raw)])
        self.first = np.searchsorted(self.place, self.bounds)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, buckets) for each order: n-grams that hold at most one blank at each end."""
        b = self.bytes.astype(np.uint32)
        ok1 = self.inside
        h = np.zeros(len(b), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(1)
            if n not in ORDERS:
                continue
            if n == 1:
                at = np.flatnonzero(ok1)
            else:
                # first or last byte may be a blank; all between are letters; at least one is a letter
                run = np.cumsum(np.concatenate([[False], ~ok1]), dtype=np.int32)
                mid = run[n - 1 : len(b) - 0] - run[1 : len(b) - n + 2]
                blanks = run[n:] - run[: len(b) - n + 1]
                at = np.flatnonzero((mid[: len(blanks)] == 0) & (blanks < n) & (blanks <= (2 if n > 2 else 1)))
            mixed = (h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield at, ((mixed >> np.uint32(32 - BITS)) ^ np.uint32(n * 7919)) & np.uint32(BUCKETS - 1)

    def word_of(self, at: np.ndarray) -> np.ndarray:
        """The word that an n-gram at these places belongs to (one that starts at the blank before a word is that word's)."""
        return np.searchsorted(self.end, at, side="right")


def count(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of buckets, and of letters by script."""
    w = Words(texts)
    out = np.zeros(BUCKETS, np.int64)
    for _, bucket in w.grams():
        out += np.bincount(bucket, minlength=BUCKETS)
    return out, np.bincount(w.script, weights=w.length, minlength=len(SCRIPTS)).astype(np.int64)


def word_scores(w: Words, table: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Words by languages. table: BUCKETS by languages; allowed: scripts by languages."""
    out = np.zeros((len(w.start), table.shape[1]), np.float32)
    if not len(w.start):
        return out
    # Each letter's word, for letters from the blank before a word on.
    owner = np.repeat(np.arange(len(w.end), dtype=np.int32), np.diff(np.concatenate([[0], w.end])))
    for at, bucket in w.grams():
        at_ok = at < len(owner)
        of = owner[at[at_ok]]
        if not len(of):
            continue
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out[of[cut]] += np.add.reduceat(table[bucket[at_ok]], cut, axis=0)
    return out + np.where(allowed[w.script], np.float32(0), np.float32(-1e4))


def tail(v: list[float], scores: list[list[float]], penalty: float) -> tuple[list[int], int]:
    """The rest of one text's path: the state of each of its words, and the state before them."""
    past = []
    for row in scores:
        top = max(v)
        jump = top - penalty
        past.append((v.index(top), [x >= jump for x in v]))
        v = [(x if x >= jump else jump) + y for x, y in zip(v, row, strict=True)]
    state = v.index(max(v))
    out = []
    for best, stays in reversed(past):
        out.append(state)
        if not stays[state]:
            state = best
    return out[::-1], state


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word. first: where each text's words begin, and the end.

    Texts go side by side, longest first, a word of each at a time; the last few and longest are finished one by one.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    label = np.zeros(len(scores), np.int16)
    longest = int(size[0]) if len(size) else 0
    if not longest:
        return label
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # texts with more than t words
    few = int(max(1, np.searchsorted(-active, -FEW, side="left")))  # from this word on at most FEW texts are left
    best_of, stay = np.zeros(len(scores), np.int16), np.ones(scores.shape, bool)
    v, now = scores[start[: active[0]]].copy(), np.zeros(len(size), np.int64)
    cost = np.float32(penalty)
    for t in range(1, min(few, longest)):
        a = active[t]
        if a < len(v):
            now[a : len(v)] = v[a:].argmax(1)
            v = v[:a]
        at = start[:a] + t
        arg = v.argmax(1)
        jump = v[np.arange(a), arg][:, None] - cost
        stay[at] = v >= jump
        best_of[at] = arg
        v = np.maximum(v, jump) + scores[at]
    now[: len(v)] = v.argmax(1)
    if few < longest:
        for d in range(active[few]):
            some = slice(start[d] + few, start[d] + size[d])
            label[some], now[d] = tail(v[d].tolist(), scores[some].tolist(), float(penalty))
    for t in range(min(few, longest) - 1, -1, -1):
        a = active[t]
        at = start[:a] + t
        label[at] = now[:a]
        if t:
            now[:a] = np.where(stay[at, now[:a]], now[:a], best_of[at])
    return label


def label_texts(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """Scores are made for some hundred thousand letters at a time, and the paths of all texts then side by side."""
    langs, scores, lengths, sizes = model["langs"], [], [], []
    for part in in_parts(texts, SCORE_BYTES):
        w = Words(part)
        scores.append(word_scores(w, model["table"], model["allowed"]))
        lengths.append(w.length.astype(np.int32))
        sizes.append(np.diff(w.first))
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    label = viterbi(np.concatenate(scores), first)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    held = np.bincount(text_of * len(langs) + label, weights=np.concatenate(lengths), minlength=len(texts) * len(langs)).reshape(len(texts), len(langs))
    total = held.sum(1)
    top = held.argmax(1)
    return [langs[top[i]] if total[i] else "und" for i in range(len(texts))], [float(held[i, top[i]] / total[i]) if total[i] else 0.0 for i in range(len(texts))]


def spans(text: str | None, model: dict) -> list[tuple[int, int, str]]:
    """(first word, last word, language) of each span of a text."""
    if not model["langs"]:
        return []
    w = Words([text])
    label = viterbi(word_scores(w, model["table"], model["allowed"]), w.first)
    cut = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1), len(label)]
    return [(int(a), int(b) - 1, model["langs"][label[a]]) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def in_parts(texts: Iterable, most: int = WORK_BYTES) -> Iterator[list]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) if isinstance(t, str) else 0
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def with_spans(docs: DataFrame, model: dict, name: str = "spans") -> DataFrame:
    """docs with one more column: the text's spans as (start, stop, lang), in code points of its lower-cased form."""

    @F.pandas_udf("array<struct<start: long, stop: long, lang: string>>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([char_spans(t, model) for t in texts], dtype=object)

    return docs.drop(name).withColumn(name, label.asNondeterministic()(F.col("text")))


def char_spans(text: str | None, model: dict) -> list[dict]:
    if not model["langs"]:
        return []
    w = Words([text])
    label = viterbi(word_scores(w, model["table"], model["allowed"]), w.first)
    cut = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1), len(label)]
    return [{"start": int(w.place[a]) - 4, "stop": int(w.place[b - 1] + w.length[b - 1]) - 4, "lang": model["langs"][label[a]]} for a, b in zip(cut, cut[1:], strict=False) if b > a]


def learn(docs: DataFrame, per_lang: int = PER_LANG, alpha: float = 0.5, least_share: float = 0.01, most_langs: int = MOST_LANGS) -> dict:
    """The model from docs (doc_id, text, lang). A row of counts for each of at most most_langs languages goes to the driver."""
    kinds()  # once here, not in every task
    ours = docs.select("doc_id", "text", "lang").filter((fold() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = ours.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"), F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "lang").limit(most_langs).collect()
    if not sizes:
        return {"langs": [], "table": np.zeros((BUCKETS, 0), np.float32), "allowed": np.zeros((len(SCRIPTS), 0), bool)}
    # Thin each language to about twice its bound by a hash of the id first, so that no large group is ranked.
    # From Arrow: rows of Python objects would take Python workers of their own on each executor, which stay.
    share = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array([r.lang for r in sizes], pa.string()), "share": [min(2.0, 2.0 * per_lang / max(r.n, 1)) for r in sizes]}))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    thin = ours.select("doc_id", "lang").join(F.broadcast(share), "lang").filter(hashed < F.col("share")).select("doc_id", "lang").distinct()
    # A bound of per_lang ids for each of at most most_langs languages; rows that repeat an id and language count once.
    chosen = thin.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id"))).filter(F.col("r") <= per_lang)
    picked = ours.join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                for part in in_parts(list(group.text), SCORE_BYTES):
                    got = np.concatenate(count(part))
                    sums[lang] = sums[lang] + got if lang in sums else got
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pd.DataFrame({"lang": lang, "i": at, "n": got[at]})

    got = picked.select("lang", "text").mapInPandas(counts, "lang string, i long, n long").groupBy("lang", "i").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted((r.lang for r in sizes), key=lambda x: x.encode("utf-8", "surrogatepass"))
    c = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    c[pd.Categorical(got.lang, categories=langs).codes, got.i.to_numpy(int)] = got.n
    grams, scripts = c[:, :BUCKETS].T + alpha, c[:, BUCKETS:].T
    table = np.log(grams / grams.sum(0))
    table -= table.mean(1, keepdims=True)
    allowed = scripts >= least_share * np.maximum(scripts.sum(0), 1)
    allowed |= ~allowed.any(1, keepdims=True)  # a script that no language uses excludes none
    return {"langs": langs, "table": table.astype(np.float32), "allowed": allowed}


def labeller(model: dict):
    """An Arrow UDF: text to (lang, score). Marked as not deterministic only so that Spark runs it once for each row."""

    @F.arrow_udf("lang string, score double")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in in_parts(t for some in slices(texts) for t in some):
                langs, scores = label_texts(part, model) if model["langs"] else (["und"] * len(part), [0.0] * len(part))
                yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return label.asNondeterministic()


def with_language(docs: DataFrame, model: dict, name: str = "language") -> DataFrame:
    """docs with one more column, (lang, score)."""
    return docs.drop(name).withColumn(name, labeller(model)(F.col("text")))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs)
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language that could be told: not `und`, and one language holds at least a third of the letters."""
    model = learn(docs)
    own = unused(docs, "__language")
    out = with_language(docs, model, own)
    return out.filter((F.col(own)["lang"] != "und") & (F.col(own)["score"] * 3 >= 1)).drop(own)
