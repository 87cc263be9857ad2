"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has bit i set if more than half of the hashes of its three-word shingles have it. Bits 0-22 and 23-45
are two words of 23 bits; the anchors are all pairs of codewords of the perfect binary Golay code, whose covering radius is
3. A fingerprint's home is the anchor of its nearest codewords. Two fingerprints that differ in at most `threshold` bits lie
within 3 + e1 and 3 + e2 of the two codewords of each other's homes, where e1 + e2 <= threshold; so replicating every
fingerprint to all such anchors, and comparing those at home at an anchor with all that were sent there, finds every link.

Scale: exact copies are one fingerprint before anything is replicated. Anchors at which nothing is at home are left out
by a bitmap of the 2 ** 24 anchors (2 MB, whatever the input). At an anchor with more than `MOST_AT_HOME` at home these are
dealt out to several tasks, and each receives all visitors. Within a task, links are told as a star for each linked group
there, so what leaves it is linear in what came in. Components come from alternating large-star and small-star rounds on
written tables; nothing about all documents goes to the driver.

Defined cases: a null text is empty; a text without words has fingerprint zero and is linked like any other; fewer than
three words are one shingle; rows with equal ids are rows of their own that share the smallest id among those they reach;
a null id is in a component but never its id unless no other is there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, input_bytes, shuffle_partitions, utf8, written

WORDS, SEED, THRESHOLD, MOST_AT_HOME = 3, 42, 2, 4096
#: For the number of tasks: rows sent for each fingerprint, at most about; bytes of them that a task should get.
SPREAD, TASK_BYTES = 256, 512 << 20
#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR, BITS, RADIUS = 0xAE3, 23, 3


# fingerprints


def fingerprint(text: str | None, words: int = WORDS) -> int:
    w = utf8(text).translate(LOWER_BYTES).split()
    if not w:
        return 0
    joined = b" ".join(w)
    k = min(words, len(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def fingerprinter(words: int = WORDS):
    """A Pandas UDF: text to fingerprint, as a signed long. Marked as not deterministic only so that Spark runs it once."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return prints.asNondeterministic()


# anchors


class Golay:
    """Nearest codewords of 23-bit words, and all codewords within 3 + t bits."""

    def __init__(self, threshold: int):
        one = [1 << i for i in range(BITS)]
        for i, x in enumerate(one):
            for bit in range(BITS - 1, 10, -1):
                if x >> bit & 1:
                    x ^= GENERATOR << (bit - 11)
            one[i] = x
        low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
        for i in range(BITS):
            part, at = (low, i) if i < 12 else (high, i - 12)
            part[np.arange(len(part)) >> at & 1 == 1] ^= one[i]
        self.low, self.high = low, high
        patterns = np.array([0] + [1 << i for i in range(BITS)] + [1 << i | 1 << j for i in range(BITS) for j in range(i)] + [1 << i | 1 << j | 1 << k for i in range(BITS) for j in range(i) for k in range(j)])
        self.error = np.zeros(1 << 11, np.int64)
        self.error[self.syndrome(patterns)] = patterns
        words = np.arange(1 << 12) << 11
        codewords = words ^ self.syndrome(words)
        # For each syndrome: the codewords, as differences from the nearest, within RADIUS + t of the word, and each one's excess t.
        codewords = codewords[np.bitwise_count(codewords) <= 2 * RADIUS + threshold]
        off = np.maximum(np.bitwise_count(self.error[:, None] ^ codewords[None, :]).astype(np.int64) - RADIUS, 0)
        row, col = np.nonzero(off <= threshold)
        self.first = np.searchsorted(row, np.arange((1 << 11) + 1))
        self.near, self.excess = codewords[col], off[row, col]

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.low[x & 0xFFF] ^ self.high[x >> 12]

    @staticmethod
    def message(codeword: np.ndarray) -> np.ndarray:
        return codeword >> 11


def ragged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all indices first[row] .. last[row] - 1."""
    n = last - first
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


class Anchors:
    def __init__(self, threshold: int = THRESHOLD):
        self.threshold, self.golay = threshold, Golay(threshold)

    def parts(self, fp: np.ndarray) -> list[np.ndarray]:
        u = fp.view(np.uint64)
        return [(u >> np.uint64(s) & np.uint64((1 << BITS) - 1)).astype(np.int64) for s in (0, BITS)]

    def home(self, fp: np.ndarray) -> np.ndarray:
        g = self.golay
        a, b = (g.message(x ^ g.error[g.syndrome(x)]) for x in self.parts(fp))
        return a << 12 | b

    def all(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, whether it is the home) of every anchor that each fingerprint goes to."""
        g = self.golay
        x1, x2 = self.parts(fp)
        s1, s2 = g.syndrome(x1), g.syndrome(x2)
        c1, c2 = x1 ^ g.error[s1], x2 ^ g.error[s2]
        row, i = ragged(g.first[s1], g.first[s1 + 1])
        sub, j = ragged(g.first[s2[row]], g.first[s2[row] + 1])
        row, i = row[sub], i[sub]
        ok = g.excess[i] + g.excess[j] <= self.threshold
        row, i, j = row[ok], i[ok], j[ok]
        return row, g.message(c1[row] ^ g.near[i]) << 12 | g.message(c2[row] ^ g.near[j]), (g.near[i] == 0) & (g.near[j] == 0)


PAGE_BITS = 15


def home_bitmap(prints: DataFrame, threshold: int) -> np.ndarray:
    """2 ** 24 bits as bytes: the anchors at which some fingerprint is at home. At most 512 pages of 4 KB go to the driver."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << 24, bool)
        anchors = Anchors(threshold)
        for batch in batches:
            seen[anchors.home(batch.fp.to_numpy(np.int64))] = True
        table = np.packbits(seen.reshape(-1, 1 << PAGE_BITS), axis=1)
        some = np.flatnonzero(table.any(1))
        yield pd.DataFrame({"page": some, "bits": [table[i].tobytes() for i in some]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce(np.stack([np.frombuffer(b, np.uint8) for b in group.bits]))
        return pd.DataFrame({"page": group.page[:1], "bits": [bits.tobytes()]})

    out = np.zeros((1 << 24 - PAGE_BITS, 1 << PAGE_BITS - 3), np.uint8)
    for r in prints.mapInPandas(pages, "page int, bits binary").groupBy("page").applyInPandas(merge, "page int, bits binary").collect():
        out[r.page] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def star(homes: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest of its group) that link what is linked between homes and fps, with as many as members at most."""
    own = np.unique(np.concatenate([homes, fps]))
    at_home, at = np.searchsorted(own, homes), np.searchsorted(own, fps)
    top = np.arange(len(own))
    for a in range(0, len(homes), 64):
        some = homes[a : a + 64]
        for b in range(0, len(fps), 1 << 16):
            i, j = np.nonzero(np.bitwise_count(some[:, None] ^ fps[b : b + (1 << 16)][None, :]) <= threshold)
            x, y = at_home[a + i], at[b + j]
            # Hook the larger of two groups' smallest members to the smaller one, until all that are linked agree.
            while len(x):
                p, q = top[x], top[y]
                open_ = p != q
                if not open_.any():
                    break
                x, y, p, q = x[open_], y[open_], p[open_], q[open_]
                np.minimum.at(top, np.maximum(p, q), np.minimum(p, q))
                while (top[top] != top).any():
                    top = top[top]
    linked = top != np.arange(len(own))
    return own[linked], own[top[linked]]


def links(prints: DataFrame, threshold: int = THRESHOLD, most_at_home: int = MOST_AT_HOME) -> DataFrame:
    """Edges (a, b) between different fingerprints of prints (fp, distinct): they connect what links of at most threshold bits connect."""
    spark = prints.sparkSession
    bitmap = spark.sparkContext.broadcast(home_bitmap(prints, threshold))
    crowded = (
        prints.mapInPandas(lambda it, own=threshold: (pd.DataFrame({"anchor": Anchors(own).home(b.fp.to_numpy(np.int64))}) for b in it), "anchor long")
        .groupBy("anchor")
        .count()
        .filter(F.col("count") > most_at_home)
        .select("anchor", F.ceil(F.col("count") / most_at_home).cast("int").alias("tasks"))
    )

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors, bits = Anchors(threshold), bitmap.value
        for batch in batches:
            fps = batch.fp.to_numpy(np.int64)
            for at in range(0, len(fps), 2000):
                some = fps[at : at + 2000]
                row, anchor, home = anchors.all(some)
                ok = bits[anchor >> 3] >> (7 - (anchor & 7)).astype(np.uint8) & 1 == 1
                yield pd.DataFrame({"anchor": anchor[ok], "fp": some[row[ok]], "home": home[ok]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by (anchor, task), one group after the other; groups are of different fingerprints."""
        rest: list[pd.DataFrame] = []

        def edges(whole: pd.DataFrame) -> pd.DataFrame:
            key = whole.anchor.to_numpy() << 32 | whole.task.to_numpy()
            fp, home = whole.fp.to_numpy(np.int64).view(np.uint64), whole.home.to_numpy(bool)
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            size, at_home = np.diff(cut), np.add.reduceat(home.astype(np.int64), cut[:-1])
            out = [(np.zeros(0, np.uint64),) * 2]
            for i in np.flatnonzero((size > 1) & (at_home > 0)):
                group = slice(cut[i], cut[i + 1])
                out.append(star(fp[group][home[group]], fp[group], threshold))
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            return pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            if not len(batch):
                continue
            key = batch.anchor.to_numpy() << 32 | batch.task.to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                yield edges(pd.concat([*rest, batch[:cut]], ignore_index=True))
                rest = []
            elif rest and (rest[-1].anchor.iloc[-1], rest[-1].task.iloc[-1]) != (batch.anchor.iloc[0], batch.task.iloc[0]):
                yield edges(pd.concat(rest, ignore_index=True))
                rest = []
            rest.append(batch[cut:])
        if rest:
            yield edges(pd.concat(rest, ignore_index=True))

    sent = prints.mapInPandas(send, "anchor long, fp long, home boolean")
    # Few anchors are crowded, if any: those at home are dealt to `tasks`, all others go to each of these.
    dealt = sent.join(crowded, "anchor", "left").withColumn("tasks", F.coalesce("tasks", F.lit(1)))
    dealt = dealt.withColumn("task", F.explode(F.when(F.col("tasks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tasks") - 1))))
    dealt = dealt.withColumn("home", F.col("home") & (F.pmod(F.xxhash64("fp"), F.col("tasks")) == F.col("task")))
    n = max(shuffle_partitions(spark), input_bytes(prints) * SPREAD // TASK_BYTES)
    grouped = dealt.select("anchor", "task", "fp", "home").repartition(n, "anchor", "task").sortWithinPartitions("anchor", "task")
    return grouped.mapInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): alternating large-star and small-star until nothing changes, which takes about the log of a chain's length."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = written(edges.filter("a <> b"), "edges")
    last = None
    while True:
        # Every node's smallest neighbour, itself included; then larger neighbours point to it.
        near = both(e)
        least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "large")
        # a > b in all of these; a's smaller neighbours, and a itself, point to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = written(small.filter("a <> b").distinct(), "small")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def classes(prints: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """From prints (doc_id, fp, more...), a written table: (fp, root) for every linked fingerprint, and the distinct fps."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return components(links(distinct.select("fp"), threshold)).select(F.col("node").alias("fp"), "root"), distinct


def with_components(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """prints (doc_id, fp) with component_id, the smallest doc_id reachable."""
    linked, distinct = classes(prints, threshold)
    rooted = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prints = written(docs.select("doc_id", fingerprinter()(F.col("text")).alias("fp")), "prints")
    return with_components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
