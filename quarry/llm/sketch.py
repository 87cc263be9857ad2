"""Threshold-scaled sketches: of a text's word shingles, every hash below a fixed fraction of the hash range is retained.

The fraction does not depend on the text, so sketches of any two texts, however unequal, can be merged by union and give
unbiased estimates of containment and likeness. A sketch also names its text (64 bits of a digest), so that texts too
short to have a retained hash still compare: alike if equal, else not.

A text is hashed some MB at a time, however long it is or a word in it; ranges of ids are as many as the input's size asks for.
Words are runs of anything but ASCII blanks, A-Z lower-cased; shingles are five words (a shorter text is one shingle).
Defined cases: a null text is empty; the empty text has no shingle; rows with equal ids follow each other in the order of
their texts, and the next document of a row is the next row in that order; a null id comes first; one row alone is its own
next document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, input_bytes, shuffle_partitions, utf8, written

WORDS, SCALE, PIECE, RANGE_BYTES = 5, 2, 4 << 20, 96 << 20
#: Ranges at most, each a task that sorts and streams its rows; rows of a sample for each; the sample's seed.
MOST_RANGES, TRIED, SEED = 20_000, 64, 23
#: All ASCII blanks to one.
BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))
#: Odd multipliers: of byte positions (with its inverse modulo 2 ** 64) and of word positions.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), out=out)
    return out


class Powers:
    """Powers of the two bases, as many as the longest text so far needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 1 << 16, len(self.up) * 3 // 2)
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)
        return self.up, self.down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def giant(raw: bytes, own: Powers) -> np.uint64:
    """The hash of one word of any length, a piece at a time."""
    total, far = 0, 1
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw[at : at + PIECE], np.uint8)
        up, _ = own.of(len(b) + 1)
        total += int(((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)]).sum(dtype=np.uint64)) * far
        far = far * int(up[len(b)]) % (1 << 64)
    return mixed(np.array([(total + len(raw)) % (1 << 64)], np.uint64))[0]


def word_hashes(raw: bytes, own: Powers) -> Iterator[np.ndarray]:
    """64-bit hashes of the words of a lower-cased text, some MB of text at a time."""
    raw, at = raw.translate(BLANKS), 0
    while at < len(raw):
        end = len(raw) if at + PIECE >= len(raw) else raw.rfind(b" ", at, at + PIECE)
        if end <= at:
            if raw[at : at + 1] == b" ":
                at += 1
                continue
            end = raw.find(b" ", at + PIECE)
            end = len(raw) if end < 0 else end
            yield np.array([giant(raw[at:end], own)], np.uint64)
            at = end
            continue
        b = np.frombuffer(raw[at:end], np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], b == 32, [True]]).astype(np.int8)))
        start, stop = edges[::2], edges[1::2]
        up, down = own.of(len(b) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
        yield mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
        at = end


def shingle_hashes(raw: bytes, own: Powers, words: int = WORDS) -> Iterator[np.ndarray]:
    """A 64-bit hash of each shingle of words of a lower-cased text, some MB of text at a time."""
    held, some = np.zeros(0, np.uint64), False
    for word in word_hashes(raw, own):
        word = np.concatenate([held, word])
        if len(word) >= words:
            out = np.zeros(len(word) - words + 1, np.uint64)
            for i in range(words):
                out = out * np.uint64(BASE) + word[i : len(word) - words + 1 + i]
            yield mixed(out + np.uint64(words))
            some = True
        held = word[max(0, len(word) - words + 1) :]
    if len(held) and not some:
        out = np.zeros(1, np.uint64)
        for x in held:
            out = out * np.uint64(BASE) + x
        yield mixed(out + np.uint64(len(held)))


def sketch(text: str, own: Powers, scale: int = SCALE) -> tuple[bytes, np.ndarray]:
    """(8 bytes that name the text, sorted retained hashes as their upper 32 of the bits below the threshold)."""
    raw = utf8(text)
    kept = [np.zeros(0, np.uint32)]
    for h in shingle_hashes(raw.translate(LOWER_BYTES), own):
        h = h[h < np.uint64((1 << 64) // scale)] if scale > 1 else h
        kept.append(np.unique((h * np.uint64(scale)) >> np.uint64(32)).astype(np.uint32))
    return hashlib.blake2b(raw, digest_size=8).digest(), np.unique(np.concatenate(kept)) if len(kept) > 2 else kept[-1]


def packed(s: tuple[bytes, np.ndarray]) -> bytes:
    return s[0] + s[1].astype(">u4").tobytes()


def unpacked(x: bytes) -> tuple[bytes, np.ndarray]:
    return x[:8], np.frombuffer(x, ">u4", offset=8).astype(np.uint32)


def merged(a: tuple, b: tuple) -> np.ndarray:
    """Retained hashes of the union of two texts' shingles."""
    return np.union1d(a[1], b[1])


def likeness(a: tuple, b: tuple) -> float:
    """Estimated share of the shingles of either text that both have."""
    if a[0] == b[0]:
        return 1.0
    both = len(np.intersect1d(a[1], b[1], assume_unique=True))
    return both / (len(a[1]) + len(b[1]) - both) if len(a[1]) + len(b[1]) else 0.0


def containment(a: tuple, b: tuple) -> float:
    """Estimated share of the first text's shingles that the second has."""
    if a[0] == b[0]:
        return 1.0
    return len(np.intersect1d(a[1], b[1], assume_unique=True)) / len(a[1]) if len(a[1]) else 0.0


def edited(text: str, after: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


OUT = "doc_id long, n_chars long, edited_sha256 string, sketch binary, edited_sketch binary, near_edited double, near_next double"


def result(doc_id, text: str, after: str, own: Powers, mine: tuple, following: tuple) -> tuple:
    new = edited(text, after)
    other = sketch(new, own)
    return doc_id, len(text), hashlib.sha256(utf8(new)).hexdigest(), packed(mine), packed(other), likeness(mine, other), likeness(mine, following)


def whole_id(x):
    return None if pd.isna(x) else int(x)


def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over sorted rows of one or more ranges: the finished rows, all but the last of each range."""
    own, held, rows = Powers(), None, []
    names = [x.split()[0] for x in OUT.split(", ")]
    for batch in batches:
        for part, doc_id, text in zip(batch.part, batch.doc_id, batch.text, strict=True):
            now = (whole_id(doc_id), text if isinstance(text, str) else "")
            mine = sketch(now[1], own)
            if held is not None and held[2] == part:
                rows.append(result(*held[0], now[1], own, held[1], mine))
            held = now, mine, part
            if len(rows) >= 2000:
                yield pd.DataFrame(rows, columns=names, dtype=object)
                rows = []
    yield pd.DataFrame(rows, columns=names, dtype=object)


def at_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    own = Powers()
    for batch in batches:
        rows = []
        for doc_id, text, after in zip(batch.doc_id, batch.text, batch.after, strict=True):
            text, after = (x if isinstance(x, str) else "" for x in (text, after))
            rows.append(result(whole_id(doc_id), text, after, own, sketch(text, own), sketch(after, own)))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")], dtype=object)


def numberer(bounds: list[tuple[int, int]]):
    """A Pandas UDF: (key, prefix) to the number of bounds up to it, found in two sorted arrays. Marked as not deterministic only so that Spark runs it once."""
    keys, prefixes = (np.array([b[i] for b in bounds], np.int64) for i in range(2))

    @F.pandas_udf("int")
    def part(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, prefix in batches:
            key, prefix = key.to_numpy(np.int64), prefix.to_numpy(np.int64)
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            # Few rows have the id of a bound, but for ids that fill several ranges.
            for k in np.unique(key[low < high]):
                own = key == k
                a, b = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                low[own] = a + np.searchsorted(prefixes[a:b], prefix[own], "right")
            yield pd.Series(low.astype(np.int32))

    return part.asNondeterministic()


def ranges(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """Bounds (key, prefix) of about n ranges of rows (key, prefix) of about equal numbers of rows, from a sample of `TRIED` rows a range.

    A range begins with a whole id, but for an id that fills more than one: that is cut by its texts' first bytes. The bounds are
    worked out once, so that a recomputation cuts alike, whatever the sample was.
    """
    total = rows.count() if n > 1 else 0
    if not total:
        return []
    few = rows.sample(min(1.0, TRIED * n / total), SEED).select("key", "prefix").toArrow()
    pairs = sorted(zip(few["key"].to_pylist(), few["prefix"].to_pylist(), strict=True))
    found = [pairs[len(pairs) * i // n] for i in range(1, n)] if pairs else []
    times = Counter(k for k, _ in found)
    return sorted({(k, x if times[k] > 1 else 0) for k, x in found} | {(k, 0) for k in times})


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """docs (doc_id, text): each row's sketches and likenesses (OUT), its edited text made with the next row.

    One shuffle by ranges of ids; within a range rows follow each other as a stream. Only the ranges' first and last
    texts (two for each partition) cross ranges. The ranges' bounds are worked out first, from a sample of ids and first bytes
    of texts; these, and the ranges' least and greatest ids, are all that goes to the driver: some for each of MOST_RANGES.
    """
    spark = docs.sparkSession
    n = partitions or min(MOST_RANGES, max(shuffle_partitions(spark), input_bytes(docs) // RANGE_BYTES))
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", least))
    # The first six bytes as a number that orders as they do.
    prefix = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("long")
    bounds = ranges(rows.withColumn("prefix", prefix), n)
    rows = rows.withColumn("part", numberer(bounds)(F.col("key"), prefix) if bounds else F.lit(0))
    ends = sorted((r.part, r.low, r.high) for r in rows.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect())
    ranged = rows.select("part", "doc_id", "text").repartitionByRange(max(n, len(bounds) + 1), "part").sortWithinPartitions("part", "doc_id", "text")
    done = ranged.mapInPandas(in_order, OUT)
    if not ends:
        return done
    parts = [p for p, _, _ in ends]
    ids = spark.createDataFrame([(k,) for k in sorted({k for _, *two in ends for k in two})], "key long")
    row = F.struct("doc_id", "text")
    # Written, as few as ranges: so that no row of a range is read for both its head and its tail again.
    edges = written(rows.join(F.broadcast(ids), "key", "left_semi").groupBy("part").agg(F.min(row).alias("head"), F.max(row).alias("tail")), "edges")
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, next_part int")
    heads = edges.select(F.col("part").alias("next_part"), F.col("head.text").alias("after"))
    tails = edges.select("part", "tail.*").join(follows, "part").join(heads, "next_part")
    return done.unionByName(tails.select("doc_id", "text", "after").mapInPandas(at_edges, OUT))


def op4_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("sketch")).alias("fingerprint"), F.lower(F.hex("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")
