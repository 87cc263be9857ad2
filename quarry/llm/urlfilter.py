"""URL rules judged by a Bloom filter cascade.

A rule is a key host + path. The keys of a url are all pairs of a suffix of its host at a label boundary (of at most as many
labels as some rule's host has) and a prefix of its path as long as some rule's path; a rule fits the url if its key is
among them. Listed keys are encoded in a first Bloom
filter; those of the corpus's complete key universe that pass it though they are not listed, in a second; listed keys that
pass both, in a third; and so on by turns until nothing passes wrongly. The parity of the first filter that a key fails
tells then exactly whether it is listed, for every key of the universe, and urls are judged without a join.

Scale: the universe is worked out once and written. The first filter's error rate is set from the counts of listed and unlisted keys, so what passes it wrongly, and
with it each later filter, is about as large as the list. The universe is distinct keys (summed in part before the
shuffle); only 16-byte hashes of wrongly passing keys go to the driver, which is proportional to the list.

Defined cases: a null url, or one without `://`, has empty host and path and no rule; an empty list lets everything pass
as `default`; a path shorter than a rule's does not fit; rows with equal urls are judged alike; a host or path of any length
has as many keys as the rules ask for, no more. `with_verdicts` keeps further columns, and its own (host, path, rule,
verdict) take the place of any of the same name. Which rules there are is a stated list, and with it what the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused, written

#: Fixed values: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEFAULT, LATER_RATE = "allow", 0.5


def hashes(keys: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each key."""
    return np.array([(xxhash.xxh64_intdigest(b := k.encode("utf-8", "surrogatepass"), 1), xxhash.xxh64_intdigest(b, 2)) for k in keys], np.uint64).reshape(-1, 2)


class Bloom:
    def __init__(self, keys: np.ndarray, rate: float, level: int):
        self.level = np.uint64(level)
        self.k = max(1, round(-np.log2(rate)))
        self.m = max(64, int(np.ceil(len(keys) * self.k / np.log(2))))
        bits = np.zeros(self.m, bool)
        for at in self.at(keys):
            bits[at] = True
        self.bits = np.packbits(bits)

    def at(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        salt = np.uint64((int(self.level) + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        a, b = keys[:, 0] ^ salt, (keys[:, 1] + salt) | np.uint64(1)
        for i in range(self.k):
            x = a + np.uint64(i) * b
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            yield ((x ^ (x >> np.uint64(29))) % np.uint64(self.m)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.at(keys):
            out &= self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
        return out


class Cascade:
    def __init__(self, filters: list[Bloom]):
        self.filters = filters

    def depth(self, keys: np.ndarray) -> np.ndarray:
        """How many filters from the first on a key passes in a row."""
        out, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for f in self.filters:
            alive = alive[f.has(keys[alive])]
            out[alive] += 1
        return out

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed: those that fail the first, third... filter aren't, nor pass all of an even number."""
        return self.depth(keys) % 2 == 1


def passing(universe: DataFrame, cascade: Cascade, n: int, listed: np.ndarray) -> np.ndarray:
    """Hashes of the unlisted keys of universe (a, b) that pass all n filters: about as many as are listed."""
    own = np.sort(listed[:, 0])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h = batch[["a", "b"]].to_numpy(np.int64).view(np.uint64).reshape(-1, 2)
            h = h[cascade.depth(h) == n]
            # Keys that share the first hash with a listed one are told apart by both.
            near = np.isin(h[:, 0], own, assume_unique=False)
            known = set(map(tuple, listed[np.isin(listed[:, 0], h[near, 0])].tolist())) if near.any() else set()
            keep = ~near
            keep[near] = [tuple(x) not in known for x in h[near].tolist()]
            yield pd.DataFrame(h[keep].view(np.int64), columns=["a", "b"])

    got = universe.mapInPandas(rows, "a long, b long").distinct().toPandas()
    return got.to_numpy(np.int64).view(np.uint64).reshape(-1, 2)


def hashed(keys: DataFrame) -> DataFrame:
    """keys (key) as the distinct pairs of their hashes (a, b)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(np.unique(hashes(list(batch.key)), axis=0).view(np.int64), columns=["a", "b"])

    return keys.mapInPandas(rows, "a long, b long").distinct()


def build(universe: DataFrame, listed: list[str], size: int | None = None) -> Cascade:
    """The cascade for listed keys over a universe, as keys (key) or as their hashes (a, b)."""
    if "key" in universe.columns:
        universe = hashed(universe)
    own = hashes(sorted(set(listed)))
    if not len(own):
        return Cascade([])
    size = universe.count() if size is None else size
    rate = min(0.5, max(1e-9, len(own) / np.sqrt(2) / max(size - len(own), 1)))
    filters = [Bloom(own, rate, 0)]
    wrong = passing(universe, Cascade(filters), 1, own)
    inside, outside = own, wrong  # what must pass and what must not, from here on both known in full
    while len(outside):
        filters.append(Bloom(outside, LATER_RATE, len(filters)))
        inside, outside = outside, inside[filters[-1].has(inside)]
    return Cascade(filters)


def parted(url: str = "url") -> dict:
    """host and path of a url, as columns."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr(f"substr({url}, instr({url}, '://') + 3)"), "#", 1)).otherwise(F.lit(""))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return {"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": F.substr(rest, F.length(host) + 1)}


def keys_of(host: str, path: str, lengths: list[int], labels: int) -> list[str]:
    """The keys of a url, as host + path: suffixes of the host of up to `labels` labels, prefixes of the path of the rules' lengths."""
    if not host or labels < 1:
        return []
    last = host.rsplit(".", labels)[-labels:]
    return [".".join(last[i:]) + path[:n] for i in range(len(last)) for n in lengths if n <= len(path)]


def with_verdicts(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """urls with host, path, rule (the longest that fits, else null) and verdict."""
    lengths = sorted({len(p) for _, _, p in rules})
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=0)
    longest = max(lengths, default=0)
    split = urls.drop("host", "path", "rule", "verdict").withColumns(parted(url))
    # Of a host and a path no more than the rules' own can be part of any key.
    ends = split.select(F.substring_index("host", ".", -max(labels, 1)).alias("host"), F.substring("path", 1, longest).alias("path")).distinct()

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = sorted({k for h, p in zip(batch.host, batch.path, strict=True) for k in keys_of(h, p, lengths, labels)})
            yield pd.DataFrame(hashes(keys).view(np.int64), columns=["a", "b"])

    universe = written(ends.mapInPandas(expand, "a long, b long").distinct(), "universe")
    size = universe.count()
    cascades = {v: build(universe, [h + p for w, h, p in rules if w == v], size) for v in sorted({v for v, _, _ in rules})}

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for host, path in hosts:
            pairs = list(zip(host, (p[:longest] for p in path), strict=True))
            if len(known) > 100_000:
                known.clear()
            new = [x for x in set(pairs) if x not in known]
            keys = [keys_of(*x, lengths, labels) for x in new]
            flat = [k for ks in keys for k in ks]
            h = hashes(flat)
            listed = {v: c.has(h) for v, c in cascades.items()}
            at = 0
            for x, ks in zip(new, keys, strict=True):
                fits = [(len(k), k, v) for i, k in enumerate(ks) for v in cascades if listed[v][at + i]]
                known[x] = max(fits)[1:] if fits else (None, default)
                at += len(ks)
            yield pd.DataFrame([known[x] for x in pairs], columns=["rule", "verdict"], dtype=object)

    judged = judge.asNondeterministic()(F.substring_index("host", ".", -max(labels, 1)), F.substring("path", 1, longest))
    own = unused(split, "__judged")
    return split.withColumn(own, judged).select("*", f"{own}.rule", f"{own}.verdict").drop(own)


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


ORACLE_SQL = """
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM b),
rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
d AS (SELECT c.*, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS n
  FROM c LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM d WHERE n = 1
"""
