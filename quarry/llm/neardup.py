"""The pipeline's near-dedup stage: texts whose five-word shingles have a Jaccard similarity of 0.8 or more are linked.

SimHash with anchor points, as `op8_simhash` has them, which keeps its own contract (three words, 2 of 64 bits). That radius finds few
pairs of this similarity, which differ in some 15 of 100 bits; so a set has one long fingerprint of 128 words of 23 bits here. A bit
is the sign of a sum over the set, and a word's codeword is that of the binary Golay code which agrees best with the sums, not with
their signs alone. Every two neighbouring words' codewords are an anchor; sets are compared where they meet at an anchor. Two sets at
0.8 have a codeword in common with a chance of 0.26 for each word, and no anchor of 128 with one of about 0.0006, less above.
Pairs whose fingerprints differ in more than `FAR` of 256 bits are left out (a pair at 0.8 with a chance under 0.000001). Each pair
that stays is then checked on its whole sets of shingles, so that no link is an estimate.

Scale: texts with equal sets are one row before anchors are made. At an anchor of at most `MOST` sets all pairs are
candidates. At a larger one, called a bucket, each set is compared with its hub alone at first: the set whose own buckets are largest in sum,
which is mostly the text that the others were made from. The sets that share a hub are its family. Of a family whose sets are
then in more than one component, every set outside the largest is compared with every set of another component, so that no
pair of a bucket is left undecided, whatever its size: two sets that are not compared are in one component already. For this
no whole set travels again, but only how each differs from the hub: two sets differ in what one of these two differences
has and the other has not. A family of any size is dealt out in parts of `PART` sets, and so are the pairs of one hub.
Components come from `simhash.components`. Only the texts of candidates are shuffled for the check.

Defined cases: as for `op8_simhash`; texts without words, and null ones, have equal sets; under five words are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, SLICE, slices, unused, utf8, written
from .simhash import BITS, Golay, components

WORDS, SEED, MOST, SALTS, PART = 5, 42, 32, 16, 1000
#: Words of a fingerprint, as many anchors; bits that are compared before sets are; in how many of these a candidate may differ.
PARTS, COMPARED_BITS, FAR = 128, 256, 84
#: Similarity of 0.8, as a fraction.
OVER, UNDER = 4, 5
#: For each 64 bits of a fingerprint two numbers that hash a shingle's hash again.
MIXED = np.random.default_rng(SEED).integers(0, 1 << 63, (2, PARTS * BITS // 64), dtype=np.int64).view(np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The set of hashes of a text's shingles, in order."""
    w = utf8(text).translate(LOWER_BYTES).split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(w), min(WORDS, len(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def sums(h: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint: how many more of the set's hashes have it than have it not."""
    ones = np.zeros(PARTS * BITS, np.int64)
    for at in range(0, len(h), 255):
        x = (h[at : at + 255, None] ^ MIXED[0]) * MIXED[1]
        x ^= x >> np.uint64(32)
        x *= MIXED[0]
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return 2 * ones - len(h)


class Anchors:
    """Codewords as signs, a column for each message."""

    def __init__(self):
        words = np.arange(1 << 12) << 11
        codewords = words ^ Golay(0).syndrome(words)
        self.signs = ((codewords[None, :] >> np.arange(BITS)[:, None] & 1) * 2 - 1).astype(np.float32)

    def of(self, total: np.ndarray) -> np.ndarray:
        """A set's anchors by its sums: the messages of each word's best codeword and of the next word's."""
        best = (total.reshape(PARTS, BITS).astype(np.float32) @ self.signs).argmax(1)
        return (best << 12 | np.roll(best, -1)).astype(np.int32)


def signer():
    """An Arrow UDF: text to its set's digest, size, anchors (none for an empty set) and first bits. Marked as not deterministic only so that Spark runs it once."""

    @F.arrow_udf("fp long, n int, anchors array<int>, bits array<long>")
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        anchors, kinds = Anchors(), [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for texts in (some for batch in batches for some in slices(batch)):
            out = []
            for t in texts:
                h = shingles(t)
                total = sums(h)
                bits = np.packbits(total[:COMPARED_BITS] > 0).view(np.int64)
                out.append((np.array(xxhash.xxh64_intdigest(h.tobytes()), np.uint64).view(np.int64), len(h), anchors.of(total) if len(h) else np.zeros(0, np.int32), bits))
            yield pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["fp", "n", "anchors", "bits"])

    return signed.asNondeterministic()


def close(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) whose fingerprints differ in at most FAR of the bits that distinct (fp, bits) has."""
    side = lambda name: distinct.select(F.col("fp").alias(name), F.col("bits").alias(f"{name}_bits"))
    differing = sum(F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])) for i in range(COMPARED_BITS // 64))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(differing <= FAR).select("a", "b")


def candidates(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """Pairs (a, b, family): sets of distinct (fp, n, anchors, bits) that share an anchor. family: a is the hub of a large bucket that b is in."""
    placed_at = distinct.select(F.struct("fp", "n").alias("x"), F.posexplode("anchors").alias("word", "anchor"))
    rows = placed_at.select("x", F.shiftleft(F.col("word").cast("long"), 24).bitwiseOR(F.col("anchor").cast("long")).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    placed = written(rows.join(sizes, "key"), "placed")
    may = lambda x, y: UNDER * F.least(x["n"], y["n"]).cast("long") >= OVER * F.greatest(x["n"], y["n"]).cast("long")
    pair = lambda x, y: F.struct(F.least(x["fp"], y["fp"]).alias("a"), F.greatest(x["fp"], y["fp"]).alias("b"))
    group = placed.filter(F.col("m") <= most).groupBy("key").agg(F.collect_list("x").alias("g"))
    within = F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: (x["fp"] < y["fp"]) & may(x, y)), lambda y: pair(x, y))))
    # A set's weight: the sizes of its large buckets, summed. One shuffle by sets, whose large buckets are PARTS at most.
    large = placed.filter(F.col("m") > most).groupBy("x").agg(F.collect_list("key").alias("keys"), F.sum("m").alias("weight"))
    weighed = written(large.select(F.explode("keys").alias("key"), "x.fp", "weight"), "weighed")
    best = weighed.groupBy("key").agg(F.max(F.struct("weight", "fp")).alias("best"))
    # A hub goes to every salt of its bucket, so that the rows of one that holds a third of all are dealt over SALTS tasks.
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    hubs = best.select("key", F.col("best.fp").alias("hub"), F.explode(salts).alias("salt"))
    members = weighed.withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(SEED)), F.lit(SALTS).cast("long"))).join(hubs, ["key", "salt"])
    across = members.filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"), F.lit(True).alias("family"))
    near = close(group.select(F.explode(within).alias("p")).select("p.*").distinct(), distinct).withColumn("family", F.lit(False))
    return written(near.unionByName(across.distinct()), "pairs")


def sets_of(texts: DataFrame) -> DataFrame:
    """(fp, s) of texts (fp, text): their sets as longs, some hundred at a time."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                some = batch.slice(at, SLICE)
                sets = [shingles(t).view(np.int64) for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("fp"), pa.array(sets, pa.list_(pa.int64()))], ["fp", "s"])

    return texts.mapInArrow(made, "fp long, s array<long>")


def alike(x: int, y: int, shared: int) -> bool:
    """Whether sets of these sizes that share so many have a similarity of 0.8 or more."""
    return (OVER + UNDER) * shared >= OVER * (x + y)


def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a, part, b, family, s) by (a, part), a's own set first, with b null: each b's likeness to a, and in families what they differ in."""
    key, own = None, np.zeros(0, np.int64)
    for batch in (x[at : at + SLICE] for x in batches for at in range(0, len(x), SLICE)):
        out = []
        for a, part, other, family, b, s in zip(batch.a.tolist(), batch.part.tolist(), batch.other.tolist(), batch.family.tolist(), batch.b.tolist(), batch.s, strict=True):
            s = np.asarray(s, np.int64)
            if not other:
                key, own = (a, part), np.sort(s)
                continue
            assert (a, part) == key, "a pair came without its first set"
            shared = np.intersect1d(own, s, assume_unique=True)
            near = alike(len(own), len(s), len(shared))
            if family or near:
                out.append((a, b, bool(family), near, len(s), np.setxor1d(own, s, assume_unique=True) if family else None))
        yield pd.DataFrame(out, columns=COMPARED_NAMES)


COMPARED = "a long, b long, family boolean, near boolean, n int, differs array<long>"
COMPARED_NAMES = [x.split()[0] for x in COMPARED.split(", ")]


def in_parts(keyed: DataFrame, key: str, part: int) -> DataFrame:
    """(key, parts): in how many parts of at most about so many rows each key's rows are dealt."""
    return keyed.groupBy(key).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))


def dealt(rows: DataFrame, key: str, order: str, to: str) -> DataFrame:
    """rows by key and part, in the order of a column within each."""
    return rows.repartition(key, "part").sortWithinPartitions(key, "part", order).select(*to.split())


def checked(pairs: DataFrame, distinct: DataFrame, marked: DataFrame, names: list[str], part: int = PART) -> DataFrame:
    """COMPARED of pairs (a, b, family), on whole sets. marked: documents with `keys` of these names. a's set is sent once to each part of its pairs."""
    fps = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    wanted = distinct.join(fps, "fp").withColumns(keys(F.col("first.doc_id"), F.col("first.token"), names)).select("fp", *names)
    # Ids are hashed, so that texts are only sorted where they are among those wanted.
    texts = marked.select(*names, "text").join(wanted.hint("shuffle_hash"), names).dropDuplicates(names)
    sets = written(sets_of(texts.select("fp", "text")), "sets")
    parts = written(in_parts(pairs, "a", part), "parts")
    first = sets.withColumnRenamed("fp", "a").join(parts, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("other"), F.lit(False).alias("family"), F.col("a").alias("b"), "s")
    spread = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("other"), "family", "b")
    rows = first.unionByName(spread.join(sets.withColumnRenamed("fp", "b"), "b"))
    return written(dealt(rows, "a", "other", "a part other family b s").mapInPandas(compared, COMPARED), "compared")


def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (hub, part, left, fp, root, n, differs) by (hub, part), a part's sets first, then the sets left over: edges between them."""
    key, held, index = None, [], None
    for batch in batches:
        out = []
        for hub, part, left, fp, root, n, differs in zip(batch.hub.tolist(), batch.part.tolist(), batch.left.tolist(), batch.fp.tolist(), batch.root.tolist(), batch.n.tolist(), batch.differs, strict=True):
            differs = np.asarray(differs, np.int64)
            if (hub, part) != key:
                key, held, index = (hub, part), [], None
            if not left:
                held.append((fp, root, n, differs))
                continue
            if not held:
                continue
            if index is None:
                size = np.array([len(x[3]) for x in held])
                values, owner = np.concatenate([x[3] for x in held]), np.repeat(np.arange(len(held)), size)
                order = np.argsort(values, kind="stable")
                index = values[order], owner[order], size, *(np.array([x[i] for x in held], np.int64) for i in range(3))
            values, owner, size, fps, roots, ns = index
            a, b = np.searchsorted(values, differs, "left"), np.searchsorted(values, differs, "right")
            row = np.repeat(np.arange(len(a)), b - a)
            at = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[row]
            both = np.bincount(owner[at], minlength=len(held))
            shared = (n + ns - (len(differs) + size - 2 * both)) // 2
            near = np.flatnonzero((roots != root) & ((OVER + UNDER) * shared >= OVER * (n + ns)))
            # One edge to each other component is as good as all.
            out += [(fp, int(fps[i])) for i in near[np.unique(roots[near], return_index=True)[1]]]
        yield pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)


def completed(found: DataFrame, distinct: DataFrame, linked: DataFrame, part: int = PART) -> DataFrame:
    """Edges (a, b) between sets of a family that are in different components so far. found: COMPARED; linked: (node, root)."""
    others = found.filter("family").select(F.col("a").alias("hub"), F.col("b").alias("fp"), "n", "differs")
    hubs = others.select("hub").distinct().join(distinct.select(F.col("fp").alias("hub"), "n"), "hub").select("hub", F.col("hub").alias("fp"), "n", F.array().cast("array<long>").alias("differs"))
    family = others.unionByName(hubs).join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    family = written(family, "family")
    each = family.groupBy("hub", "root").agg(F.count("*").alias("m"))
    mixed = each.groupBy("hub").agg(F.max(F.struct("m", "root")).alias("main"), F.count("*").alias("roots"), F.ceil(F.sum("m") / part).cast("int").alias("parts")).filter("roots > 1")
    rows = family.join(written(mixed.select("hub", F.col("main.root").alias("main"), "parts"), "mixed"), "hub")
    names = ["hub", "part", "left", "fp", "root", "n", "differs"]
    members = rows.withColumns({"part": F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), "left": F.lit(False)})
    left = rows.filter("root <> main").withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "left": F.lit(True)})
    return dealt(members.select(names).unionByName(left.select(names)), "hub", "left", " ".join(names)).mapInPandas(joined, "a long, b long").distinct()


def links(distinct: DataFrame, marked: DataFrame, names: list[str], most: int = MOST, part: int = PART) -> DataFrame:
    """(node, root) of the sets that are linked to others."""
    found = checked(candidates(distinct, most), distinct, marked, names, part)
    near = found.filter("near").select("a", "b")
    linked = components(near)
    more = written(completed(found, distinct, linked, part), "more")
    return linked if more.isEmpty() else components(near.unionByName(more))


def keys(doc_id: Column, token: Column, names: list[str]) -> dict[str, Column]:
    """Plain equality on two columns without nulls."""
    return dict(zip(names, (F.coalesce(doc_id, F.lit(0).cast("long")), F.xxhash64(token, doc_id.isNull())), strict=True))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, most: int = MOST, part: int = PART) -> DataFrame:
    """One row of each component: that with the smallest (doc_id, hash of the text), and one of rows equal in both."""
    token = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("token"))).alias("first")
    prints = docs.select("doc_id", token.alias("token"), signer()(F.col("text")).alias("s")).select("doc_id", "token", "s.*")
    distinct = written(prints.groupBy("fp").agg(first, *[F.any_value(c).alias(c) for c in ("n", "anchors", "bits")]), "distinct")
    names = [unused(docs, "__id"), unused(docs, "__token")]
    marked = docs.withColumns(keys(F.col("doc_id"), token, names))
    linked = links(distinct, marked, names, most, part).select(F.col("node").alias("fp"), "root")
    rooted = distinct.select("fp", "first").join(linked, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    keep = written(rooted.withColumns(keys(F.col("first.doc_id"), F.col("first.token"), names)).select(*names), "kept")
    # Ids and tokens alone tell which rows repeat; only the texts of these are brought together, the others stay where they are read.
    again = written(marked.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1").select(*names), "again")
    # The few numbers of a document to keep are hashed in each task; a sort would hold its texts.
    keep = keep.hint("shuffle_hash")
    once = marked.join(again, names, "left_anti").join(keep, names, "left_semi")
    one = marked.join(again, names, "left_semi").join(keep, names, "left_semi").dropDuplicates(names)
    return once.unionByName(one).drop(*names)
