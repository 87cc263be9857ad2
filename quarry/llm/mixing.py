"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame and SQL functions only.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all words; a target stops at `cap` times its
source's size and the excess is shared again by weight (the fixed point is least(cap, level * weight), where the level is
the largest over the sources in order of cap / weight of what is left over the weights that are left).

Blocks: a source gives whole passes over itself, as many as come nearest its target, and blocks of equal size are added to
these or, where they are too many, left out of the last: `block` words, but at most a thousandth of the mean source. So no
cell is asked for more than about half of its words, and its last, short block costs nothing. Blocks are allocated to sources by highest quotients words / (2 n + 1), then each
source's to bands of its shards and each band's to its shards likewise, which gives integer quotas. Where seats are many the first of them are given at once:
rounding words / d for a divisor d that is surely too large gives each no more than it must get, and only the last few per
row are ranked by quotient.

Selection: a cell (source, shard) is its documents in a seeded order as one line of words, cut into blocks. The blocks are put
in the order of a seeded hash and taken until the cell's quota of words is full: the line's short last block, if it is among
them, is made up from the start of the next block in that order. So a source gives its blocks' words exactly, but for a
cell with fewer words than its quota. A block is hundreds of words on end: most documents come whole or not at all.

Scale: the text is read once, and (doc, source, size, hash) is written to the shared folder; sources, cells and their plan are
written too, each worked out once. A source has shards by its own size, about `CELL` blocks of words each (more where the
whole would have over a million), so a hot source is dealt over as many tasks as its words ask for. What a cell sends to its
documents is three numbers; a document works out the hashes of the blocks that it lies in itself. Only rows of sources (one
for each) meet in one task, and of a source's cells as many as the root of their number.

Defined cases: null text is size 0; a source of size 0 has target 0; an empty table gives an empty result; rows with equal
ids are rows of their own, and lie in cells of their own if their texts differ; ties of quotients go by code point of the
source, then by shard; reruns agree. `stage` adds its columns to those of the documents, in place of any of the same name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
CAP, BLOCK, CELL, SEED = 3, 512, 8, 11


class Dialect:
    """What Spark and DuckDB write differently."""

    div, text = "div", "STRING"

    def hashed(self, x: str) -> str:
        return f"CAST(conv(substr(md5({x}), 1, 15), 16, 10) AS BIGINT)"

    def upto(self, first: int, last: str) -> str:
        return f"explode(sequence(CAST({first} AS BIGINT), CAST({last} AS BIGINT)))"

    def each(self, first: str, last: str, value: str) -> str:
        return f"transform(sequence({first}, {last}), j -> {value})"

    def total(self, items: str) -> str:
        return f"aggregate({items}, CAST(0 AS BIGINT), (x, y) -> x + y)"


class Duck(Dialect):
    div, text = "//", "VARCHAR"

    def hashed(self, x: str) -> str:
        return f"CAST(concat('0x', substr(md5({x}), 1, 15)) AS BIGINT)"

    def upto(self, first: int, last: str) -> str:
        return f"unnest(generate_series(CAST({first} AS BIGINT), CAST({last} AS BIGINT)))"

    def each(self, first: str, last: str, value: str) -> str:
        return f"list_transform(range({first}, {last} + 1), lambda j: {value})"

    def total(self, items: str) -> str:
        return f"list_sum({items})"


def seats(d: Dialect, name: str, rows: str, key: str, votes: str, n: str, by: str) -> str:
    """CTEs that give n seats to rows by Sainte-Lague, within `by` (a window's partition): {name}(key, q)."""
    keys = ", ".join(key)
    on = " AND ".join(f"b.{k} = m.{k}" for k in key)
    return f"""
{name}_v AS (SELECT {keys}, CAST({votes} AS DOUBLE) AS v, sum({votes}) OVER ({by}) * 1.0e0 AS vs, {n} AS seats, count(*) OVER ({by}) AS n FROM {rows} WHERE {votes} > 0),
{name}_b AS (SELECT *, CAST(greatest(0, floor(v * greatest(seats - n / 2.0e0, 0) / vs + 0.5e0)) AS BIGINT) AS base FROM {name}_v),
{name}_g AS (SELECT *, sum(base) OVER ({by}) AS given FROM {name}_b),
{name}_t AS (SELECT {keys}, v, base, seats, given, {d.upto(1, "ceil(v / vs * n) + 2")} AS j FROM {name}_g),
{name}_r AS (SELECT {keys}, seats - given AS open, row_number() OVER ({by} ORDER BY v / (2 * (base + j) - 1) DESC, {keys}, j) AS r FROM {name}_t),
{name} AS (SELECT b.{", b.".join(key)}, b.base + coalesce(m.more, 0) AS q FROM {name}_b b LEFT JOIN (SELECT {keys}, count(*) AS more FROM {name}_r WHERE r <= open GROUP BY {keys}) m ON {on})"""


def targets_sql(d: Dialect, cap: int, block: int) -> str:
    """From sizes: of each source its size s, target, passes p, blocks q for the rest, the blocks' size and its shards."""
    seated = seats(d, "quota", "rests", ["k"], "v", "CAST(round(sum(v) OVER () / block) AS BIGINT)", "")
    return f"""
WITH sources AS (SELECT k, CAST(sum(size) AS BIGINT) AS s FROM sizes GROUP BY k),
weighed AS (SELECT k, s, CASE (row_number() OVER (ORDER BY CASE WHEN k = 'n' THEN 1 ELSE 0 END, k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
  CAST(greatest(1, least({block}, floor(sum(s) OVER () / (1000.0e0 * count(*) OVER ())))) AS BIGINT) AS block, sum(s) OVER () AS t FROM sources),
levels AS (SELECT *, (t - (sum({cap} * s) OVER (ORDER BY s * 1.0e0 / w, k ROWS UNBOUNDED PRECEDING) - {cap} * s)) * 1.0e0
    / (sum(w) OVER () - (sum(w) OVER (ORDER BY s * 1.0e0 / w, k ROWS UNBOUNDED PRECEDING) - w)) AS level FROM weighed),
aims AS (SELECT *, least({cap} * 1.0e0 * s, w * max(level) OVER ()) AS target FROM levels),
passes AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE CAST(floor(target / s + 0.5e0) AS BIGINT) END AS p FROM aims),
rests AS (SELECT *, abs(target - p * s) AS v, CASE WHEN target < p * s THEN -1 ELSE 1 END AS sign FROM passes),{seated}
SELECT r.k, s, target, p, sign, block, coalesce(q, 0) AS q, CAST(greatest(1, ceil(s / greatest({CELL}.0e0 * block, t / 1.0e6))) AS BIGINT) AS shards FROM rests r LEFT JOIN quota ON r.k = quota.k"""


def cells_sql(d: Dialect) -> str:
    return f"SELECT z.k, z.h % shards AS shard, CAST(sum(size) AS BIGINT) AS c FROM sizes z JOIN targets t ON z.k = t.k GROUP BY z.k, z.h % shards"


def block_hash(d: Dialect, seed: int) -> str:
    return d.hashed(f"concat('{seed}|', k, '|', CAST(shard AS {d.text}), '|', CAST(j AS {d.text}))")


def plan_sql(d: Dialect, seed: int) -> str:
    """Of each cell: the hash of the last block that counts whole, that of the next one, and how many of its words count."""
    banded = seats(d, "quota1", "bands", ["k", "band"], "c", "seats", "PARTITION BY k")
    seated = seats(d, "quota2", "voted", ["k", "band", "shard"], "c", "seats", "PARTITION BY k, band")
    return f"""
WITH own AS (SELECT c.k, shard, c, t.q, shard % CAST(ceil(sqrt(shards)) AS BIGINT) AS band FROM cells c JOIN targets t ON c.k = t.k),
bands AS (SELECT k, band, CAST(sum(c) AS BIGINT) AS c, max(q) AS seats FROM own GROUP BY k, band),{banded},
voted AS (SELECT o.k, o.band, shard, c, g.q AS seats FROM own o JOIN quota1 g ON o.k = g.k AND o.band = g.band),{seated},
filled AS (SELECT c.k, c.shard, c.c, t.block, coalesce(q.q, 0) AS q FROM cells c JOIN targets t ON c.k = t.k LEFT JOIN quota2 q ON c.k = q.k AND c.shard = q.shard),
blocks AS (SELECT k, shard, c, block, q, {d.upto(0, f"(c - 1) {d.div} block")} AS j FROM filled WHERE q > 0 AND c > 0),
hashed AS (SELECT *, {block_hash(d, seed)} AS hj FROM blocks),
ordered AS (SELECT *, row_number() OVER (PARTITION BY k, shard ORDER BY hj, j) AS r FROM hashed)
SELECT k, shard, max(CASE WHEN r <= q THEN hj END) AS whole, max(CASE WHEN r = q + 1 THEN hj END) AS part, CAST(sum(CASE WHEN r <= q THEN greatest(0, (j + 1) * block - c) ELSE 0 END) AS BIGINT) AS more
FROM ordered GROUP BY k, shard"""


def lines_sql(d: Dialect, seed: int, carry: str = "") -> str:
    """Every document's place in its cell's line, from word a up to word b, and its overlaps with the blocks that are added or left out."""
    until = f"(j * block + CASE WHEN {block_hash(d, seed)} <= whole THEN block WHEN {block_hash(d, seed)} = part THEN more ELSE 0 END)"
    first, last, none = f"a {d.div} block", f"(b - 1) {d.div} block", "size = 0 OR whole IS NULL"
    items = d.each(first, last, f"greatest(0, least(b, {until}) - greatest(a, j * block))")
    runs = ""
    if carry:
        added = f"struct(greatest(a, j * block) - a AS first, least(b, {until}) - a AS stop)"
        left = f"struct(greatest(a, {until}) - a AS first, least(b, (j + 1) * block) - a AS stop)"
        runs = d.each(first, last, f"CASE WHEN sign > 0 THEN {added} ELSE {left} END")
        runs = f", CASE WHEN {none} OR sign > 0 THEN p ELSE p - 1 END AS passes, CASE WHEN {none} THEN array() ELSE filter({runs}, x -> x.first < x.stop) END AS spans"
    return f"""
WITH placed AS (SELECT z.*, s, target, p, sign, block, h % shards AS shard FROM sizes z JOIN targets t ON z.k = t.k),
ends AS (SELECT *, CAST(sum(size) OVER (PARTITION BY k, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b FROM placed),
spans AS (SELECT e.*, b - size AS a, whole, part, more FROM ends e LEFT JOIN plan n ON e.k = n.k AND e.shard = n.shard)
SELECT {carry or "doc_id"}, CAST(size AS BIGINT) AS size, s AS source_size, target, CAST(p * size + CASE WHEN {none} THEN 0 ELSE sign * {d.total(items)} END AS BIGINT) AS taken{runs}
FROM spans"""


def sizes(docs: DataFrame, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """docs as (doc_id, k, size, h): the source as a key, the number of words, a seeded hash of id and text."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.coalesce("text", F.lit("")))
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("k"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("h"),
        *([F.struct(*carry).alias("doc")] if carry else []),
    )


def mixed(docs: DataFrame, cap: int = CAP, block: int = BLOCK, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of docs (doc_id, source, text).

    With carry: these columns of docs, then those four, `passes` and `spans`: what to take, as whole passes over the text
    and runs of its words.
    """
    spark, d = docs.sparkSession, Dialect()
    z = written(sizes(docs, seed), "sizes")
    targets = written(run(spark, targets_sql(d, cap, block), sizes=z), "targets")
    cells = written(run(spark, cells_sql(d), sizes=z, targets=targets), "cells")
    plan = written(run(spark, plan_sql(d, seed), cells=cells, targets=targets), "plan")
    if not carry:
        return run(spark, lines_sql(d, seed), sizes=z, targets=targets, plan=plan)
    ours = ["size", "source_size", "target", "taken", "passes", "spans"]
    out = run(spark, lines_sql(d, seed, "doc"), sizes=sizes(docs, seed, carry), targets=targets, plan=plan)
    return out.select(*[F.col(f"doc.{c}").alias(c) for c in carry if c not in ours], *ours)


def run(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", text), **tables)


def oracle(cap: int = CAP, block: int = BLOCK, seed: int = SEED) -> str:
    d = Duck()
    sized = f"""SELECT doc_id, coalesce('s' || source, 'n') AS k, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
  {d.hashed(f"concat('{seed}|', coalesce(CAST(doc_id AS VARCHAR), 'null'), '|', coalesce(text, ''))")} AS h FROM documents"""
    return f"WITH sizes AS ({sized}), targets AS ({targets_sql(d, cap, block)}), cells AS ({cells_sql(d)}), plan AS ({plan_sql(d, seed)}), mix AS ({lines_sql(d, seed)}) SELECT * FROM mix"


ORACLE_SQL = oracle()


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with what the mix takes of each: its text stays whole, `passes` and `spans` say which words."""
    return mixed(docs, carry=docs.columns)
