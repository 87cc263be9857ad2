"""Chat formatting after cumulative-snapshot collapse. DataFrame functions only.

Chat logs often hold a conversation again and again as it grows. A hash of the first n turns (each turn's hash bound to its
place, all combined by exclusive or, 128 bits) is kept for every n. A conversation whose whole hash is that of the first n
turns of a longer one is a snapshot of it, and goes by an anti-join; of equal conversations the smallest conv_id stays.
What is maximal is rendered, turn by turn: `<|im_start|>role`, the text, `<|im_end|>`; where a text itself holds `<|`, a
blank is put between the two signs, so no text can close its turn. A row holds `PART` turns of a conversation, counted by
their places: turns 0 to PART - 1 are part 0, and so on, however the turns are numbered.

Scale: a conversation is cut into groups of adjacent turn numbers, a group with more than `CROWDED` turns by single turn
numbers and by a byte of the turns' hashes, so that a conversation (or the null one) with a third of all rows is dealt over
many tasks. Places and running hashes come from the groups' sizes and hashes, which are few; only ids and hashes (40 bytes a
turn) are shuffled for them. The texts are shuffled once, by groups; a part that lies in one group, as nearly all do, is
finished there, and only the pieces of the others meet again. The anti-join's sides are made distinct first (summed in part
before the shuffle), so a first turn that many share is one row.

Defined cases: turns go by number, null first; those with equal numbers by the MD5 of role and text, and equal rows are
turns of their own; a null role or text is not an empty one, and renders as an empty string; a null conv_id is a
conversation like any other, and stays for equal ones only if no other does; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

PART, GROUP_BITS, CROWDED = 256, 12, 1 << 16
KEY, GROUP = ["z", "c"], ["z", "c", "g", "number", "byte"]
LEAST = -(1 << 63)


def keyed(turns: DataFrame, *more: Column | str) -> DataFrame:
    """turns with plain keys: conversation (z, c), number t, order o among equal numbers, b a second hash, coarse group g."""
    o = F.conv(F.substring(F.md5(F.concat(*[F.coalesce(F.concat(F.lit(m), c), F.lit("-")) for m, c in (("r", F.col("role")), ("\1t", F.col("text")))])), 1, 15), 16, 10).cast("long")
    b = F.xxhash64(F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())
    t = F.coalesce(F.col("turn").cast("long"), F.lit(LEAST))
    rows = turns.select(F.col("conv_id").isNull().alias("z"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c"), t.alias("t"), o.alias("o"), b.alias("b"), *more)
    return rows.withColumn("g", F.shiftright("t", GROUP_BITS))


def grouped(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """rows with their group: all of a coarse one, or where that is crowded one turn number and one byte of its order."""
    marked = rows.join(crowded, ["z", "c", "g"], "left")
    fine = {"number": F.col("t"), "byte": F.shiftright("o", 52)}
    return marked.withColumns({k: F.when(F.col("many"), v).otherwise(F.lit(0)) for k, v in fine.items()}).drop("many")


def prefixes(rows: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: (z, c, at, n, a, b), the hashes of the first `at` of a conversation's n turns, and its groups (GROUP, skip, n)."""
    rows = grouped(rows, crowded)
    conv = W.partitionBy(*KEY)
    before = conv.orderBy("g", "number", "byte").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy(*GROUP).agg(F.count("*").alias("m"))
    groups = written(sizes.select(*GROUP, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("skip"), F.sum("m").over(conv).alias("n")), "groups")
    inside = W.partitionBy(*GROUP).orderBy("t", "o", "b")
    placed = rows.join(groups, GROUP).withColumn("at", F.row_number().over(inside) + F.col("skip"))
    placed = placed.withColumns({"a": F.xxhash64("at", "o", "b"), "b": F.xxhash64("b", "o", "at")})
    run = inside.rowsBetween(W.unboundedPreceding, 0)
    run = placed.select(*GROUP, "at", "n", *[F.bit_xor(x).over(run).alias(x) for x in "ab"])
    # What the groups before add to a running hash: the last one of each group, combined along the conversation.
    run = written(run, "running")
    last = run.groupBy(*GROUP).agg(F.max(F.struct("at", "a", "b")).alias("x"))
    ahead = last.select(*GROUP, *[F.coalesce(F.bit_xor(f"x.{x}").over(before), F.lit(0).cast("long")).alias(f"{x}0") for x in "ab"])
    out = run.join(ahead, GROUP).select(*KEY, "at", "n", *[F.col(x).bitwiseXOR(F.col(f"{x}0")).alias(x) for x in "ab"])
    return out, groups


def maximal(p: DataFrame) -> DataFrame:
    """(z, c) of the conversations of prefixes p that are no snapshot of a longer one, one of each set of equal ones."""
    whole = p.filter("at = n").groupBy("at", "a", "b").agg(F.min(F.struct(*KEY)).alias("k"))
    inner = p.filter("at < n").select("at", "a", "b").distinct()
    return whole.join(inner, ["at", "a", "b"], "left_anti").select("k.*")


def rendered(role: Column, text: Column) -> Column:
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def formatted(turns: DataFrame, size: int = PART, most: int = CROWDED) -> DataFrame:
    """(conv_id, part, n_turns, part_turns, text) of every maximal conversation, parts of `size` places from 0 on."""
    hashed = keyed(turns.select("conv_id", "turn", "role", "text"))
    crowded = written(hashed.groupBy("z", "c", "g").count().filter(F.col("count") > most).select("z", "c", "g", F.lit(True).alias("many")), "crowded")
    p, groups = prefixes(hashed, crowded)
    p = written(p, "prefixes")
    keep = written(groups.join(maximal(p), KEY, "left_semi"), "kept")
    rows = keyed(turns, rendered(F.col("role"), F.col("text")).alias("x"))
    rows = grouped(rows, crowded).drop("b").join(keep, GROUP)
    inside = W.partitionBy(*GROUP).orderBy("t", "o", "x")
    rows = rows.withColumn("at", F.row_number().over(inside) - 1 + F.col("skip"))
    pieces = rows.groupBy(*GROUP, "n", F.floor(F.col("at") / size).alias("part")).agg(
        F.min("at").alias("first"), F.count("*").alias("m"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]), "").alias("x")
    )
    done = F.col("m") == F.least(F.lit(size), F.col("n") - F.col("part") * size)
    rest = pieces.filter(~done).groupBy(*KEY, "n", "part").agg(F.sum("m").alias("m"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "x"))), lambda s: s["x"]), "").alias("x"))
    names = [*KEY, "n", "part", "m", "x"]
    out = pieces.filter(done).select(*names).unionByName(rest.select(*names))
    return out.select(F.when(~F.col("z"), F.col("c")).alias("conv_id"), F.col("part").cast("long"), F.col("n").alias("n_turns"), F.col("m").alias("part_turns"), F.col("x").alias("text"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, {LEAST}), substr(md5(concat(coalesce('r' || role, '-'), coalesce(chr(1) || 't' || text, '-'))), 1, 15)) AS pos,
    md5(concat(coalesce('r' || role, 'n'), chr(1), coalesce('t' || text, 'n'))) AS h FROM conversations),
p AS (SELECT conv_id, pos, md5(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS hp, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT min(conv_id) AS conv_id, n, hp FROM p WHERE pos = n GROUP BY n, hp),
k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = w.n AND p.hp = w.hp))
SELECT k.conv_id, (pos - 1) // {PART} AS part, k.n AS n_turns, count(*) AS part_turns,
  string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM k JOIN t ON k.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY k.conv_id, k.n, (pos - 1) // {PART}
"""
