"""Session memory, contexts and summaries of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.text import strip

NOTHING = "（无内容）"  # fixed value: what an empty transcript says


def recent(messages: DataFrame, n: int = 3) -> DataFrame:
    """The last n messages of each conversation (conv_id, turn, role, text)."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").desc(), F.col("role").desc(), F.col("text").desc())
    return messages.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).drop("r")


def transcripts(messages: DataFrame, keep: int = 3, each: int = 2000, total: int = 12000) -> DataFrame:
    """(conv_id, transcript): all but the last `keep` messages as `[role]: text` lines, cut to `total` characters.

    Lines that start beyond the cut (the line feed before one that starts at it still counts) are dropped before any list is made, so a list holds `total` characters at most.
    """
    by = W.partitionBy("conv_id")
    order = by.orderBy("turn", "role", "text")
    ranked = messages.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(by)}).filter(F.col("i") <= F.col("n") - keep)
    text = strip(F.coalesce("text", F.lit("")))
    lines = ranked.filter(text != "").select("conv_id", "i", F.concat(F.lit("["), F.coalesce("role", F.lit("unknown")), F.lit("]: "), F.substring(text, 1, each)).alias("line"))
    start = F.coalesce(F.sum(F.length("line") + 1).over(by.orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    some = lines.withColumn("start", start).filter(F.col("start") <= total)
    joined = some.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    out = joined.select("conv_id", F.substring(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 1, total).alias("transcript"))
    return messages.select("conv_id").distinct().join(out, "conv_id", "left").select("conv_id", F.coalesce("transcript", F.lit(NOTHING)).alias("transcript"))


def context(hits: DataFrame, head: Column, most: int) -> DataFrame:
    """(qid, context): the first `most` hits of each query, each under its head, between rules. Lists hold `most` hits at most."""
    first = hits.filter(F.col("rank") < most).select("qid", "rank", F.concat(F.lit("["), head, F.lit("]\n"), F.coalesce("text", F.lit(""))).alias("x"))
    got = first.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "x"))).alias("l"))
    return got.select("qid", F.array_join(F.transform("l", lambda x: x["x"]), "\n\n---\n\n").alias("context"))


def label_summary(rows: DataFrame, key: str) -> DataFrame:
    """(key, total, valid, dominant, dominant_count) of rows (key, pos, label, error); a missing label is `unknown`, ties go to the first seen."""
    known = rows.withColumn("label", F.when(F.col("error").isNull(), F.coalesce("label", F.lit("unknown"))))
    each = known.groupBy(key, "label").agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    best = F.max(F.when(F.col("label").isNotNull(), F.struct(F.col("c"), (-F.col("p")).alias("p"), F.col("label"))))
    out = each.groupBy(key).agg(F.sum("c").alias("total"), F.sum(F.when(F.col("label").isNotNull(), F.col("c")).otherwise(0)).alias("valid"), best.alias("b"))
    return out.select(key, "total", "valid", F.col("b.label").alias("dominant"), F.coalesce("b.c", F.lit(0).cast("long")).alias("dominant_count"))


def sessions(messages: DataFrame, keep: int = 3) -> DataFrame:
    """(session_id, history): each conversation's last messages as JSON; a blank id is no session."""
    got = recent(messages, keep).filter(strip(F.col("conv_id").cast("string")) != "")
    item = F.struct("turn", "role", "text")
    return got.groupBy(strip(F.col("conv_id").cast("string")).alias("session_id")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("history"), F.count("*").alias("n_messages"))
