"""Records and keyed tables: validity, projection, upserts, lookups, membership and status logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import blank_to_null, point_id, pub_date, strip
from quarry.sources.shared import written

#: Article types that are left out.
EXCLUDED_TYPES = ["Erratum", "Published Erratum", "Retraction of Publication"]


def unused(columns: list[str], name: str) -> str:
    """name, or with as many more underscores before it as it takes to be none of columns."""
    while name.lower() in (c.lower() for c in columns):
        name = f"_{name}"
    return name


def validity() -> Column:
    """The first rule that a raw record fails, or `valid`: no pmid, an excluded type, a blank title."""
    return (
        F.when(F.coalesce("no_pubmed_record", F.lit(False)) | F.col("pmid").isNull(), "no_pmid")
        .when(F.arrays_overlap(F.coalesce("article_types", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in EXCLUDED_TYPES])), "article_types_invalid")
        .when(strip(F.coalesce("title", F.lit(""))) == "", "no_title")
        .otherwise("valid")
    )


def papers(raw: DataFrame) -> DataFrame:
    """Rows of the papers table from valid raw records; blank strings are null, and the abstract is kept."""
    text = [blank_to_null(F.col(c)).alias(c) for c in ("pmid", "doi", "title", "journal", "pub_year", "pub_month", "pub_day", "abstract")]
    return raw.filter(validity() == "valid").select("pmcid", *text, "authors", "keywords", "article_types", pub_date(F.col("pub_year"), F.col("pub_month"), F.col("pub_day")).alias("pub_date"))


def latest(rows: DataFrame, key: str, *version: str) -> DataFrame:
    """Last writer wins: of each key the row with the greatest version. Summed in part before the shuffle, so a hot key is one row per task."""
    rest = [c for c in rows.columns if c != key and c not in version]
    return rows.groupBy(key).agg(F.max(F.struct(*version, *rest)).alias("x")).select(key, "x.*")


def last(rows: DataFrame, key: str, version: tuple[str, ...] = ()) -> DataFrame:
    """One row of each key, that with the greatest version (of equal ones the greatest row); a null key is a key like any other."""
    if not version:
        return latest(rows, key, *[c for c in rows.columns if c != key][:1]) if len(rows.columns) > 1 else rows.distinct()
    return latest(rows, key, *version)


def upsert(old: DataFrame, new: DataFrame, key: str, version: tuple[str, ...] = ()) -> DataFrame:
    """old with every row of new put in place of old's rows of that key, or added; of repeated new keys the last writer's.

    version: columns of new that tell who wrote last; they are left out of the result if old does not have them. Null keys
    replace null keys.
    """
    rows = last(new, key, version).select(old.columns)
    return matching(old, rows, key, "left_anti").unionByName(rows)


def matching(old: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """old's rows with (left_semi) or without (left_anti) one of these keys; null is a key like any other."""
    own = unused(old.columns, "__key")
    return old.join(keys.select(F.col(key).alias(own)), F.col(key).eqNullSafe(F.col(own)), how)


def lookup(rows: DataFrame, papers: DataFrame, key: str, columns: list[str], version: tuple[str, ...] = ()) -> DataFrame:
    """rows with columns of papers, by the last row of a key; what is missing is an empty string. The side that is small is broadcast by size, not by name."""
    one = last(papers.select(key, *dict.fromkeys([*columns, *version])), key, version).select(key, *columns)
    found = rows.join(one, key, "left")
    return found.select(*rows.columns, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def backfill(rows: DataFrame, newer: DataFrame, key: str, column: str, version: tuple[str, ...] = ()) -> DataFrame:
    """rows with `column` from the last row of newer that has the key and a value, else as it was; a blank key takes nothing."""
    known = newer.filter(F.col(column).isNotNull() & (strip(F.col(key).cast("string")) != ""))
    own = unused(rows.columns, "__new")
    got = last(known.select(key, *dict.fromkeys([column, *version])), key, version).select(key, F.col(column).alias(own))
    return rows.join(got, key, "left").withColumn(column, F.coalesce(own, column)).drop(own)


def update_groups(rows: DataFrame, key: str, values: list[str], most: int = 500) -> DataFrame:
    """Updates batched by what they set: (values..., part, keys), the keys that get equal values in sorted lists of at most `most`.

    A key is dealt to a part by a hash, as many parts as the group's size asks for, so no list grows with the table.
    """
    # eqNullSafe on the values, so that rows that set a null are a group too.
    own = unused(rows.columns, "__n")
    sizes = rows.groupBy(*values).agg(F.count("*").alias(own))
    same = None
    for v in values:
        one = F.col(f"r.{v}").eqNullSafe(F.col(f"s.{v}"))
        same = one if same is None else same & one
    dealt = rows.alias("r").join(sizes.alias("s"), same).select("r.*", F.pmod(F.xxhash64(F.col(f"r.{key}")), F.ceil(F.col(own) * 2 / most)).alias("part"))
    lists = dealt.groupBy(*values, "part").agg(F.array_sort(F.collect_set(key)).alias("keys"))
    return lists.select(*values, "part", "keys")


def points(chunks: DataFrame, stored: bool = False) -> DataFrame:
    """Vector rows from chunks (pmcid, source_type, section, chunk_index, dense, sparse, seq): incomplete ones dropped, of equal ids the last.

    stored: chunks are a table, so reading it again is cheap. Then ids alone are shuffled to find those that repeat, which are
    written, so that their true size decides how they meet the rows; texts and vectors are shuffled for these ids only.
    """
    ready = chunks.filter(F.col("dense").isNotNull() & F.col("sparse").isNotNull())
    ident = point_id(F.col("pmcid"), F.col("source_type"), F.col("section"), F.col("chunk_index"))
    rows = ready.withColumn("id", ident)
    if not stored:
        return latest(rows, "id", "seq")
    repeated = written(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
    last_ones = latest(rows.join(repeated, "id", "left_semi"), "id", "seq")
    return last_ones.unionByName(rows.join(repeated, "id", "left_anti"))


def states(log: DataFrame, key: str, status: str, *version: str) -> DataFrame:
    """(key, status): the latest entry of an append-only log."""
    return log.groupBy(key).agg(F.max(F.struct(*version, status)).alias("x")).select(key, F.col(f"x.{status}").alias("status"))


def failed(rows: DataFrame, key: str, *vectors: str) -> DataFrame:
    """The distinct keys of rows that lack one of their vectors: what is to be done again."""
    lacking = None
    for v in vectors:
        lacking = F.col(v).isNull() if lacking is None else lacking | F.col(v).isNull()
    return rows.filter(lacking).select(key).distinct()


def pending(keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return keys.join(done.select(key), key, "left_anti")


def move(status: DataFrame, key: str, moved: DataFrame, to: str) -> DataFrame:
    """status (key, status) with the keys of moved set to `to`."""
    own = unused(status.columns, "__hit")
    hit = moved.select(key).distinct().withColumn(own, F.lit(True))
    return status.join(hit, key, "left").withColumn("status", F.when(F.col(own), to).otherwise(F.col("status"))).drop(own)
