"""Chunks of documents: paragraphs of a section merged up to a limit, captions on their own, indices per section.

An ordered fold: a document's paragraphs come in as arrays and its chunks leave as one, a batch of documents at a time, in time
linear in the text (a fold of column functions copies its result at every step). Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quarry.functions.text import strip
from quarry.operators.markup import SLICE

MAX_CHARS, MIN_CHARS = 3200, 80  # a token is about four characters
CAPTIONS = ["table_caption", "figure_caption"]
CHUNKS = "array<struct<section: string, chunk_index: int, text: string>>"
SENTENCE = re.compile(r"(?<=[.!?])\s+")


class Packer:
    """Pieces joined by blanks as long as length + piece + 1 stays within limit; a longer piece stands alone."""

    def __init__(self, limit: int):
        self.limit, self.done, self.held, self.size = limit, [], [], 0

    def close(self) -> None:
        if self.size:
            self.done.append(" ".join(self.held))
        self.held, self.size = [], 0

    def add(self, piece: str) -> None:
        if self.size + len(piece) + 1 > self.limit:
            self.close()
        self.size += len(piece) + (1 if self.held else 0)
        self.held.append(piece)

    def paragraph(self, text: str) -> None:
        """One over the limit closes the chunk before it, and is cut at its sentences."""
        if len(text) <= self.limit:
            self.add(text)
            return
        self.close()
        for piece in SENTENCE.split(text):
            self.add(piece)
        self.close()


def fold(sections: list, texts: list, captions: list, limit: int, least: int) -> list[dict]:
    """Sections in the order in which they are first met, wherever their paragraphs stand; captions follow a section's chunks."""
    own: dict[str, tuple[Packer, list[str]]] = {}
    for section, text, caption in zip(sections, texts, captions, strict=True):
        text = text.strip() if text else ""
        if text:
            packer, below = own.setdefault("unknown" if section is None else section, (Packer(limit), []))
            below.append(text) if caption else packer.paragraph(text)
    out = []
    for section, (packer, below) in own.items():
        packer.close()
        kept = [t for t in (*packer.done, *below) if len(t) >= least]
        out += [{"section": section, "chunk_index": i, "text": t} for i, t in enumerate(kept)]
    return out


def chunked(paragraphs: Column, limit: int = MAX_CHARS, least: int = MIN_CHARS) -> Column:
    """The chunks (CHUNKS) of an array of paragraphs (section, text, type); null for null."""

    kind = to_arrow_type(DataType.fromDDL(CHUNKS))

    @F.arrow_udf(CHUNKS)
    def apply(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            for at in range(0, len(columns[0]), SLICE):
                some = zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)
                yield pa.array([None if s is None else fold(s, t, c, limit, least) for s, t, c in some], kind)

    part = lambda f: F.transform(paragraphs, f)
    return apply.asNondeterministic()(part(lambda p: p["section"]), part(lambda p: p["text"]), part(lambda p: F.coalesce(p["type"].isin(CAPTIONS), F.lit(False))))


def chunks(docs: DataFrame, limit: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    """(pmcid, source_type, section, chunk_index, text) of docs (pmcid, paragraphs array<struct<section, text, type>>).

    Sections with equal titles are one; captions follow a section's chunks in its count; what is shorter than `least` is
    dropped before it is counted.
    """
    out = docs.select("pmcid", F.explode(chunked(F.col("paragraphs"), limit, least)).alias("c"))
    return out.select("pmcid", F.lit("fulltext").alias("source_type"), "c.*")


def abstract_chunks(papers: DataFrame) -> DataFrame:
    """One chunk for each paper (pmcid, abstract) whose abstract is not blank."""
    text = strip(F.coalesce("abstract", F.lit("")))
    return papers.select("pmcid", F.lit("abstract").alias("source_type"), F.lit("abstract").alias("section"), F.lit(0).alias("chunk_index"), text.alias("text")).filter("text <> ''")
