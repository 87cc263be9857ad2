"""Markup to records: full-text XML to paragraphs, PubMed XML to metadata, web pages to paragraphs, reasons of failure.

XML trees have mixed content that column functions cannot express, so these parse a batch of documents in Python; one
document that cannot be parsed gives an empty result or a reason, never a failed task.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quarry.functions.text import SKIPPED

MIN_TEXT = 20
PARAGRAPHS = "array<struct<section: string, text: string, type: string>>"
CAPTION_OF = {"table-wrap": "table_caption", "fig": "figure_caption"}


def tag_of(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def text_of(node: ET.Element) -> str:
    return " ".join("".join(node.itertext()).split())


class Walker:
    """Collects (section, text, type) from the parts of a body, in the order in which they are met."""

    def __init__(self) -> None:
        self.found: list[tuple[str, str, str]] = []

    def add(self, section: str, text: str, kind: str) -> None:
        if len(text) >= MIN_TEXT:
            self.found.append((section, text, kind))

    def caption(self, node: ET.Element, section: str) -> None:
        own = node.find("caption")
        if own is not None:
            self.add(section, text_of(own), CAPTION_OF[tag_of(node)])

    def paragraph(self, node: ET.Element, section: str) -> None:
        lists = [c for c in node if tag_of(c) == "list"]
        # Beside an inner list only the text before the first child counts.
        self.add(section, (node.text or "").strip() if lists else text_of(node), "paragraph")
        for c in lists:
            self.listed(c, section)

    def listed(self, node: ET.Element, section: str) -> None:
        for item in (c for c in node if tag_of(c) == "list-item"):
            own, below = Walker(), Walker()
            for c in item:
                if tag_of(c) == "p":
                    own.paragraph(c, section)
                elif tag_of(c) == "list":
                    below.listed(c, section)
            self.add(section, " ".join(t for _, t, _ in own.found), "paragraph")
            self.found += below.found

    def section(self, node: ET.Element, above: str) -> None:
        title = node.find("title")
        name = (text_of(title) if title is not None else "") or above
        if name.lower().strip() in SKIPPED:
            return
        self.children(node, name)

    def children(self, node: ET.Element, name: str, top: bool = False) -> None:
        for c in node:
            kind = tag_of(c)
            if kind == "sec":
                self.section(c, "" if top else name)
            elif kind == "p":
                self.paragraph(c, name)
            elif kind == "list":
                self.listed(c, name)
            elif kind in CAPTION_OF:
                self.caption(c, name)


def parse_fulltext(xml: str | None) -> list[tuple[str, str, str]]:
    """Paragraphs of the first body (one without a name space); none if the text is not well-formed or has no body."""
    try:
        body = ET.fromstring(xml or "").find(".//body")
    except ET.ParseError:
        return []
    walker = Walker()
    if body is not None:
        walker.children(body, "body", top=True)
    return walker.found


def diagnose(xml: str | None) -> str:
    """Why a full text gave no paragraph."""
    if xml is None:
        return "missing file"
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return "malformed"
    body = root.find(".//body")
    if body is None:
        return "namespaced body" if any(tag_of(x) == "body" for x in root.iter()) else "no body"
    tags = {tag_of(x) for x in body.iter()}
    if not tags & {"sec", "p"}:
        return "neither sec nor p"
    return "p without sec" if "sec" not in tags else "other"


def own_pmid(xml: str | None) -> str | None:
    """The first non-empty pmid in a full text's own metadata. A text without the word, and without a reference that could spell it, is not parsed."""
    if not xml or ("pmid" not in xml and "&" not in xml):
        return None
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    ids = ((e.text or "").strip() for e in root.iterfind(".//article-meta/article-id[@pub-id-type='pmid']"))
    return next(filter(None, ids), None)


def whole_text(node: ET.Element | None) -> str:
    return "" if node is None else "".join(node.itertext()).strip()


def labelled(node: ET.Element) -> str:
    text, label = whole_text(node), node.get("Label", "")
    return f"{label}: {text}" if text and label else text


def person(node: ET.Element) -> str:
    last = whole_text(node.find("LastName"))
    return f"{whole_text(node.find('ForeName'))} {last}".strip() if last else ""


def first_of(*paths: str):
    """The first of several places that has a text."""
    return lambda article: next((t for p in paths if (t := whole_text(article.find(p)))), "")


def all_of(path: str, read):
    return lambda article: [t for node in article.iterfind(path) if (t := read(node))]


#: A metadata record, field by field: how each is read from an article.
FIELDS = {
    "doi": lambda article: (all_of(".//ArticleId[@IdType='doi']", lambda n: (n.text or "").strip() or " ")(article) or [""])[0].strip(),
    "title": first_of(".//ArticleTitle"),
    "abstract": lambda article: "\n".join(all_of(".//AbstractText", labelled)(article)),
    "authors": all_of(".//Author", person),
    "journal": first_of(".//Journal/Title"),
    "pub_year": first_of(".//PubDate/Year", ".//ArticleDate/Year"),
    "pub_month": first_of(".//PubDate/Month", ".//ArticleDate/Month"),
    "pub_day": first_of(".//PubDate/Day", ".//ArticleDate/Day"),
    "keywords": all_of(".//Keyword", lambda n: (n.text or "").strip()),
    "article_types": all_of(".//PublicationType", lambda n: n.text),
}
RECORD = ", ".join(f"{f} {'array<string>' if f in ('authors', 'keywords', 'article_types') else 'string'}" for f in (*FIELDS, "parse_error"))


def parse_pubmed(xml: str | None) -> dict:
    """A metadata record; `parse_error` alone if there is none to be read."""
    try:
        article = ET.fromstring(xml or "").find(".//PubmedArticle")
    except ET.ParseError as e:
        return {"parse_error": str(e)}
    return {"parse_error": "no article"} if article is None else {f: read(article) for f, read in FIELDS.items()} | {"parse_error": None}


class PageText(HTMLParser):
    """Paragraphs of a web page under their latest heading; scripts, styles and navigation are left out."""

    BLOCKS = {"p", "h1", "h2", "h3", "h4", "div", "article", "section", "li", "ul", "body", "html", "br", "td", "table", "footer", "header"}
    SILENT = {"script", "style", "nav", "head", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str]] = []
        self.section, self.held, self.heading, self.silent = "body", [], False, 0

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if self.heading:
            self.section, self.heading = text or self.section, False
        elif len(text) >= MIN_TEXT:
            self.found.append((self.section, text, "paragraph"))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in self.SILENT
        if tag in self.BLOCKS:
            self.flush()
            self.heading = tag[0] == "h" and tag[1:].isdigit()

    def handle_endtag(self, tag: str) -> None:
        self.silent = max(0, self.silent - (tag in self.SILENT))
        if tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.held.append(data)


def parse_page(html: str | None) -> list[tuple[str, str, str]]:
    parser = PageText()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.found


#: Documents that a task parses at once; what is made of them is passed on before the next are read.
SLICE = 128


def sliced(convert, schema: str, size: int = SLICE):
    """An Arrow UDF of one column: convert takes some `size` values of it as a list and gives as many results. Evaluated once for each row.

    A batch as Spark sends it (10,000 rows) is held as Arrow alone; Python values and results are those of one slice.
    """
    kind = to_arrow_type(DataType.fromDDL(schema))

    @F.arrow_udf(schema)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            for at in range(0, len(values), size):
                yield pa.array(convert(values.slice(at, size).to_pylist()), kind)

    return apply.asNondeterministic()


def column(parse, schema: str):
    """A UDF that applies parse to each text."""
    if schema == PARAGRAPHS:
        return sliced(lambda texts: [[dict(zip(("section", "text", "type"), p, strict=True)) for p in parse(x)] for x in texts], schema)
    if schema == RECORD:
        schema = f"struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in RECORD.split(', ')))}>"
    return sliced(lambda texts: [parse(x) for x in texts], schema)


def paragraphs(docs: DataFrame, text: str = "xml", parse=parse_fulltext) -> DataFrame:
    """docs with `paragraphs` in place of its markup."""
    return docs.withColumn("paragraphs", column(parse, PARAGRAPHS)(F.col(text))).drop(text)


def exploded(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in docs.columns if c != "paragraphs"], F.posexplode("paragraphs").alias("pos", "p")).select("*", "p.*").drop("p")


def pmid_of(xml: str) -> Column:
    """The first non-empty pmid in a full text's own metadata."""
    ids = F.filter(F.expr(f"xpath({xml}, \"//article-meta/article-id[@pub-id-type='pmid']/text()\")"), lambda x: F.trim(x) != "")
    return F.trim(F.try_element_at(ids, F.lit(1)))
