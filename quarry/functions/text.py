"""Scalar functions on text, dates and keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All that counts as white space, not only ASCII.
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same as characters.
BLANKS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Months by the first three letters of their names.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
#: Titles of sections that are left out with all below them.
SKIPPED = ["references", "reference", "acknowledgements", "acknowledgments", "funding", "conflict of interest", "competing interests", "supplementary", "appendix", "author contributions"]
#: Fixed value: the name space of point ids (that of DNS names).
NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def skipped_section(title: Column) -> Column:
    return strip(F.lower(F.coalesce(title, F.lit("")))).isin(SKIPPED)


def slug(c: Column) -> Column:
    return F.substring(F.replace(F.lower(c), F.lit(" "), F.lit("_")), 1, 30)


def uuid5(name: Column) -> Column:
    """The name-based UUID of version 5 in the fixed name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_HEX)), F.encode(name, "utf-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def point_id(pmcid: Column, kind: Column, section: Column, index: Column) -> Column:
    return uuid5(F.concat_ws("_", pmcid.cast("string"), kind, slug(section), index.cast("string")))


def pub_date(year: Column, month: Column, day: Column) -> Column:
    """A date, its day at most 28; null without a year, a month that can be told, or a real date; day 1 if none is told."""
    y, m, d = (strip(F.coalesce(c, F.lit(""))) for c in (year, month, day))
    named = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    number = F.when(m.rlike(r"^\d{1,2}$"), m.try_cast("int")).otherwise(F.try_element_at(named, F.lower(F.substring(m, 1, 3))))
    dd = F.when(d.rlike(r"^\d{1,2}$"), F.least(d.try_cast("int"), F.lit(28))).otherwise(F.lit(1))
    ok = y.rlike(r"^\d{1,4}$") & number.between(1, 12) & dd.between(1, 28) & (y.try_cast("int") > 0)
    return F.when(ok, F.make_date(y.try_cast("int"), number, dd))


def strip_numbering(c: Column) -> Column:
    return F.regexp_replace(c, r"^\d+[\.\s]*", "")


def words_in(c: Column) -> Column:
    t = collapse(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def garbage(c: Column) -> Column:
    """A short text with many semicolons, or with joined words and few blanks."""
    semicolons = F.length(c) - F.length(F.replace(c, F.lit(";"), F.lit("")))
    return (F.length(c) <= 400) & ((semicolons > 3) | (c.rlike("[a-z][A-Z][a-z]") & (words_in(c) < 5)))


def author(fore: Column, last: Column) -> Column:
    return F.when(F.coalesce(last, F.lit("")) != "", strip(F.concat_ws(" ", F.coalesce(fore, F.lit("")), last)))


def unfenced(c: Column) -> Column:
    """A model's answer without the code fence around it."""
    return strip(F.regexp_replace(strip(c), r"^```(json)?|```$", ""))


def digits_only(c: Column) -> Column:
    return c.rlike(r"^\d+$")


def sentences(c: Column) -> Column:
    return F.split(c, f"(?<=[.!?]){WS}+")
