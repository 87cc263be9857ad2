"""License scan: exact places of base phrases, and a fuzzy search for further short notices.

A text is lower-cased (A-Z) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; joined by single blanks they are what
is searched. Base phrases count at every place where their words stand consecutively. A notice is a phrase, its label, the
most edits k, its telling words (those that tell it from other notices), and what may not follow it. The phrase is split into
k + 1 pieces; by the pigeonhole principle one of them occurs unchanged in any match, so exact search for the pieces finds
every candidate window, and the regex library's bounded-error matching then verifies the edits and gives the span. Numbers
stand as they are. A telling word must be matched by one whole word with errors of its own: two neighbouring letters that
are exchanged (two edits), or one edit, from nine letters on two; a word of up to three letters takes no letter more at its ends,
so `smit` is not `mit`. What lies between may have any of the k edits. A match starts and ends at whole words. Of matches that
overlap the longer notice's stays, of one notice's the one with fewer edits. Nothing caps the number of candidates.

Notices are a table and a parameter of `with_notices` and `Scanner`; `notices_of` reads one from a DataFrame.

Defined cases: a null text is empty, and an empty text has no words, places or labels and scores 0; repeated rows are
judged alike; `with_notices` keeps further columns, and its own takes the place of one of the same name. Time is linear in
the text plus the candidates, each of which has a window of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, utf8


class Notice(NamedTuple):
    phrase: str
    label: str
    edits: int
    fixed: tuple[str, ...]
    #: A pattern of words right after a match that make it another notice; none if empty.
    unless: str = ""


#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that are searched with errors.
NOTICES = [
    Notice("under the mit license", "mit", 2, ("mit",)),
    Notice("permission is hereby granted free of charge", "mit", 4, ("permission", "free", "charge")),
    Notice("apache license version 2", "apache-2", 2, ("apache", "2"), "[1-9]"),
    Notice("licensed under the apache license", "apache-2", 3, ("apache",), "(?:version |v )?(?:1|[3-9])|version [^0-9]"),
    Notice("gnu general public license", "gpl", 3, ("gnu", "general", "public")),
    Notice("gnu lesser general public license", "lgpl", 3, ("gnu", "lesser", "general", "public")),
    Notice("gnu library general public license", "lgpl", 3, ("gnu", "library", "general", "public")),
    Notice("gnu affero general public license", "agpl", 3, ("gnu", "affero", "general", "public")),
    Notice("mozilla public license", "mpl", 2, ("mozilla", "public")),
    Notice("eclipse public license", "epl", 2, ("eclipse", "public")),
    Notice("redistribution and use in source and binary forms", "bsd", 4, ("redistribution", "source", "binary")),
    Notice("creative commons attribution", "cc-by", 3, ("commons", "attribution")),
    Notice("creative commons attribution sharealike", "cc-by-sa", 3, ("commons", "attribution", "sharealike")),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 3, ("commons", "attribution", "noncommercial")),
    Notice("released into the public domain", "public-domain", 3, ("public", "domain")),
    Notice("boost software license", "bsl", 2, ("boost", "software")),
    Notice("all rights reserved", "all-rights-reserved", 2, ("rights",)),
]
#: How many judged windows a scanner remembers.
KNOWN = 50_000


def notices_of(table: DataFrame) -> list[Notice]:
    """Notices from a table (phrase string, label string, edits int, fixed array<string>, unless string): a list of phrases, so small."""
    return [Notice(r.phrase, r.label, r.edits, tuple(r.fixed or ()), r.unless or "") for r in table.orderBy("phrase", "label").toLocalIterator()]


def pieces(phrase: str, k: int) -> list[tuple[int, bytes]]:
    """(start, piece) of k + 1 pieces of about equal length."""
    cut = [len(phrase) * i // (k + 1) for i in range(k + 2)]
    return [(a, phrase[a:b].encode()) for a, b in zip(cut, cut[1:], strict=False)]


def exchanged(word: str) -> list[str]:
    """The word with two neighbouring letters exchanged, in all ways that change it."""
    return sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})


def telling(word: str, number: int) -> str:
    """A pattern for a telling word: one whole word with the errors that it may have. What the library can't count has a group whose name tells its edits."""
    if word.isdigit():
        return f"(?<= ){word}(?= )"
    swaps = "|".join(map(regex.escape, exchanged(word)))
    # Kinds of edits that aren't named may not occur, once one is.
    errors = "s<=1,d<=1,e<=1" if len(word) < 4 else "e<=2" if len(word) >= 9 else "e<=1"
    ways = [f"(?:{regex.escape(word)}){{{errors}:[^ ]}}"]
    if len(word) < 4:
        ways.append(f"(?P<one{number}>{'|'.join(f'{regex.escape(word[:i])}[^ ]{regex.escape(word[i:])}' for i in range(1, len(word)))})")
    return f"(?<= )(?:{'|'.join(ways + ([f'(?P<two{number}>{swaps})'] if swaps else []))})(?= )"


def pattern_of(n: Notice) -> regex.Pattern:
    """The phrase with its numbers as they are, its telling words with errors of their own, and up to `edits` errors in each stretch between them."""
    words = n.phrase.split(" ")
    parts, held = [], ""
    fuzzy = lambda x: f"(?:{regex.escape(x, literal_spaces=True)}){{e<={n.edits}}}" if x.strip() else x
    for i, word in enumerate(words):
        held += " " if i else ""
        if word in n.fixed or word.isdigit():
            parts += [fuzzy(held), telling(word, i)]
            held = ""
        else:
            held += word
    text = f"(?b)(?<= )(?:{''.join(parts)}{fuzzy(held)})(?= )"
    return regex.compile(text.encode())


def edits_of(m: regex.Match) -> int:
    return sum(m.fuzzy_counts) + sum({"one": 1, "two": 2}[name[:3]] for name, g in m.groupdict().items() if g is not None)


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: list[Notice] = NOTICES):
        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        # Bytes are what is searched; an edit is a byte of an ASCII word or of a longer character. Longer notices come first.
        self.notices = [(n, pieces(n.phrase, n.edits), pattern_of(n)) for n in sorted(notices, key=lambda n: (-len(n.phrase), n.phrase))]
        self.known: dict = {}

    def best(self, notice: Notice, pattern: regex.Pattern, window: bytes) -> tuple[int, int, int] | None:
        """(edits, start, end) of a window's best match, if any. Texts repeat themselves, so windows already judged are remembered."""
        if (pattern, window) not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            m = pattern.search(window)
            ok = m and edits_of(m) <= notice.edits
            # What may not follow is looked for after the best match: within the pattern, a worse match would reach over it.
            if ok and notice.unless and regex.match(f" (?:{notice.unless})".encode(), window, pos=m.end()):
                ok = False
            self.known[pattern, window] = (edits_of(m), m.start(), m.end()) if ok else None
        return self.known[pattern, window]

    @staticmethod
    def normal(text: str | None) -> tuple[bytes, int]:
        words = utf8(text).translate(WORD_BYTES).split()
        return b" " + b" ".join(words) + b" ", len(words)

    def places(self, text: bytes) -> list[tuple[int, str]]:
        """(first word, label) of every place of a base phrase in a normal text, overlapping ones too."""
        out = []
        for phrase, label in self.base:
            at, counted, word = text.find(phrase), 0, 0
            while at >= 0:
                word += text.count(b" ", counted, at)
                out.append((word, label))
                counted, at = at, text.find(phrase, at + 1)
        return sorted(out)

    def matches_of(self, text: bytes, notice: Notice, parts: list[tuple[int, bytes]], pattern: regex.Pattern) -> list[tuple[int, int, int]]:
        """(edits, start byte, end byte) of one notice's matches, by start; of overlapping ones the better."""
        k, kept = notice.edits, []
        if not all(w.encode() in text for w in notice.fixed if w.isdigit()):
            return kept
        # Each candidate has a window of its own: a best match over merged windows takes the square of their length.
        windows = set()
        for start, piece in parts:
            at = text.find(piece)
            while at >= 0:
                windows.add(at - start - k - 1)
                at = text.find(piece, at + 1)
        beyond = 24 if notice.unless else 1
        for at in sorted(windows):
            first = max(0, at)
            best = self.best(notice, pattern, text[first : max(0, at + len(notice.phrase) + 2 * k + 1 + beyond)])
            if best is None:
                continue
            now = (best[0], first + best[1], first + best[2])
            if not kept or now[1] >= kept[-1][2]:
                kept.append(now)
            elif now[0] < kept[-1][0]:
                kept[-1] = now
        return kept

    def matches(self, text: bytes) -> list[tuple[str, str, int, int, int]]:
        """(notice, label, edits, start byte, end byte) of every fuzzy match, by start. What overlaps a longer notice's is left out."""
        out, taken = [], np.zeros((0, 2), np.int64)
        for notice, parts, pattern in self.notices:
            found = self.matches_of(text, notice, parts, pattern)
            if not found:
                continue
            spans = np.array([f[1:] for f in found], np.int64)
            after = np.searchsorted(taken[:, 1], spans[:, 0], side="right")
            free = (after == len(taken)) | (np.append(taken[:, 0], 1 << 62)[after] >= spans[:, 1])
            out += [(notice.phrase, notice.label, *f) for f, ok in zip(found, free, strict=True) if ok]
            taken = np.concatenate([taken, spans[free]])
            taken = taken[np.argsort(taken[:, 0], kind="stable")]
        return sorted(out, key=lambda m: (m[3], m[0]))

    def spans(self, text: str | None) -> list[dict]:
        """Every fuzzy match of a text: notice, label, edits, first and last word, the matched words."""
        normal, _ = self.normal(text)
        blanks = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
        before = lambda x: int(np.searchsorted(blanks, x))
        return [{"notice": p, "label": label, "edits": e, "first_word": before(max(a, 1)) - 1 + (normal[a : a + 1] == b" "), "last_word": before(b - (normal[b - 1 : b] == b" ")) - 1, "matched": normal[a:b].decode("utf-8", "replace").strip()} for p, label, e, a, b in self.matches(normal)]

    def judge(self, text: str | None) -> tuple:
        normal, n = self.normal(text)
        places = self.places(normal)
        base = {label for _, label in places}
        labels, score = set(base), 1.0 if places else 0.0
        for phrase, label, edits, _, _ in self.matches(normal):
            labels.add(label)
            score = max(score, 1 - edits / len(phrase))
        return n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score


JUDGED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def with_notices(docs: DataFrame, scanner: Scanner | None = None, name: str = "notices") -> DataFrame:
    """docs with one more column, what the scanner says of its text."""

    @F.pandas_udf(JUDGED)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = scanner or Scanner()
        for texts in batches:
            out = pd.DataFrame([own.judge(t) for t in texts], columns=[x.split()[0] for x in JUDGED.split(", ")])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.drop(name).withColumn(name, judge.asNondeterministic()(F.col("text")))


def op7_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_notices(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "notices.*")
