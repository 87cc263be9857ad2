"""Notices against a naive scan: base places word by word, fuzzy matches by an edit distance with fixed words."""

import random
import re

import pytest

from quarry.llm import notices
from quarry.llm.notices import Notice, Scanner

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("released under the mpl license", ""),
        ("Apache License, Version 1.1", ""),
        ("licensed under the apache license version 1.1", ""),
        ("licensed under the apache license 1.0", ""),
        ("licensed under the Apache License, Version 2.0", "apache-2"),
        ("licenced under the apache licence", "apache-2"),
        ("gnu lesser general public license", "lgpl"),
        ("gnu affero general public license", "agpl"),
        ("gnu general public lisence", "gpl"),
        ("creative commons attribution sharealike", "cc-by-sa"),
        ("Creative Comons attribution", "cc-by"),
        ("creatve commons attribution", "cc-by"),
        ("submitted under the mit license", "mit"),
        ("under the permit license", ""),
        ("under the mit licenses", "mit"),
        ("unreserved rights of all", ""),
        ("under the smit license", ""),
        ("under the mti license", "mit"),
        ("licensed under the apahce license", "apache-2"),
        ("permision is hereby granted free of charge", "mit"),
        ("redistribution and use in sorce and binary forms", "bsd"),
        ("gnu genral public license", "gpl"),
        ("mozila public license", "mpl"),
        ("gnu leser general public license", "lgpl"),
        ("the commons attributed their public domain", ""),
        ("general public notice of a license", ""),
        ("redistribution of sources is binary", ""),
    ],
)
def test_labels(text, labels):
    assert Scanner().judge(text)[5] == labels


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y))
    return row[-1]


def word_edits(word, other):
    """The edits with which a telling word is matched by another; 99 if it isn't."""
    if word.isdigit() or word == other:
        return 0 if word == other else 99
    d, ways = distance(word, other), []
    inner = len(word) < 4 and len(other) == len(word) + 1 and other[0] == word[0] and other[-1] == word[-1] and d == 1
    if d <= (2 if len(word) >= 9 else 1) and (len(word) >= 4 or len(other) <= len(word) or inner):
        ways.append(d)
    if any(word[:i] + word[i + 1] + word[i] + word[i + 2 :] == other for i in range(len(word) - 1)):
        ways.append(2)
    return min(ways, default=99)


def allowed(phrase, fixed, text, k):
    """Whether text, whole words, is phrase with at most k edits: telling words and numbers by one word each, what is between by anything."""
    words, run = phrase.split(" "), text.split(" ")
    told = [i for i, w in enumerate(words) if w in fixed or w.isdigit()]

    def stretch(a, b, x, y):
        """Edits between words a to b and the run's x to y, with the blanks to telling words around."""
        left, right = " " if a else "", " " if b < len(words) else ""
        one, other = " ".join(words[a:b]), " ".join(run[x:y])
        one = left + one + right if b > a else (" " if a and b < len(words) else "")
        other = (left if x else "") + other + (right if y < len(run) else "") if y > x else (" " if x and y < len(run) else "")
        return distance(one, other) if b > a else (0 if one == other else 99)

    def least(n, at, x):
        a = told[n - 1] + 1 if n else 0
        if n == len(told):
            return stretch(a, len(words), x, len(run))
        best = 99
        for y in range(x, len(run)):
            e = word_edits(words[told[n]], run[y])
            if e <= k and (s := stretch(a, told[n], x, y)) <= k:
                best = min(best, e + s + least(n + 1, at, y + 1))
        return best

    return least(0, 0, 0) <= k


def changed(rng, phrase):
    out = list(phrase)
    for _ in range(rng.randrange(6)):
        i = rng.randrange(len(out))
        op = rng.randrange(4)
        if op == 0:
            out[i] = rng.choice("abcdefghij kl")
        elif op == 1:
            out.insert(i, rng.choice("abcde f"))
        elif op == 2 and len(out) > 1:
            del out[i]
    return "".join(out)


def test_fuzzy_matches_against_a_naive_scan():
    """For every notice: found exactly if some run of whole words of the text is allowed."""
    rng, scanner = random.Random(11), Scanner()
    seen = [0, 0]
    for _ in range(350):
        n, parts, pattern = rng.choice(scanner.notices)
        text = " ".join(["some", changed(rng, n.phrase), rng.choice(["words", "", "of mit", "2"]), rng.choice(["", "other"])])
        normal, _ = scanner.normal(text)
        words = normal.decode().split()
        runs = [" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)]
        want = any(allowed(n.phrase, n.fixed, r, n.edits) for r in runs if abs(len(r) - len(n.phrase)) <= n.edits)
        got = bool(scanner.matches_of(normal, n._replace(unless=""), parts, pattern))
        assert got == want, (n.phrase, text)
        seen[got] += 1
    assert min(seen) > 60


def test_spans_lie_where_the_words_are():
    text = "It is Licenced under the Apache licence; all rights reservd. CC BY NC"
    words = WORD.findall(text.translate(LOWER))
    for s in Scanner().spans(text):
        assert " ".join(words[s["first_word"] : s["last_word"] + 1]) == s["matched"]


def test_base_places_against_a_naive_scan(spark):
    rng = random.Random(5)
    pool = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "Straße", "MIT"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(400))) for _ in range(120)] + ["cc by nc " * 500, None, "", "!!"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.notices for r in notices.with_notices(frame).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").translate(LOWER))
        places = [(a, label) for p, label in notices.BASE.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        first, last = (min(places)[0], max(places)[0]) if places else (None, None)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), first, last, ",".join(sorted({x for _, x in places})))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_notices_from_a_table(spark):
    table = spark.createDataFrame([("house style licence", "house", 2, ["house"], None)], "phrase string, label string, edits int, fixed array<string>, unless string")
    scanner = Scanner({}, notices.notices_of(table))
    assert scanner.notices[0][0] == Notice("house style licence", "house", 2, ("house",))
    frame = spark.createDataFrame([(1, "The house stile license", 5)], "doc_id long, text string, notices int")
    assert notices.with_notices(frame, scanner).first().notices.labels == "house"


def test_recall_of_planted_edits():
    """One edit in one word of a notice: nearly all are found; texts without notices have no label."""
    rng, scanner = random.Random(3), Scanner()
    for n in notices.NOTICES:
        found = 0
        for _ in range(200):
            words = n.phrase.split(" ")
            i = rng.choice([i for i, w in enumerate(words) if not w.isdigit()])
            w = words[i]
            j, c = rng.randrange(len(w)), rng.choice("abcdefghijklmnopqrstuvwxyz")
            words[i] = [w[:j] + w[j + 1 :], w[:j] + c + w[j + 1 :], w[:j] + c + w[j:], w[:j] + w[j + 1 : j + 2] + w[j] + w[j + 2 :]][rng.randrange(4)]
            found += n.label in scanner.judge(f"some text {' '.join(words)} and more")[5].split(",")
        assert found >= 0.95 * 200, n.phrase
    pool = "the a public domain general license rights free of in use and version software is granted mit source to by all forms".split()
    near = sum(bool(scanner.matches(scanner.normal(" ".join(rng.choice(pool) for _ in range(30)))[0])) for _ in range(2000))
    assert near <= 2
