"""Language identification: words and scripts of real text, scores by a naive count, learning from repeated rows."""

import numpy as np
import pytest

from quarry.llm import langid as L


def words(text):
    w = L.Words([text])
    return [("".join(map(chr, w.bytes[a:b])), L.SCRIPTS[s]) for a, b, s in zip(w.start, w.end, w.script, strict=True)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("don’t “stop” – now…", [("don", "LATIN"), ("t", "LATIN"), ("stop", "LATIN"), ("now", "LATIN")]),
        ("Việt Nam", [("việt", "LATIN"), ("nam", "LATIN")]),
        ("Việt", [("việt", "LATIN")]),
        ("Python是最好的语言", [("python", "LATIN"), ("是最好的", "CJK"), ("语言", "CJK")]),
        ("สวัสดีครับ", [("สวัส", "THAI"), ("ดีคร", "THAI"), ("ับ", "THAI")]),
        ("ночьnight 12три", [("ночь", "CYRILLIC"), ("night", "LATIN"), ("три", "CYRILLIC")]),
        ("コーヒー を", [("コーヒー", "KATAKANA"), ("を", "HIRAGANA")]),
        ("😀 12   — ́ ½", []),
        ("ＡＢ ﬁn ª", [("ａｂ", "LATIN"), ("ﬁn", "LATIN"), ("ª", "OTHER")]),
    ],
)
def test_words_and_scripts(text, want):
    got = words(text)
    assert [x for x, _ in got] == [x for x, _ in want]
    assert all(s == t for (x, s), (_, t) in zip(got, want, strict=True) if x not in ("ﬁn", "ª"))


def test_places_lie_in_the_lowered_text():
    text = "İstanbul don’t 最好的语言x สวัสดี́!"
    w = L.Words([None, text, ""])
    low = text.lower()
    assert w.first.tolist()[:2] == [0, 0] and w.first[2] == w.first[3] == len(w.start)
    shift = w.bounds[1]
    assert [low[p - shift : p - shift + n] for p, n in zip(w.place, w.length, strict=True)] == [x for x, _ in words(text)]


def naive_score(word, table):
    """Sums of the n-grams of ` word ` that hold a letter."""
    text, out = f" {word} ", np.zeros(table.shape[1])
    for n in L.ORDERS:
        for i in range(len(text) - n + 1):
            gram = text[i : i + n]
            if not gram.strip() or (n == 1 and gram == " "):
                continue
            h = 0
            for c in gram:
                h = (h * 0x01000193 + ord(c) + 1) % (1 << 32)
            mixed = ((h ^ h >> 15) * 0x85EBCA6B) % (1 << 32)
            out += table[((mixed >> (32 - L.BITS)) ^ (n * 7919)) & (L.BUCKETS - 1)]
    return out


def test_word_scores_against_a_naive_sum():
    rng = np.random.default_rng(3)
    table = rng.normal(size=(L.BUCKETS, 3)).astype(np.float32)
    allowed = np.ones((len(L.SCRIPTS), 3), bool)
    allowed[L.SCRIPTS.index("CYRILLIC")] = [False, True, False]
    w = L.Words(["a größe don’t", None, "ночь最好的语言x1y", "z"])
    got = L.word_scores(w, table, allowed)
    text = ["a", "größe", "don", "t", "ночь", "最好的语", "言", "x", "y", "z"]
    assert ["".join(map(chr, w.bytes[a:b])) for a, b in zip(w.start, w.end, strict=True)] == text
    for word, row in zip(text, got, strict=True):
        want = naive_score(word, table) + (np.array([-1e4, 0, -1e4]) if word == "ночь" else 0)
        assert np.allclose(row, want, atol=1e-2)


@pytest.fixture(scope="module")
def model(spark):
    lines = {"en": "the cat sat on the mat and then it ran to the house with the dog", "fr": "le chat est sur la table et puis il court vers la maison avec le chien", "ru": "кошка сидит на столе а потом бежит домой вместе с собакой", "zh": "猫坐在垫子上然后它跑到房子里和狗在一起", "ja": "猫はマットの上に座ってそれから犬と一緒に家まで走りました"}
    rows = [(i * 5 + k, t, lang) for k, (lang, t) in enumerate(lines.items()) for i in range(6)]
    return L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")), lines


def test_spans_of_mixed_text(model):
    m, lines = model
    text = f"{lines['en']}. {lines['ru']} {lines['zh']}{lines['en']} {lines['ja']}"
    got = L.char_spans(text, m)
    assert [s["lang"] for s in got] == ["en", "ru", "zh", "en", "ja"]
    assert text[got[1]["start"] : got[1]["stop"]] == lines["ru"] and text[got[2]["start"] : got[2]["stop"]] == lines["zh"]
    assert L.label_texts(["!!", None, "12", lines["zh"]], m)[0] == ["und", "und", "und", "zh"]


def test_spans_as_a_column(spark, model):
    frame = spark.createDataFrame([(1, "the cat ran", "own"), (2, None, "own")], "doc_id long, text string, spans string")
    rows = {r.doc_id: r.spans for r in L.with_spans(frame, model[0]).collect()}
    assert [tuple(s) for s in rows[1]] == [(0, 11, "en")] and rows[2] == []


def test_repeated_rows_count_once(spark):
    rows = [(i, "ein Haus und ein Baum", "de") for i in range(0, 30, 2)] + [(i, "the house and a tree", "en") for i in range(1, 30, 2)]
    schema = "doc_id long, text string, lang string"
    once, often = (L.learn(spark.createDataFrame(x, schema)) for x in (rows, rows * 5 + [rows[4]] * 200))
    assert once["langs"] == often["langs"] == ["de", "en"] and np.array_equal(once["table"], often["table"])
    assert L.learn(spark.createDataFrame(rows, schema), most_langs=1)["langs"] in (["de"], ["en"])


def test_more_languages_than_a_byte_counts():
    """A path over 200 languages that switches away from one with a number over 127."""
    scores = np.full((9, 200), -5.0, np.float32)
    scores[:4, 150], scores[4:, 180] = 30, 30
    label = L.viterbi(np.concatenate([scores, scores]), np.array([0, 9, 18]))
    assert label.tolist() == ([150] * 4 + [180] * 5) * 2


def test_learning_starts_no_workers_for_a_local_table(spark, monkeypatch):
    """A list given to createDataFrame goes through an RDD, whose Python workers stay on each executor beside those of UDFs."""

    def refused(*a, **k):
        raise AssertionError("a local table went through an RDD of Python objects")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert L.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))["langs"]
