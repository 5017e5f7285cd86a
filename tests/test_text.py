"""Literal cases of word forms, sentence ends, segmentation, citations and quotes."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from strophe.functions import text as T
from strophe.functions.canonical import canonical_json
from strophe.operators import sentences as S
from strophe.sources import quotes


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(make(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize("word,tokens", [("eight-year-old", ["eight", "year", "old"]), ("Savior.12", ["savior"]), ("U.S.", ["us"]), ("—", []), ("Straße", ["strasse"]), ("Café’s", ["cafes"])])
def test_match_tokens(spark, word, tokens):
    assert one(spark, T.match_tokens, word) == tokens


@pytest.mark.parametrize("word,following,ends", [("end.", "and", False), ("why?", "and", True), ("M.", "Nelson", False), ("wait...", "Then", True), ("Dr.", "Smith", False), ("end.", None, True), ('said."', "He", True), ("so:", "Then", False)])
def test_ends_sentence(spark, word, following, ends):
    assert one(spark, T.ends_sentence, word, following) is ends


def test_hard_wrapped_text_joins_lines(spark):
    text = "This is the first line of a\nparagraph that is wrapped at\na width. It has a second\nsentence that goes on and\non for a while.\n\nHere is another one that\nis wrapped as well."
    rows = S.official_words(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert rows.agg(F.countDistinct("sentence")).first()[0] == 3


def test_marks_join_the_word_before_unless_it_ended(spark):
    rows = S.official_words(spark.createDataFrame([(1, "one — two. — three\n* four")], "doc_id int, text string")).orderBy("pos").collect()
    assert [(r["word"], r["sentence"], r["line"]) for r in rows] == [("one —", 0, 1), ("two.", 0, 1), ("— three", 1, 1), ("* four", 2, 2)]


def test_pause_and_length(spark):
    words = spark.createDataFrame([(1, i, "w", a, b, 0.9) for i, (a, b) in enumerate([(0, 300), (350, 600), (2600, 2900)])], "t int, pos int, w string, start_ms long, end_ms long, conf double")
    assert [r["sentence"] for r in S.timed_sentences(words, "t", 1500).orderBy("pos").collect()] == [0, 0, 1]
    long = spark.createDataFrame([(1, i, "w", i * 300 + (200 if i >= 60 else 0), i * 300 + 250 + (200 if i >= 60 else 0), 0.9) for i in range(120)], "t int, pos int, w string, start_ms long, end_ms long, conf double")
    parts = S.split_long(S.timed_sentences(long, "t", 1500), "t", 30_000).groupBy("sentence").agg(F.min("pos").alias("a")).orderBy("a").collect()
    assert [r["a"] for r in parts] == [0, 60]


@pytest.mark.parametrize("text,out", [("a (b) c [d] e (see f) [g h.] (i 2) [j (k, 1982), 9] l .", "a (b) c d e l."), ("a (b c", "a (b c"), ("x ) y [", "x ) y [")])
def test_citations(spark, text, out):
    assert one(spark, T.clean_block, text) == out

def test_quote_files(spark):
    df = spark.createDataFrame([(1, "- “One  two”\n2. three\n\n"), (2, "a b\nc\n\n* d e")], "f int, text string")
    assert [(r["f"], r["quote_no"], r["quote"]) for r in quotes.parsed_quotes(df).orderBy("f", "quote_no").collect()] == [(1, 1, "One two"), (1, 2, "three"), (2, 1, "a b c"), (2, 2, "d e")]


def test_similarity(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(F.round(T.similarity(F.col("a"), F.col("b")), 4)).collect()] == [0.6667, 1.0, 0.0]


def test_official_words_of_long_texts(spark):
    """Marks, sentence ends and numbering by a plain walk, over many lines and one very long line."""
    rng = random.Random(2)
    parts = ["word", "end.", "-", "“", "(so", "why?", "M.", "12", "…", "e.g.", "wait...", "Then", "and", "!"]
    texts = ["\n".join(" ".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(20_000)), " ".join(rng.choice(parts) for _ in range(100_000)), "", " - \n\n!", None]
    rows = S.official_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["pos"])):
        got.setdefault(r["doc_id"], []).append((r["pos"], r["word"], r["line"], r["sentence"]))
    pairs = spark.createDataFrame([(a, b) for a in parts for b in [*parts, None]], "a string, b string")
    ends = {(r["a"], r["b"]): r["e"] for r in pairs.select("a", "b", T.ends_sentence(F.col("a"), F.col("b")).alias("e")).collect()}
    real = {p: any(c.isalnum() for c in p) for p in parts}
    for doc, text in enumerate(texts[:4]):
        want, sentence, new = [], -1, True
        for n, line in enumerate(text.split("\n"), 1):
            tokens, held, open_word, new = line.split(), [], None, True
            for i, t in enumerate(tokens):
                if real[t]:
                    sentence += new
                    want.append([len(want), " ".join([*held, t]), n, sentence])
                    new = ends[t, tokens[i + 1] if i + 1 < len(tokens) else None]
                    held, open_word = [], not new
                elif open_word:
                    want[-1][1] += f" {t}"
                else:
                    held.append(t)
        assert got.get(doc, []) == [tuple(w) for w in want]


def test_norm_is_the_tokens_of_each_word(spark):
    """The whole-text form against the tokens word by word, over words with marks, footnotes, odd spaces and letters of many kinds."""
    rng = random.Random(12)
    parts = ["eight-year-old", "Savior.12", "Savior.1234", "U.S.", "—", "don’t", "x/y", "ﬁ", "ǅ", "ß", "İ", "é", "é", "日本", "a b", "½", "①", "́a", "…12", "’s.1", "ſ", "٣", "a.٣", "(b)2", " ", "q r", "-", "''", "\x1c", "\x85", "Ω.9", "x,7"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", "\n", "\t ", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += ["", " ", None, "plain words, only.3 here", "A-b/c don't.12\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = F.filter(F.split("t", r"\s+"), lambda w: w != "")
    each = F.array_join(F.flatten(F.transform(words, T.match_tokens)), " ")
    odd = df.select("t", T.norm(F.col("t")).alias("n"), each.alias("e")).filter(~F.col("n").eqNullSafe(F.col("e"))).collect()
    assert not odd, odd[:3]


def test_canonical_json(spark):
    """The text that Python's json writes with sorted keys."""
    schema = "v struct<b:string,a:array<struct<z:double,y:boolean>>,m:map<string,array<bigint>>,n:bigint>"
    rows = [
        {"b": "é \"q\" \\ \n\t\x01\x1b\x7f😀/", "a": [{"z": 0.5, "y": True}, {"z": 120.0, "y": None}, None], "m": {"zz": [1, 2], "aé": [], "a": None}, "n": -5},
        {"b": "", "a": [], "m": {}, "n": None}, {"b": None, "a": None, "m": None, "n": 10**15},
    ]
    df = spark.createDataFrame([(r,) for r in rows], schema)
    got = [r["t"] for r in df.select(canonical_json(F.col("v"), df.schema["v"].dataType).alias("t")).collect()]
    assert got == [json.dumps(r, sort_keys=True) for r in rows]


def test_norm_makes_each_form_once(spark):
    """A form that a condition asks about is made again for it, and so are the steps before: only the text itself may be asked about."""
    plan = spark.range(1).select(T.norm(F.col("id").cast("string")).alias("n"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(T.BETWEEN + ", 1") == 1 and plan.count("Normalizer") == 2 and plan.count("foldCase") == 1


def test_combining_marks_are_those_of_the_tables(spark):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = spark.createDataFrame([(c, chr(c)) for c in codes if c > 0x2FF and unicodedata.combining(chr(c)) or c % 97 == 0], "c int, t string").filter(F.col("t").rlike(f"^{T.COMBINING}$"))
    assert {r.c for r in found.select("c").collect()} == {c for c in codes if unicodedata.combining(chr(c))}
