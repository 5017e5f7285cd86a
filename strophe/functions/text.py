"""Column functions over words and texts: normal forms, sentence ends, similarity, citations, slugs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that mean the same as a plain one, marks around words, and words before a period that ends nothing.
APOSTROPHES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„‟″"
DASHES = "‐‑‒–—―−"
CLOSERS = "\"'”’)]}»"
OPENERS = "\"'“‘([{«"
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "st", "jr", "sr", "prof", "rev", "fr", "gen", "sen", "rep",
    "gov", "lt", "col", "capt", "sgt", "hon", "vs", "vol", "pp", "cf", "approx", "fig",
    "e.g", "i.e", "u.s", "mt", "ft",
]


def let(value: Column, body) -> Column:
    """Bind ``value`` once; a plain alias would be inlined wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_decimal(x: Column) -> Column:
    """A double with one decimal, rounded by its exact binary value (half to even), as C and Python print it.

    ``20 * x`` as an exact sum of two doubles tells on which side of the nearest half tenth the value lies.
    """

    def text(v: Column) -> Column:
        high = 134_217_729.0 * v - (134_217_729.0 * v - v)
        product = v * 20.0
        odd = 2.0 * F.floor(product / 2.0) + 1.0
        side = (product - odd) + ((high * 20.0 - product) + (v - high) * 20.0)
        tenths = F.when(side > 0, (odd + 1) / 2).when(side < 0, (odd - 1) / 2).otherwise(F.bround(odd / 2)).cast("long")
        return let(tenths, lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), F.pmod(t, F.lit(10)).cast("string")))

    return F.concat(F.when(x < 0, "-").otherwise(""), let(F.abs(x.cast("double")), text))


#: White space as Python's ``str`` methods see it.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"
NON_ASCII = r"[^\x00-\x7F]"


def _ranges(belongs) -> str:
    """The characters for which ``belongs`` holds, as ranges of a pattern."""
    found = [c for c in range(0x110000) if belongs(chr(c))]
    starts = [c for i, c in enumerate(found) if not i or found[i - 1] != c - 1]
    ends = [c for i, c in enumerate(found) if i + 1 == len(found) or found[i + 1] != c + 1]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))


#: Characters of a combining class other than 0; all are marks, or newer than the JVM's tables, so that others are not held against each range.
COMBINING = rf"[\p{{M}}\p{{Cn}}&&[{_ranges(unicodedata.combining)}]]"
#: What is neither letter nor number; letters newer than the JVM's own tables come from Python's.
NON_WORD = rf"(?s)(?:(?![\p{{L}}\p{{N}}]|[\p{{Cn}}&&[{_ranges(str.isalnum)}]]).)+"


def _icu(method: str, text: Column, flag: bool) -> Column:
    """A static method of the ICU library that Spark ships, so normal forms need no Python worker."""
    owner, name = method.rsplit(".", 1)
    return F.java_method(F.lit(f"com.ibm.icu.{owner}"), F.lit(name), text, F.lit(flag))


def _only_beyond_ascii(text: Column, changed: Column, otherwise: Column | None = None) -> Column:
    return F.when(text.rlike(NON_ASCII), changed).otherwise(text if otherwise is None else otherwise)


def composed(text: Column) -> Column:
    """NFKC."""
    return _only_beyond_ascii(text, _icu("text.Normalizer.compose", text, True))


def decomposed(text: Column) -> Column:
    """NFKD."""
    return _only_beyond_ascii(text, _icu("text.Normalizer.decompose", text, True))


def without_accents(text: Column) -> Column:
    """NFKD without characters of a combining class."""
    return _only_beyond_ascii(text, F.regexp_replace(decomposed(text), COMBINING, ""))


def casefolded(text: Column) -> Column:
    """Full case folding."""
    return _only_beyond_ascii(text, _icu("lang.UCharacter.foldCase", text, True), F.lower(text))


def plain(text: Column) -> Column:
    """Quotes, dashes and ellipses as ASCII."""
    swapped = F.translate(text, APOSTROPHES + DOUBLE_QUOTES + DASHES, "'" * len(APOSTROPHES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES))
    return F.replace(swapped, F.lit("…"), F.lit("..."))


def match_tokens(word: Column) -> Column:
    """The tokens by which a word is matched: parts between dashes and slashes, folded, letters and digits only.

    A number of up to three digits pasted after a word and its punctuation is a footnote and goes first.  Normal forms
    (NFKC, then NFKD without marks, then case folding) are those of the Unicode tables, over all letters.
    """
    bare = F.regexp_replace(plain(composed(word)), r"(\p{L}[.,;:!?\"')\]])\p{Nd}{1,3}$", "$1")
    parts = F.split(casefolded(F.replace(without_accents(bare), F.lit("'"), F.lit(""))), r"[-/]+")
    word_only = lambda p: _only_beyond_ascii(p, F.regexp_replace(p, NON_WORD, ""), F.regexp_replace(p, "[^A-Za-z0-9]+", ""))
    return F.filter(F.transform(parts, word_only), lambda t: t != "")


#: Stands for white space between words while their normal forms are made: it is no letter and composes with nothing.
BETWEEN = "\ue00a"
FOOTNOTE = r"(\p{L}[.,;:!?\"')\]])\p{Nd}{1,3}(?=[\x85\u2028\u2029]?(?:BETWEEN|$))".replace("BETWEEN", BETWEEN)


def norm(text: Column) -> Column:
    """All match tokens of a text, joined by spaces: :func:`match_tokens` of every word, each step once over the whole text.

    White space is what separates words, so spaces that a normal form makes inside one go like any other mark.  Texts
    in ASCII need three patterns.  Others take every form without asking again whether they need it: the question would make
    what is asked about once more, and the steps before that again.
    """
    joined = lambda t, odd: F.trim(F.regexp_replace(F.regexp_replace(t, odd, ""), "[-/ ]+", " "))
    bare = F.regexp_replace(text, r"([A-Za-z][.,;:!?\"')\]])[0-9]{1,3}(?=\s|$)", "$1")
    ascii_only = joined(F.regexp_replace(F.lower(bare), r"\s+", " "), "[^a-z0-9/ -]+")
    marked = F.regexp_replace(text, r"\s+", BETWEEN)
    without = F.regexp_replace(plain(_icu("text.Normalizer.compose", marked, True)), FOOTNOTE, "$1")
    bare_letters = F.regexp_replace(_icu("text.Normalizer.decompose", without, True), COMBINING, "")
    folded = _icu("lang.UCharacter.foldCase", F.replace(bare_letters, F.lit("'"), F.lit("")), True)
    kept = NON_WORD.replace("(?:(?!", f"(?:(?![-/{BETWEEN}])(?!", 1)
    beyond = joined(F.replace(F.regexp_replace(folded, kept, ""), F.lit(BETWEEN), F.lit(" ")), "(?!)")
    return F.when(text.rlike(NON_ASCII), beyond).otherwise(ascii_only)


def has_word_chars(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def _strip(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-" else c for c in chars) + "]"


def first_letter(word: Column) -> Column:
    """The first letter after opening marks, or an empty string."""
    return F.regexp_extract(F.regexp_replace(word, f"^{_strip(OPENERS)}+", ""), r"\p{L}", 0)


def ends_sentence(word: Column, following: Column) -> Column:
    """Does a sentence end after ``word``?  ``following`` is null at the end of a line or text."""
    core = F.regexp_replace(word, f"{_strip(CLOSERS)}+$", "")
    stem = F.regexp_replace(F.substring(core, F.lit(1), F.length(core) - 1), f"^{_strip(OPENERS)}+", "")
    first = first_letter(following)
    return (
        F.when(~word.rlike(rf"[.?!…]{_strip(CLOSERS)}*$"), False)  # most words are done here
        .when(core.rlike(r"[?!]$"), True)
        .when(core.rlike(r"(\.\.\.|…)$"), following.isNull() | first.rlike(r"\p{Lu}"))
        .when(~core.rlike(r"\.$"), False)
        .when(stem.rlike(r"^\p{L}$"), False)
        .when(F.lower(stem).isin(*ABBREVIATIONS), False)
        .otherwise(following.isNull() | ~first.rlike(r"\p{Ll}"))
    )


def looks_hard_wrapped(text: Column) -> Column:
    """At least five lines with content, three in five of them without an end mark."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), F.trim), lambda x: x != "")
    open_ = F.size(F.filter(lines, lambda x: ~F.regexp_replace(x, f"{_strip(CLOSERS)}+$", "").rlike(r"[.!?:;]$")))
    return (F.size(lines) >= 5) & (open_ >= 0.6 * F.size(lines))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: one row of the table per element of ``a``.

    Row cell j is the best of the cell above, the cell to the left, and the diagonal plus one on a match.
    """
    start = F.transform(b, lambda _: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        cell = lambda acc, y, i: F.greatest(F.get(above, i), F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), F.when(y == x, F.coalesce(F.get(above, i - 1), F.lit(0)) + 1).otherwise(0))
        indexed = F.transform(b, lambda y, i: F.struct(y.alias("y"), i.alias("i")))
        return F.aggregate(indexed, F.array().cast("array<int>"), lambda acc, e: F.concat(acc, F.array(cell(acc, e["y"], e["i"]))))

    done = F.aggregate(a, start, row)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.try_element_at(done, F.lit(-1)))


def similarity(a: Column, b: Column) -> Column:
    """Insert-delete similarity of arrays: twice the common length over the sum of lengths; 1 for two empty ones."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common_length(a, b) / total)


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def text_matches(quote: Column, actual: Column, least: float = 0.8) -> Column:
    return similarity(letters(norm(quote)), letters(norm(actual))) >= least


def clean_quote(text: Column) -> Column:
    """Without a bullet or number in front, single spaces, no quote marks around."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*(?:[-*•]|\d+[.)])\s+", ""), r"\s+", " "))
    marks = _strip("\"'“”‘’ ")
    return F.regexp_replace(bare, f"^{marks}+|{marks}+$", "")


#: Private characters: a link inside a text being put together, parentheses that stay, and marks of the round at work.
LINK, KEPT_OPEN, KEPT_CLOSE, NEW_OPEN, NEW_CLOSE, GONE = "\ue000", "\ue001", "\ue002", "\ue005", "\ue006", "\ue007"


def nesting(text: Column) -> Column:
    """How deep brackets nest at most; a closing one that closes nothing counts for nothing."""
    marks = F.split(F.regexp_replace(text, r"[^()\[\]]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = F.when(c.isin("(", "["), a["now"] + 1).when(c.isin(")", "]"), F.greatest(a["now"] - 1, F.lit(0))).otherwise(a["now"])
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.when(text.rlike(r"[(\[]"), F.aggregate(marks, start, step, lambda a: a["most"])).otherwise(0)


def _settle_innermost(text: Column) -> Column:
    """One round: innermost groups that cite go, other parentheses are masked, other brackets open up.

    What a dropped group was in waits for the next round, as the mark it leaves counts as a bracket in this one.
    """
    inner = rf"[^()\[\]{GONE}]*"
    cites = rf"(?:{inner}[{LINK}\p{{Nd}}]{inner}|{SPACE}*[sS][eE][eE](?![\p{{L}}\p{{N}}_]){inner})"
    text = F.regexp_replace(text, rf"\({cites}\)|\[{cites}\]|\[{inner}[.!?]{SPACE}*\]", GONE)
    text = F.regexp_replace(text, rf"\(({inner})\)", f"{NEW_OPEN}$1{NEW_CLOSE}")
    text = F.regexp_replace(text, rf"\[([^()\[\]{GONE}{NEW_OPEN}{NEW_CLOSE}]*)\]", "$1")
    return F.translate(text, NEW_OPEN + NEW_CLOSE + GONE, KEPT_OPEN + KEPT_CLOSE)


def drop_citations(text: Column) -> Column:
    """Drop groups that cite, innermost first, at any nesting; spoken parentheses stay, spoken brackets open up.

    A group cites if it holds a link or a digit, starts with "see", or is a bracketed sentence.  Each round settles one
    level of nesting, so a text needs as many rounds as its brackets nest.
    """
    depth = nesting(text)
    rounds = F.aggregate(F.sequence(F.lit(1), depth), text, lambda t, _: _settle_innermost(t))
    return F.translate(F.when(depth > 0, rounds).otherwise(text), KEPT_OPEN + KEPT_CLOSE, "()")


def clean_block(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.translate(drop_citations(text), LINK, ""), f"{SPACE}+", " "))
    return F.regexp_replace(spaced, r" +([.,;:!?])", "$1")


def slug(text: Column, most: int = 32) -> Column:
    folded = F.lower(F.regexp_replace(decomposed(text), NON_ASCII, ""))
    dashed = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(dashed, 1, most), "-+$", ""), F.lit("")), F.lit("input"))


def is_url(text: Column) -> Column:
    return text.rlike("(?i)^https?://")


def url_key(url: Column) -> Column:
    """Lower-case host and the path."""
    return F.concat(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
