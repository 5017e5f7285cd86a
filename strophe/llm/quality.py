"""Quality rules with adaptive thresholds.

Every document gets counts (words, symbols, repeated lines and windows).  For each language and source
the distribution of each ratio is kept as a log-bucket quantile sketch (counts per bucket whose bounds
grow by ``GAMMA``, so quantiles have 1 % relative error).  Such sketches merge by adding counts, in any
order, with the same result; small groups use the merged sketch of their language, then of everything.
The fences (quartile plus or minus ``REACH`` times the spread) then join back to the documents.  No cutoff is fixed:
the spread is the distance of the quartiles, or where they agree (most texts have no symbol and no repeated line) the
share that one event makes in a short text of the group, its size being the lower quartile from the sketch of sizes.

Only DataFrame functions are used.  Defined cases: a null or blank text has no words and fails the base
rule; null languages and sources are groups of their own; repeated rows count each; an empty table gives
an empty result; other columns of the input never matter to the counts and pass through the filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_table, if_small, let, materialise, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
GAMMA = 1.02
REACH = 7.0
MIN_GROUP = 64
#: Ratio: (size that it is a share of, how much of it one event is, is there a lower fence).
RATIOS = {"word_length": (None, 0, True), "symbols": ("chars", 1, False), "dup_lines": ("lines", 1, False), "repeats": ("words", 2 * WINDOW, False), "capitals": ("chars", 1, False)}
SIZES = {"chars": "word_chars", "lines": "n_lines", "words": "n_words"}
SYMBOLS = "#*$%&|<>"


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice: sort (hash, place), keep places with an equal neighbour, add up."""

    def repeated(pairs: Column) -> Column:
        twin = lambda k, e: F.coalesce(F.get(pairs, k)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, lambda e, k: ((k > 0) & twin(k - 1, e)) | twin(k + 1, e)), lambda e: e["i"]))

    def total(places: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(pairs, repeated), total))


def _word_counts(text: Column) -> Column:
    def counts(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - WINDOW)
        hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(WINDOW))))  # slice() copies the whole array each time
        repeats = F.when(F.size(ws) < WINDOW + 1, 0).otherwise(let(hashes, _covered))
        chars = F.aggregate(ws, F.lit(0), lambda n, w: n + F.length(w))
        return F.struct(F.size(ws).cast("long").alias("n_words"), repeats.cast("long").alias("n_repeat_words"), chars.cast("long").alias("word_chars"))

    return let(words(text), counts)


def _line_counts(text: Column) -> Column:
    counts = lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))
    return let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), counts)


def with_counts(docs: DataFrame, name: str = "__counts") -> DataFrame:
    """``docs`` with a struct of counts beside its own columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    symbols = F.length(text) - F.length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, text))
    parts = F.struct(_word_counts(text).alias("w"), _line_counts(text).alias("l"), symbols.cast("long").alias("n_symbols"), F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"))
    failed = lambda w: (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > MAX_REPEAT_PERCENT * w["n_words"])
    flat = lambda c: F.struct(*(c["w"][x].alias(x) for x in ("n_words", "n_repeat_words", "word_chars")), *(c["l"][x].alias(x) for x in ("n_lines", "n_dup_lines")), *(c[x].alias(x) for x in ("n_symbols", "n_capitals")), failed(c["w"]).alias("base_failed"))
    return docs.withColumn(name, let(parts, flat))


def _ratios(c: Column) -> dict[str, Column]:
    share = lambda a, b: F.try_divide(c[a].cast("double"), c[b].cast("double"))
    return {"word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars")}


def _keys() -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("")).alias(f"__{k}") for k in ("lang", "source")]


def sketches(counted: DataFrame, name: str = "__counts") -> DataFrame:
    """One row per language, source, ratio (or size) and bucket: the mergeable quantile sketches of documents past the base rule."""
    sizes = {k: F.col(f"{name}.{c}").cast("double") for k, c in SIZES.items()}
    values = F.array(*(F.struct(F.lit(k).alias("ratio"), v.alias("v")) for k, v in (_ratios(F.col(name)) | sizes).items()))
    rows = counted.filter(~F.col(f"{name}.base_failed")).select(*_keys(), F.explode(values).alias("r"))
    bucket = F.when(F.col("r.v") > 0, F.ceil(F.log(F.col("r.v")) / F.log(F.lit(GAMMA)))).otherwise(-100_000).cast("int")
    return rows.groupBy("__lang", "__source", F.col("r.ratio").alias("ratio"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Quartiles of each sketch: the value of the first bucket whose running count passes the rank."""
    by = Window.partitionBy(*keys, "ratio")
    running = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("all", F.sum("n").over(by))
    value = F.when(F.col("bucket") == -100_000, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) / (GAMMA + 1))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * q / 4), value)).alias(f"q{q}")
    return running.groupBy(*keys, "ratio").agg(F.max("all").alias("docs"), at(1), at(3))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per language and source: a lower and an upper fence for each ratio."""
    named = lambda df, p: df.select(*(c for c in df.columns if c.startswith("__")), "ratio", *(F.col(c).alias(p + c) for c in ("docs", "q1", "q3")))
    own = named(quartiles(sketch, "__lang", "__source"), "a_")
    by_lang = named(quartiles(merged(sketch, "__lang"), "__lang"), "b_")
    overall = named(quartiles(merged(sketch)), "c_")
    both = own.join(by_lang, ["__lang", "ratio"]).join(overall, "ratio")
    pick = lambda q: F.when(F.col("a_docs") >= MIN_GROUP, F.col(f"a_{q}")).when(F.col("b_docs") >= MIN_GROUP, F.col(f"b_{q}")).otherwise(F.col(f"c_{q}"))
    quartile = lambda k, q: F.max(F.when(F.col("ratio") == k, F.col(q)))
    wide = both.select("__lang", "__source", "ratio", pick("q1").alias("q1"), pick("q3").alias("q3")).groupBy("__lang", "__source")
    wide = wide.agg(*(quartile(k, q).alias(f"{q}_{k}") for k in (*RATIOS, *SIZES) for q in ("q1", "q3")))

    def ends(k: str, size: str | None, event: int, lower: bool) -> tuple[Column, Column]:
        low, high = F.col(f"q1_{k}"), F.col(f"q3_{k}")
        spread = F.greatest(high - low, event / F.col(f"q1_{size}")) if size else high - low
        return (low - REACH * spread if lower else F.lit(-1.0)).alias(f"__low_{k}"), (high + REACH * spread).alias(f"__high_{k}")

    return wide.select("__lang", "__source", *(e for k, how in RATIOS.items() for e in ends(k, *how)))


def fences_of(counted: DataFrame, name: str = "__counts") -> DataFrame:
    """The fences of every language and source, written; a row per group."""
    return materialise(thresholds(sketches(counted, name)), "fences")


def judged(counted: DataFrame, fences: DataFrame, name: str = "__counts") -> tuple[DataFrame, Column]:
    """``counted`` beside its fences, and the verdict: past the base rule and inside every fence of its group."""
    joined = counted.select("*", *_keys()).join(if_small(fences), ["__lang", "__source"], "left")
    inside = F.lit(True)
    for k, v in _ratios(F.col(name)).items():
        inside = inside & (v >= F.col(f"__low_{k}")) & (v <= F.col(f"__high_{k}"))
    return joined, F.coalesce(~F.col(f"{name}.base_failed") & inside, F.lit(False))


def _written_counts(docs: DataFrame) -> DataFrame:
    """Counts of every document, without texts."""
    return materialise(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "counts")


def quality_rows(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document, without texts."""
    counted = _written_counts(docs)
    joined, kept = judged(counted, fences_of(counted))
    c = F.col("__counts")
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return joined.select("doc_id", *(c[f].alias(f) for f in fields), kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Counts are made twice, for the fences and for the verdict, so no copy of the texts is written.
    """
    counted = _written_counts(docs)
    fences = fences_of(counted)
    drop_table(counted)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "text", "lang", "source")
    joined, kept = judged(with_counts(own).drop("text"), fences)
    return joined.filter(kept).select("__row.*")
