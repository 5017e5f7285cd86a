"""Sentence segmentation of official texts and of timed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.text import ends_sentence, has_word_chars, let, looks_hard_wrapped

from .intervals import island_ids


def _line_words(tokens: Column, after: Column) -> Column:
    """The words of a line, (word, ends, sentence in the line from 0), in time linear in its length.

    A token without a letter or digit joins the word before it on the line, or the word after if none is before or that
    one ends a sentence; marks that would join a word that isn't there go.
    """

    def joined(real: Column) -> Column:
        size = F.size(real)
        ends = F.transform(real, lambda i: ends_sentence(F.get(tokens, i), F.coalesce(F.get(tokens, i + 1), after)))

        def words(closed: Column) -> Column:
            opens = lambda k: (k == 0) | F.get(closed, k - 1)
            first = lambda i, k: F.when(opens(k), F.coalesce(F.get(real, k - 1) + 1, F.lit(0))).otherwise(i)
            last = lambda i, k: F.when(F.get(closed, k), i).otherwise(F.coalesce(F.get(real, k + 1), F.size(tokens)) - 1)
            text = lambda i, k: F.when(first(i, k) == last(i, k), F.get(tokens, i)).otherwise(F.array_join(F.slice(tokens, first(i, k) + 1, last(i, k) - first(i, k) + 1), " "))
            joins = F.transform(real, lambda i, k: F.struct(text(i, k).alias("word"), F.get(closed, k).alias("ends")))
            alone = F.transform(tokens, lambda t, k: F.struct(t.alias("word"), F.get(closed, k).alias("ends")))
            made = F.when(size == F.size(tokens), alone).otherwise(joins)  # most lines have no marks to join
            return let(made, lambda ws: let(stops(closed), lambda cuts: numbered(ws, cuts)))

        def stops(closed: Column) -> Column:
            """Where the sentences of the line stop: after each word that ends one, and after the last word."""
            places = F.transform(closed, lambda e, k: F.when(e | (k == size - 1), k + 1))
            return F.filter(places, lambda k: k.isNotNull())

        def numbered(ws: Column, cuts: Column) -> Column:
            since = lambda j: F.coalesce(F.get(cuts, j - 1), F.lit(0))
            part = lambda stop, j: F.transform(F.slice(ws, since(j) + 1, stop - since(j)), lambda w: F.struct(w["word"].alias("word"), w["ends"].alias("ends"), j.alias("sentence")))
            return F.flatten(F.transform(cuts, part))

        return let(ends, words)

    places = F.filter(F.transform(tokens, lambda t, i: F.when(has_word_chars(t), i)), lambda i: i.isNotNull())
    return let(places, joined)


def official_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, word, line, sentence): the words of each text with 1-based lines and sentence numbers from 0.

    A line break ends a sentence unless the text looks wrapped at a fixed width; then a blank line does.  Tokens
    without a letter or digit join the word before them on the line, or the word after if that one begins a sentence.
    Marks, words and sentences are settled inside each line; windows then run over lines, not words.
    """
    even = F.replace(F.replace(F.regexp_replace(text, "^﻿", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    texts = docs.filter(F.col(text).isNotNull()).select(key, even.alias("__text"))
    whole = texts.select(key, looks_hard_wrapped(F.col("__text")).alias("wrapped"), F.split("__text", "\n", -1).alias("__lines"))
    tokens_of = F.filter(F.split(F.col("t"), r"\s+"), lambda x: x != "")
    lines = whole.select(key, "wrapped", F.posexplode("__lines").alias("line", "t")).select(key, "wrapped", "line", tokens_of.alias("ts"))
    order = Window.partitionBy(key).orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("blanks", F.sum(F.when(F.size("ts") == 0, 1).otherwise(0)).over(order)).withColumn("after", F.when(F.col("wrapped"), F.get(F.lead("ts").over(order), F.lit(0))))
    made = lines.select(key, "wrapped", "line", "blanks", _line_words(F.col("ts"), F.col("after")).alias("ws")).filter(F.size("ws") > 0)
    last = F.element_at("ws", -1)
    fresh = F.lag(last["ends"]).over(order) | F.when(F.col("wrapped"), F.col("blanks") > F.lag("blanks").over(order)).otherwise(True)
    # a line opens a sentence or goes on with that of the line before; the sentences inside it follow
    opened = made.withColumn("opens", F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).withColumn("n", F.size("ws")).withColumn("more", last["sentence"])
    first = F.coalesce(F.sum(F.col("opens") + F.col("more")).over(before), F.lit(0)) + F.col("opens") - 1
    placed = opened.select(key, "line", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), first.alias("first"), "ws")
    words = placed.select(key, "line", "at", "first", F.posexplode("ws").alias("k", "w"))
    return words.select(key, (F.col("at") + F.col("k")).alias("pos"), "w.word", (F.col("line") + 1).alias("line"), (F.col("first") + F.col("w.sentence")).alias("sentence"))


def timed_sentences(words: DataFrame, key: str, pause: float, order: str = "pos") -> DataFrame:
    """Adds ``sentence`` (from 0): a sentence ends at a mark, before a pause of ``pause`` or more, and at the end."""
    by = Window.partitionBy(key).orderBy(order)
    ended = ends_sentence(F.lag("w").over(by), F.col("w")) | (F.col("start_ms") - F.lag("end_ms").over(by) >= pause)
    return island_ids(words.withColumn("__ended", ended), [key], [order], F.col("__ended"), "sentence").drop("__ended").withColumn("sentence", F.col("sentence") - 1)


def _pieces(starts: list[int], ends: list[int], longest: float) -> list[int]:
    """Where the pieces of one sentence begin."""
    found, todo = [], [(0, len(starts))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2 or ends[hi - 1] - starts[lo] <= longest:
            found.append(lo)
            continue
        cut = max(range(lo + 1, hi), key=lambda i: (starts[i] - ends[i - 1], i))
        todo += [(lo, cut), (cut, hi)]
    return sorted(found)


def split_long(sentenced: DataFrame, key: str, longest: float, order: str = "pos") -> DataFrame:
    """Cuts sentences over ``longest`` at their largest inner gap, the last one on ties, until all fit.

    Cuts depend on cuts, so each sentence is one row whose arrays a batch function cuts; no more than a
    sentence is held at once, and sentences within the limit never leave the JVM.
    """
    span = Window.partitionBy(key, "sentence")
    marked = sentenced.withColumn("__long", F.max("end_ms").over(span) - F.min("start_ms").over(span) > longest)
    rows = marked.filter("__long").groupBy(key, "sentence").agg(F.array_sort(F.collect_list(F.struct(order, "start_ms", "end_ms"))).alias("ws"))
    flat = rows.select(key, "sentence", *(F.col(f"ws.{c}").alias(c) for c in (order, "start_ms", "end_ms")))

    def cut(batches):
        for pdf in batches:
            pdf["cuts"] = [[int(p[i]) for i in _pieces(list(s), list(e), longest)] for p, s, e in zip(pdf[order], pdf["start_ms"], pdf["end_ms"])]
            yield pdf[[key, "sentence", "cuts"]]

    kinds = dict(sentenced.dtypes)
    cuts = flat.mapInPandas(cut, f"{key} {kinds[key]}, sentence bigint, cuts array<bigint>").select(key, F.explode("cuts").alias(order), F.lit(True).alias("__cut"))
    by = Window.partitionBy(key).orderBy(order)
    joined = sentenced.join(cuts, [key, order], "left").withColumn("__old", F.lag("sentence").over(by))
    fresh = (F.col("sentence") != F.col("__old")) | F.coalesce("__cut", F.lit(False))
    return island_ids(joined.withColumn("__f", fresh), [key], [order], F.col("__f"), "__s").withColumn("sentence", F.col("__s") - 1).drop("__s", "__f", "__cut", "__old")


def sentence_rows(sentenced: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """One row per sentence: 1-based id, text, start of the first word, latest end, word range, mean confidence (3 places)."""
    rows = sentenced.groupBy(key, "sentence").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "w"))), lambda x: x["w"]), " ").alias("text"),
        F.min_by("start_ms", order).alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min(order).alias("word_start"), (F.max(order) + 1).alias("word_end"), F.round(F.avg("conf"), 3).alias("avg_conf"),
    )
    return rows.withColumn("id", F.col("sentence") + 1).drop("sentence")


def joined_marks(words: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """Words without a letter or digit join the word before (or the first word, if none is before), widening its time."""
    by = Window.partitionBy(key).orderBy(order)
    real = has_word_chars(F.col("w"))
    run = F.greatest(F.sum(F.when(real, 1).otherwise(0)).over(by), F.lit(1))
    owned = words.withColumn("__real", real).withColumn("__run", run)
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x["w"]), "")
    out = owned.groupBy(key, "__run").agg(text("w").alias("w"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.bool_or("__real").alias("__any"))
    return out.filter("__any").select(key, (F.col("__run") - 1).alias("pos"), "w", "start_ms", "end_ms")


def clean_times(words: DataFrame, key: str, start: str, end: str, order: str = "pos") -> DataFrame:
    """Starts not before the end of the word before, ends not before starts; a raised end carries forward.

    That carry is a running maximum, so one window does it.
    """
    ms = lambda c: F.round(c, 3)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.greatest(ms(start), ms(end))).over(before), F.lit(0.0))
    cleaned = words.withColumn("__reach", reach).withColumn(start, F.greatest(ms(start), F.col("__reach")))
    return cleaned.withColumn(end, F.greatest(ms(end), F.col(start))).drop("__reach")
