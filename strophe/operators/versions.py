"""Selections against what was asked: required passages, several lengths in one answer, limits of the cuts around words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.storage import written

from .select import judged, scheduled


def required_for(clips: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds quote: the first required quote (by pos) with exactly a clip's range [start, end]; null if there is none."""
    first = quotes.groupBy(*keys, "start", "end").agg(F.min_by("quote", "pos").alias("quote"))
    return clips.join(first, [*keys, "start", "end"], "left")


def with_required(clips: DataFrame, quotes: DataFrame, keys: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """(keys, clip, start, end, score, role, added, also): the clips, and one for each required quote whose range none of them has.

    An added clip has the quote's id, or id + ``r`` where a clip has that already, score 1 and the quote's role, or ``build``.
    """
    ranges = clips.select(*keys, "start", "end").distinct()
    taken = clips.select(*keys, F.col("clip").alias("quote")).distinct().withColumn("__taken", F.lit(True))
    missing = quotes.join(ranges, [*keys, "start", "end"], "left_anti").join(taken, [*keys, "quote"], "left")
    name = F.when(F.col("__taken"), F.concat("quote", F.lit("r"))).otherwise(F.col("quote"))
    new = missing.select(*keys, name.alias("clip"), "start", "end", F.lit(1.0).alias("score"), F.coalesce("role", F.lit("build")).alias("role"), F.lit(True).alias("added"), *also)
    return clips.select(*keys, "clip", "start", "end", F.col("score").cast("double").alias("score"), "role", F.lit(False).alias("added"), *also).unionByName(new)


def finalized(clips: DataFrame, quotes: DataFrame, order: DataFrame, low: float, high: float, most: int, budget: float) -> DataFrame:
    """(sel, clip, start, end, score, added, time_pos, play_pos): the usable part of a selection, in time and in playing order.

    Clips are (sel, pos, clip, start, end, score, seconds, role), quotes (sel, quote, pos, start, end, seconds, role), order (sel, at, clip).
    Ids with an invalid clip go; scores are clamped to [0, 1]; missing quotes come in; overlaps, count and seconds are settled by score,
    quotes first.  The suggested order counts; added quotes play before the first clip of it that is later in the talk, and what it
    leaves out comes last, by score.  What several steps read is written, so that it is made once.
    """
    key = ["sel"]
    known = required_for(clips, quotes, key).withColumn("required", F.col("quote").isNotNull())
    bad = F.max(F.col("kind").isNotNull()).over(Window.partitionBy("sel", "clip")) & F.col("sel").isNotNull() & F.col("clip").isNotNull()
    good = judged(known, low, high).withColumn("__bad", bad).filter("not __bad").drop("__bad", "kind").withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))
    good, quotes = written(good, "selections-good"), written(quotes, "selections-quotes")
    late = quotes.withColumn("pos", F.col("pos") + 1_000_000)  # after the clips, as they are added after them
    whole = with_required(good, late, key, ("pos", "seconds"))
    must = written(required_for(whole, late, key).withColumn("required", F.col("quote").isNotNull()).drop("quote"), "selections")
    kept = must.join(scheduled(must, most, budget), ["sel", "clip"])
    first = order.groupBy("sel", "clip").agg(F.min("at").alias("__at"))
    kept = kept.join(first, ["sel", "clip"], "left")
    later = F.min("__at").over(Window.partitionBy("sel").orderBy("start").rangeBetween(1, Window.unboundedFollowing))
    end = F.lit(2**31 - 1)
    unlisted = F.col("__at").isNull()
    place = F.struct(
        F.when(~unlisted, F.col("__at")).when(F.col("added"), F.coalesce(later, end - 1)).otherwise(end).alias("a"),
        F.when(unlisted, 0).otherwise(1).alias("b"), F.when(unlisted & ~F.col("added"), -F.col("score")).otherwise(0.0).alias("c"), F.col("start").alias("d"),
    )
    by = Window.partitionBy("sel")
    ranked = kept.withColumn("__p", place).withColumn("time_pos", F.row_number().over(by.orderBy("start")))
    return ranked.select("sel", "clip", "start", "end", "score", "added", "time_pos", F.row_number().over(by.orderBy("__p")).alias("play_pos"))


def version_problems(clips: DataFrame, asked: DataFrame, versions: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """(key, length, kind, clip): what is wrong with an answer that holds a version for each length asked for.

    Clips are (key, clip), asked (key, length), versions (key, length, v), order (key, length, v, pos, clip).  ``twice``: an id used
    for several clips; ``missing`` and ``repeated``: a length without a version or with several; the first version's order counts:
    ``unknown`` for each clip it names that isn't there, ``order`` if it lists one twice.
    """
    none = F.lit(None).cast("string")
    twice = clips.groupBy(key, "clip").agg(F.count("*").alias("c")).filter("c > 1").select(key, none.alias("length"), F.lit("twice").alias("kind"), "clip")
    given = versions.groupBy(key, "length").agg(F.count("*").alias("c"), F.min("v").alias("v"))
    met = asked.join(given, [key, "length"], "left")
    missing = met.filter("v is null").select(key, "length", F.lit("missing").alias("kind"), none.alias("clip"))
    repeated = met.filter("c > 1").select(key, "length", F.lit("repeated").alias("kind"), none.alias("clip"))
    named = order.join(met.filter("v is not null").select(key, "length", "v"), [key, "length", "v"])
    unknown = named.select(key, "length", "clip").distinct().join(clips.select(key, "clip").distinct(), [key, "clip"], "left_anti")
    again = named.groupBy(key, "length").agg((F.count("*") > F.count_distinct("clip")).alias("again")).filter("again")
    return (
        twice.unionByName(missing).unionByName(repeated)
        .unionByName(unknown.select(key, "length", F.lit("unknown").alias("kind"), "clip"))
        .unionByName(again.select(key, "length", F.lit("order").alias("kind"), none.alias("clip")))
    )


def cut_limits(spans: DataFrame, words: DataFrame, key: str, total: DataFrame, lead: int, tail: int, inner: int) -> DataFrame:
    """(key, quote, part, start_lo, start_hi, end_lo, end_hi): where the cuts around words [ws, we) may lie, in milliseconds.

    Spans are (key, quote, part, ws, we), words (key, pos, start_ms, end_ms), total (key, total_ms).  A cut stays within ``lead`` and
    ``tail`` outside and ``inner`` inside the words' edges and never passes the middle of a neighbouring word.
    """
    by = Window.partitionBy(key).orderBy("pos")
    middle = (F.col("start_ms") + F.col("end_ms")) / 2
    mids = words.select(key, "pos", "start_ms", "end_ms", middle.alias("m"), F.lag(middle).over(by).alias("m0"), F.lead(middle).over(by).alias("m1"))
    at = spans.withColumn("pos", F.explode(F.sequence("ws", F.col("we") - 1))).join(mids, [key, "pos"])
    edges = at.groupBy(key, "quote", "part").agg(
        F.min_by("start_ms", "pos").alias("s"), F.max("end_ms").alias("e"), F.min_by(F.coalesce("m0", F.lit(0.0)), "pos").alias("before"),
        F.min_by("m", "pos").alias("first"), F.max_by("m", "pos").alias("last"), F.max_by(F.struct("m1"), "pos")["m1"].alias("after"),
    )
    end_lo = F.greatest(F.col("e") - inner, F.col("last"))
    end_hi = F.greatest(end_lo, F.least(F.col("e") + tail, F.coalesce("after", "total_ms")))
    ends = edges.join(total, key).withColumn("end_lo", end_lo).withColumn("end_hi", end_hi)
    hi = F.least(F.col("s") + inner, F.col("first"))
    lo = F.least(hi, F.greatest(F.col("s") - lead, F.col("before")))
    return ends.select(key, "quote", "part", lo.cast("double").alias("start_lo"), hi.cast("double").alias("start_hi"), F.col("end_lo").cast("double").alias("end_lo"), F.col("end_hi").cast("double").alias("end_hi"))


def after_previous(cuts: DataFrame, key: str) -> DataFrame:
    """Limits of (key, quote, part, start_lo, start_hi, end_cut): the cut before a part comes no earlier than the one after the part before."""
    floor = F.lag("end_cut").over(Window.partitionBy(key, "quote").orderBy("part"))
    return cuts.withColumn("start_lo", F.least("start_hi", F.greatest("start_lo", floor)))
