"""Clips on their sentences and on the song: spans, renaming, placing, chord cycles, passage curves, endings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import containing_join


def clip_spans(clips: DataFrame, sentences: DataFrame, talk: str = "talk_id") -> DataFrame:
    """(talk, clip, text, seconds_ms) of clips (first, last sentence id) whose whole range exists.

    Sentences meet clips by bucket of ids, a clip of k sentences in about k / 16 of them.
    """
    inside = containing_join(sentences, clips.select(talk, "clip", "first", "last"), [talk], "id", ("first", "last"), 16, closed=True)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), " ")
    spans = inside.groupBy(talk, "clip", "first", "last").agg(text.alias("text"), (F.max("end_ms") - F.min_by("start_ms", "id")).alias("length_ms"), F.count("*").alias("n"))
    return spans.filter(F.col("n") == F.col("last") - F.col("first") + 1).select(talk, "clip", "text", "length_ms")


def renamed(order: Column, names: Column) -> Column:
    """An array of ids with those that the map knows replaced."""
    return F.transform(order, lambda i: F.coalesce(F.try_element_at(names, i), i))


def placed_clips(sections: DataFrame, lengths: DataFrame, bpm: float, rate: int) -> DataFrame:
    """(song, n, clip, start_sample, end_sample) of sections (start_bar, clip) whose clip has a length in samples."""
    at = F.bround(F.col("start_bar") * (240.0 / bpm) * rate).cast("long")
    met = sections.filter("clip is not null").join(lengths, "clip")
    return met.select("song", "n", "clip", at.alias("start_sample"), (at + F.col("samples")).alias("end_sample"))


def shifted(segments: Column, by: float) -> Column:
    """Nested segments (start, end, words of start and end) moved by some seconds, to milliseconds."""
    move = lambda x: F.round(x + by, 3)
    word = lambda w: F.struct(w["w"].alias("w"), move(w["start"]).alias("start"), move(w["end"]).alias("end"))
    return F.transform(segments, lambda s: F.struct(move(s["start"]).alias("start"), move(s["end"]).alias("end"), F.transform(s["words"], word).alias("words")))


def passage_gains(passages: DataFrame, song: str, at: DataFrame, ramp: int) -> DataFrame:
    """(song, at, gain_db): the deepest of the eased gains of passages (start, end, gain_db) over distinct points (song, at); 0 outside."""
    wide = passages.filter("gain_db < 0").withColumn("a", F.greatest(F.lit(0), F.col("start") - ramp)).withColumn("b", F.col("end") + ramp)
    size = max(1, 4 * ramp)  # points and passages meet by song and bucket, and there they are grouped
    touched = wide.filter("b > a").withColumn("__b", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size))))
    met = at.select(song, "at", F.floor(F.col("at") / size).alias("__b")).join(touched, [song, "__b"], "left")
    inside = (F.col("at") >= F.col("a")) & (F.col("at") < F.col("b"))
    down, up = (F.col("at") - (F.col("start") - ramp)) / ramp, (F.col("at") - F.col("end")) / ramp
    shape = F.when(down < 1, 0.5 - 0.5 * F.cos(math.pi * down)).when(up >= 0, 0.5 + 0.5 * F.cos(math.pi * up)).otherwise(1.0)
    least = met.groupBy(song, "__b", "at").agg(F.min(F.when(inside, F.col("gain_db") * shape)).alias("gain_db"))
    return least.select(song, "at", F.coalesce("gain_db", F.lit(0.0)).alias("gain_db"))


def audible_end(frames: DataFrame, stream: str, i: str, level: str, within: float) -> DataFrame:
    """(stream, last): the last frame within ``within`` dB of the loudest."""
    top = F.max(level).over(Window.partitionBy(stream))
    return frames.withColumn("__top", top).groupBy(stream).agg(F.max(F.when(F.col(level) >= F.col("__top") - within, F.col(i))).alias("last"))


def role_cycles(sections: DataFrame) -> DataFrame:
    """(song, role, k, chords): per role and occurrence the chords (by bar) as the cycle they repeat."""
    from .timeline import cycle_length

    k = F.row_number().over(Window.partitionBy("song", "role").orderBy("n"))
    return sections.withColumn("k", k).select("song", "role", "k", F.slice("chords", F.lit(1), cycle_length(F.col("chords"))).alias("chords"))


def missing_references(used: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Values used that nothing declares."""
    return used.select(column).distinct().join(known.select(column), column, "left_anti")
