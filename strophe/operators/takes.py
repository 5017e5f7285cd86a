"""Takes, clips and arcs: choices, spans and short scalar rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen_takes(takes: DataFrame, song: str, take: str, score: str, requested: str) -> DataFrame:
    """(song, take, why): the requested take, the only one, or the best (the lower number on ties)."""
    found = takes.groupBy(song).agg(F.max(requested).alias("__r"), F.count("*").alias("__n"), F.max_by(take, F.struct(F.col(score), -F.col(take))).alias("__b"))
    why = F.when(F.col("__r").isNotNull(), "requested").when(F.col("__n") == 1, "only take").otherwise("best score")
    return found.select(song, F.coalesce("__r", "__b").alias(take), why.alias("why"))


def take_fits(stored: Column, current: Column, digest: Column, wanted: Column) -> Column:
    """By grid where one is stored, else by digest."""
    return F.when(stored.isNotNull(), stored == current).otherwise(digest == wanted)


def arc_entry(entry: Column) -> Column:
    """Struct (role, bars) of "drop 16"; bars are null without a number."""
    words = F.filter(F.split(F.trim(entry), r"\s+"), lambda w: w != "")
    numbered = (F.size(words) == 2) & F.get(words, F.lit(1)).rlike("^[0-9]+$")
    return F.struct(F.when(numbered, F.get(words, F.lit(0))).otherwise(F.trim(entry)).alias("role"), F.when(numbered, F.get(words, F.lit(1)).cast("int")).alias("bars"))


def quote_loops(bars: Column, bpm: float, least: float = 8.0, most: float = 30.0) -> Column:
    """How often a phrase plays so that it lasts 8 to 30 s."""
    seconds = bars * 240.0 / bpm
    return F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), F.ceil(least / seconds - 1e-9)), F.floor(most / seconds))).cast("int")


def bed_bars(duration: Column, spoken: Column, bpm: float, tail: float, lead: float = 0.0) -> Column:
    """Whole bars that hold a clip, and ``tail`` beats after its last word."""
    beat = 60.0 / bpm
    return F.greatest(F.lit(1), F.ceil((lead + F.greatest(duration / beat, spoken / beat + tail)) / 4 - 1e-9)).cast("int")


def sample_spans(sections: DataFrame, bpm: float, rate: int) -> DataFrame:
    """Adds first and last sample of sections (start_bar, bars), half to even."""
    bar = 240.0 / bpm * rate
    return sections.withColumn("first_sample", F.bround(F.col("start_bar") * bar).cast("long")).withColumn("end_sample", F.bround((F.col("start_bar") + F.col("bars")) * bar).cast("long"))


def earlier_quotes(clips: DataFrame, song: str, length: str, clip: str, start: str, end: str) -> DataFrame:
    """Each range once per song: the id that its first length gave it, and all lengths that play it."""
    return clips.groupBy(song, start, end).agg(F.min_by(clip, length).alias("id"), F.array_join(F.array_sort(F.collect_set(length)), ",").alias("lengths"))


def next_numbers(live: DataFrame, archived: DataFrame, song: str, take: str) -> DataFrame:
    return live.select(song, take).unionByName(archived.select(song, take)).groupBy(song).agg((F.coalesce(F.max(take), F.lit(0)) + 1).alias("next"))


def section_levels(frames: DataFrame, spans: DataFrame, key: str, at: str, x: str, width: float) -> DataFrame:
    """(key, n, level_db): level of the frames inside each span [a, b), -120 where none or silent."""
    from .intervals import containing_join

    inside = containing_join(frames, spans, [key], at, ("a", "b"), width)
    rms = F.sqrt(F.avg(F.col(x) * F.col(x)))
    levels = inside.groupBy(key, "n").agg(F.when(rms > 0, 20 * F.log10(rms)).otherwise(-120.0).alias("level_db"))
    return spans.select(key, "n").join(levels, [key, "n"], "left").select(key, "n", F.coalesce("level_db", F.lit(-120.0)).alias("level_db"))


def loudness_summary(log: Column) -> Column:
    """Struct of the last summary of a loudness log: integrated, range, peak; silence, -inf and a missing summary are null."""
    tail = F.when(F.locate("Summary:", log) > 0, F.substring_index(log, "Summary:", -1))
    number = lambda name, unit: F.nullif(F.regexp_extract(tail, rf"{name}:\s*(-?[0-9]+(?:\.[0-9]+)?) {unit}", 1), F.lit("")).cast("double")
    integrated = number("I", "LUFS")
    return F.struct(F.when(integrated > -70, integrated).alias("integrated"), F.when(integrated > -70, number("LRA", "LU")).alias("range"), number("Peak", "dBFS").alias("peak"))


def rotation(values: Column, by: Column) -> Column:
    """An array turned right by ``by`` places, as key profiles are by their tonic."""
    n = F.size(values)
    return F.transform(values, lambda _, i: F.get(values, F.pmod(i - by, n)))


def key_relation(tonic_a: Column, mode_a: Column, tonic_b: Column, mode_b: Column) -> Column:
    """same, relative (the same tones) or other; a minor key has the tones of the major key three semitones up."""
    home = lambda t, m: F.pmod(t + F.when(m == "minor", 3).otherwise(0), F.lit(12))
    return F.when((tonic_a == tonic_b) & (mode_a == mode_b), "same").when(home(tonic_a, mode_a) == home(tonic_b, mode_b), "relative").otherwise("other")


def return_point(word_end: Column, passage_end: Column, bpm: float, rate: int, most_beats: float = 2.0, breath: float = 1.0) -> Column:
    """Where music comes back after words: the next section if near, else the first beat a breath later."""
    beat = 60.0 / bpm * rate
    later = F.bround(F.ceil((word_end + breath * beat) / beat - 1e-9) * beat)
    return F.when(passage_end - word_end <= most_beats * beat, passage_end).otherwise(F.least(passage_end, later)).cast("long")


def window_bounds(total: Column, window: float) -> Column:
    """Equal windows over [0, total): their number is total / window rounded half to even, 1 at least; edges likewise."""
    n = F.greatest(F.lit(1), F.bround(total / window).cast("int"))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.bround(i * total / n).cast("long"))


def db_to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def reduction(gain: Column) -> Column:
    return 20 * F.log10(F.greatest(gain, F.lit(1e-9)))
