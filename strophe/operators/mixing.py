"""Where voices and music meet on a timeline: levels, phrases, gain curves, note loops, window maps."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dead_sections(df: DataFrame, song: str, n: str, level: str, under: float = 32.0) -> DataFrame:
    """Sections, but for the last, at least ``under`` dB below the loudest of all."""
    by = Window.partitionBy(song)
    marked = df.withColumn("__top", F.max(level).over(by)).withColumn("__last", F.max(n).over(by)).withColumn("__c", F.count("*").over(by))
    return marked.filter((F.col("__c") >= 2) & (F.col(n) < F.col("__last")) & (F.col(level) <= F.col("__top") - under)).select(song, n)


def velocities(df: DataFrame, song: str, level: str) -> DataFrame:
    """Adds velocity: 50 to 100 over the top 30 dB of the song."""
    down = F.max(level).over(Window.partitionBy(song)) - F.col(level)
    return df.withColumn("velocity", F.bround(50 + 50 * F.greatest(F.lit(0.0), 1 - down / 30)).cast("int"))


def last_phrase(words: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """(key, i): first word of the last phrase: the latest mark or clip change that leaves ``low`` to ``high`` ms, else the longest pause.

    Words (key, i from 0, w, clip, start_ms, end_ms).
    """
    by = Window.partitionBy(key).orderBy("i")
    left = F.max("end_ms").over(Window.partitionBy(key)) - F.col("start_ms")
    ends = F.regexp_replace(F.lag("w").over(by), "[\"')”’»]+$", "").rlike("[,;:.!?—–…]$")
    fits = words.withColumn("__left", left).withColumn("__mark", ends | (F.lag("clip").over(by) != F.col("clip"))).withColumn("__gap", F.col("start_ms") - F.lag("end_ms").over(by))
    fits = fits.filter((F.col("i") >= 1) & F.col("__left").between(low, high))
    return fits.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("__mark"), F.col("i"))), F.max_by("i", F.struct("__gap", "i"))).alias("i"))


def eased_gains(spans: DataFrame, song: str, n: str, start: str, end: str, gain: str, ramp: int, hop: int) -> DataFrame:
    """(song, at, gain) every ``hop`` samples: a section's gain, easing into the next one's over its last ``ramp``."""
    by = Window.partitionBy(song).orderBy(n)
    near = spans.withColumn("__next", F.coalesce(F.lead(gain).over(by), F.col(gain))).filter(F.col(end) > F.col(start))
    at = near.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col(end) - 1 - F.ceil(F.col(start) / hop) * hop) / hop))), lambda k: F.ceil(F.col(start) / hop) * hop + k * hop)))
    at = at.filter((F.col("at") >= F.col(start)) & (F.col("at") < F.col(end)))
    begin = F.greatest(F.col(start), F.col(end) - ramp)
    shape = F.when(F.col("at") >= begin, 0.5 - 0.5 * F.cos(math.pi * (F.col("at") - begin) / (F.col(end) - begin))).otherwise(0.0)
    return at.select(song, "at", (F.col(gain) + (F.col("__next") - F.col(gain)) * shape).alias("gain"))


def faded(values: Column, fade: int) -> Column:
    """An array with raised-cosine ramps over its first and last ``fade`` elements; the inside stays as it is."""
    n = F.least(F.lit(fade), F.floor(F.size(values) / 2).cast("int"))
    ramp = lambda i: 0.5 - 0.5 * F.cos(math.pi * (i + 0.5) / n)
    return F.transform(values, lambda x, i: F.when(i < n, x * ramp(i)).when(i >= F.size(values) - n, x * ramp(F.size(values) - 1 - i)).otherwise(x))


def looped_notes(notes: DataFrame, spans: DataFrame, loop: int) -> DataFrame:
    """Notes (phrase, start, beats) repeated every ``loop`` beats into spans (phrase, song, n, from_beat, to_beat), cut at their ends."""
    met = spans.join(notes, "phrase").filter("to_beat > from_beat")
    times = F.ceil((F.col("to_beat") - F.col("from_beat")) / loop).cast("int")
    rows = met.withColumn("k", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("at", F.col("from_beat") + F.col("k") * loop + F.col("start"))
    return rows.filter("at < to_beat").select("song", "n", "at", F.least(F.col("beats"), F.col("to_beat") - F.col("at")).alias("beats"))


def looped_counts(notes: DataFrame, spans: DataFrame, loop: int) -> DataFrame:
    """(song, n, at, beats, notes): the rows of :func:`looped_notes` counted, for spans that are distinct by (song, n) and notes that start inside the loop (others raise).

    The notes are counted before they are laid: only those that an end cuts to the same length still meet, and the first of them
    has their number.  So no laid row is grouped.
    """
    own = notes.filter("start IS NOT NULL").groupBy("phrase", "start", F.coalesce("beats", F.lit(math.inf)).alias("beats")).agg(F.count("*").alias("__n"))
    by = Window.partitionBy("phrase", "start").orderBy("beats")
    own = own.withColumn("__before", F.lag("beats").over(by)).withColumn("__rest", F.sum("__n").over(by.rowsBetween(0, Window.unboundedFollowing)))
    start = F.when((F.col("start") >= 0) & (F.col("start") < loop), F.col("start")).otherwise(F.raise_error(F.lit(f"a note starts outside the loop of {loop}")).cast("double"))
    met = spans.join(own.withColumn("start", start), "phrase").filter("to_beat > from_beat")
    times = F.ceil((F.col("to_beat") - F.col("from_beat")) / loop).cast("int")
    rows = met.withColumn("k", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("at", F.col("from_beat") + F.col("k") * loop + F.col("start"))
    left = F.col("to_beat") - F.col("at")
    first = rows.filter("at < to_beat").filter((F.col("beats") < left) | F.col("__before").isNull() | (F.col("__before") < left))
    return first.select("song", "n", "at", F.least(F.col("beats"), left).alias("beats"), F.when(F.col("beats") < left, F.col("__n")).otherwise(F.col("__rest")).alias("notes"))


def windowed_map(df: DataFrame, stream: str, i: str, window: int, context: int, fold: Callable[[Column], Column]) -> DataFrame:
    """(stream, block, value): ``fold`` over each window of rows with ``context`` rows on both sides, by copying rows to the windows they touch."""
    lo = F.greatest(F.lit(0), F.floor((F.col(i) - context) / window))
    hi = F.floor((F.col(i) + context) / window)
    last = F.floor(F.max(i).over(Window.partitionBy(stream)) / window)
    copies = df.withColumn("__last", last).withColumn("block", F.explode(F.sequence(lo, F.least(hi, F.col("__last")))))
    return copies.groupBy(stream, "block").agg(fold(F.col(i)).alias("value"), F.count("*").alias("rows"))


def note_pieces(df: DataFrame, key: str, i: str, midi: str, level: str, most_gap: int = 3, dip: float = 6.0, least: int = 6, voiced: float = 0.5) -> DataFrame:
    """(key, start, end, pitch, level): voiced stretches (gaps over ``most_gap`` part them) cut at level dips, as notes.

    A cut moves the loudest point to its left, so each stretch is one small batch kernel; stretches come from windows.
    """
    by = Window.partitionBy(key).orderBy(i)
    heard = df.filter(F.col(midi).isNotNull()).withColumn("__prev", F.lag(i).over(by))
    fresh = F.coalesce(F.col(i) - F.col("__prev") > most_gap + 1, F.lit(True))
    ends = heard.withColumn("__s", F.sum(F.when(fresh, 1).otherwise(0)).over(by)).groupBy(key, "__s").agg(F.min(i).alias("a"), (F.max(i) + 1).alias("b"))
    inside = df.join(ends, key).filter((F.col(i) >= F.col("a")) & (F.col(i) < F.col("b")))
    arrays = inside.groupBy(key, "a").agg(F.array_sort(F.collect_list(F.struct(i, midi, level))).alias("x")).select(key, "a", F.col(f"x.{midi}").alias("m"), F.col(f"x.{level}").alias("l"))

    def cuts(levels: list[float]) -> list[int]:
        found, left = [], 0
        for j in range(1, len(levels) - 1):
            if levels[j] <= levels[j - 1] and levels[j] <= levels[j + 1] and levels[j] <= min(max(levels[left:j]), max(levels[j + 1 :])) - dip:
                found.append(j)
                left = j
        return found

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for k, a, m, lv in zip(pdf[key], pdf["a"], pdf["m"], pdf["l"], strict=True):
                pitches = np.array([np.nan if x is None else x for x in m], dtype=float)
                edges = [0, *cuts(list(lv)), len(pitches)]
                for s, e in zip(edges, edges[1:], strict=False):
                    known = pitches[s:e][~np.isnan(pitches[s:e])]
                    if e - s >= least and len(known) >= voiced * (e - s):
                        out.append((k, int(a) + s, int(a) + e, float(np.median(known)), float(max(lv[s:e]))))
            yield pd.DataFrame(out, columns=[key, "start", "end", "pitch", "level"])

    return arrays.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, start bigint, end bigint, pitch double, level double")
