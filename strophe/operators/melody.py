"""Melodies of talks from their pitch segments, end to end: tuning, key, snapping, octave, tempo, grid and chords.

Each step is an operator over all talks at once and is written, so no step is made twice.  With ``stages``, every step is kept for the
fingerprint of its inputs and parameters, so a change of one parameter makes only what depends on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.plans.cache import Stages
from strophe.storage import written

from . import theory as H
from .mixing import velocities

VERSION = 1


class Steps:
    """Runs steps by name; each gives a table and the fingerprint that later steps depend on."""

    def __init__(self, stages: Stages | None, source: str) -> None:
        self.stages, self.prints = stages, {"source": source}

    def __call__(self, name: str, inputs: list[str], params: dict, make: Callable[[], DataFrame]) -> DataFrame:
        if self.stages is None:
            return written(make(), name)
        df, self.prints[name], _ = self.stages.run(name, VERSION, {i: self.prints[i] for i in inputs}, params, make)
        return df


def scale_of(tonic: Column, mode: Column) -> Column:
    tones = F.when(mode == "major", F.array(*map(F.lit, H.SCALES["major"]))).otherwise(F.array(*map(F.lit, H.SCALES["minor"])))
    return F.transform(tones, lambda s: F.pmod(s + tonic, F.lit(12)))


def melodies(
    segments: DataFrame, clips: DataFrame, bpm: float = 120.0, tolerance: float = 4.0, grid: float = 0.5, strength: float = 0.8, prefer: str = "minor", fallback: tuple[int, str] = (9, "minor"),
    stages: Stages | None = None, source: str = "", harmony: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Talks (talk, tonic, mode, tuning, shift, bpm, cost), notes (talk, clip, i, start_beat, beats, midi, pitch, velocity) and chords (talk, clip, bar, degree).

    Segments are (talk, clip, i, start, end, pitch, level), times from the start of their clip; clips are (talk, clip, duration).  A talk
    whose pitches fit no key takes ``fallback``; a talk without segments has no melody, a clip without any has chords alone.
    Who wants no chords says so (``harmony`` false: None instead), as each step is made at once.
    """
    spark, step = segments.sparkSession, Steps(stages, source)
    weighted = segments.withColumn("weight", F.col("end") - F.col("start"))
    tuned = step("melody-tuning", ["source"], {}, lambda: weighted.groupBy("talk").agg(H.tuning(F.col("pitch"), F.col("weight")).alias("tuning")))
    own = weighted.join(tuned, "talk").withColumn("tuned", F.col("pitch") - F.col("tuning"))

    def found_keys() -> DataFrame:
        hist = H.pitch_classes(own, "talk", "tuned", "weight")
        best = H.ranked_keys(hist, "talk", H.keys(spark), prefer).filter("rank = 1")
        named = best.select("talk", (F.col("k") % 12).alias("tonic"), "mode")  # keys are listed by mode, then tonic
        every = tuned.select("talk").join(named, "talk", "left")
        return every.select("talk", F.coalesce("tonic", F.lit(fallback[0])).alias("tonic"), F.coalesce("mode", F.lit(fallback[1])).alias("mode"))

    key = step("melody-keys", ["source", "melody-tuning"], {"prefer": prefer, "fallback": fallback}, found_keys)
    snapped = own.join(key, "talk").withColumn("snapped", H.snapped(F.col("tuned"), scale_of(F.col("tonic"), F.col("mode")), strength))
    placed = step("melody-places", ["source", "melody-keys"], {"strength": strength}, lambda: H.in_octaves(snapped, "talk", "snapped"))
    timed = clips.select("talk", "duration", F.lit(None).cast("double").alias("onset")).unionByName(segments.select("talk", F.lit(None).cast("double").alias("duration"), F.col("start").alias("onset")))
    beats = step("melody-tempo", ["source"], {"bpm": bpm, "tolerance": tolerance, "grid": grid}, lambda: H.tempo(timed, "talk", "duration", "onset", bpm, tolerance, grid))

    def gridded() -> DataFrame:
        rows = placed.join(beats.select("talk", "bpm"), "talk").withColumn("key", F.struct("talk", "clip"))
        notes = H.quantized(velocities(rows, "key", "level"), "key", "i", "start", "end", F.col("bpm"), grid)
        return notes.select("talk", "clip", "i", "start_beat", "beats", F.bround("placed").cast("int").alias("midi"), F.round("placed", 3).alias("pitch"), "velocity")

    notes = step("melody-notes", ["melody-places", "melody-tempo"], {"grid": grid}, gridded)

    def harmonised() -> DataFrame:
        last = notes.groupBy("talk", "clip").agg(F.max(F.col("start_beat") + F.col("beats")).alias("last"))
        lengths = clips.join(beats.select("talk", "bpm"), "talk").join(key, "talk").join(last, ["talk", "clip"], "left")
        bars = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("duration") / (60.0 / F.col("bpm")), F.coalesce("last", F.lit(0.0))) / 4 - 1e-9))
        every = lengths.select("talk", "clip", "tonic", "mode", F.explode(F.sequence(F.lit(0).cast("long"), bars - 1)).alias("bar"))
        sounding = notes.withColumn("clip_of", F.struct("talk", "clip")).withColumn("pc", F.pmod("midi", F.lit(12)))
        w = H.bar_weights(sounding, "clip_of", "start_beat", "beats", "pc").select("clip_of.talk", "clip_of.clip", "bar", "pc", "w")
        turned = every.join(w, ["talk", "clip", "bar"], "left").withColumn("step", F.pmod(F.col("pc") - F.col("tonic"), F.lit(12)))
        held = F.map_from_entries(F.filter(F.collect_list(F.struct("step", "w")), lambda x: x["step"].isNotNull()))
        weights = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda p: F.coalesce(F.try_element_at(F.col("held"), p), F.lit(0.0)))
        rows = turned.groupBy("talk", "clip", "bar", "mode").agg(held.alias("held")).select(F.struct("talk", "clip").alias("key"), "bar", "mode", weights.alias("w"))
        rows = written(rows, "melody-bars")  # read by each mode, which also asks for the longest
        found = [H.chord_rows(rows.filter(F.col("mode") == m), "key", "bar", "w", m, 0) for m in H.SCALES]
        return found[0].unionByName(found[1]).select("key.talk", "key.clip", "bar", "degree")

    chords = step("melody-chords", ["melody-notes", "melody-keys"], {}, harmonised) if harmony else None
    talks = key.join(tuned, "talk").join(placed.groupBy("talk").agg(F.first("shift").alias("shift")), "talk").join(beats, "talk")
    return talks.select("talk", "tonic", "mode", "tuning", "shift", "bpm", "cost"), notes, chords
