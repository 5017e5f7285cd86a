"""Songs and talks by rule: key spelling, song length, spans of flagged words, checks of arcs, choices by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.functions.text import let

from .intervals import runs_where
from .theory import LETTERS, SCALES, TONICS

# Keys written with flats, limits of an arc, seconds and decibels of endings, words and entries.
FLAT_KEYS = {"major": [1, 3, 5, 8, 10], "minor": [0, 2, 3, 5, 7, 10]}
FLATS = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]
SHARPS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MOST_PARTS, MOST_PART_BARS, MOST_MUSIC_BARS, MOST_ALONE = 40, 32, 160, 2
RETRY_KINDS = ("invalid", "overlap", "budget", "required")
END_MARGIN_S, WORD_TAIL_S, TAIL_MS = 0.5, 0.15, 20_000
LATE_DB, ENTRY_DB = 15.0, 6.0
BEATS_PER_BAR = 4


def spelled_keys(spark: SparkSession) -> DataFrame:
    """(mode, tonic, pc, note) of all 24 keys: scale tones on consecutive letters, others by the key signature."""
    keys = spark.createDataFrame([(m, t, n[0], t in FLAT_KEYS[m], SCALES[m]) for m, names in TONICS.items() for t, n in enumerate(names)], "mode string, tonic int, letter string, flats boolean, scale array<int>")
    rows = keys.withColumn("pc", F.explode(F.sequence(F.lit(0), F.lit(11))))
    letters, places = F.array(*map(F.lit, LETTERS)), F.array(*map(F.lit, LETTERS.values()))
    step = F.array_position("scale", F.pmod(F.col("pc") - F.col("tonic"), F.lit(12))) - 1
    at = F.pmod(F.array_position(letters, F.col("letter")) - 1 + step, F.lit(7)).cast("int")
    off = (F.pmod(F.col("pc") - F.get(places, at) + 6, F.lit(12)) - 6).cast("int")
    tone = F.concat(F.get(letters, at), F.repeat(F.lit("#"), F.greatest(off, F.lit(0))), F.repeat(F.lit("b"), F.greatest(-off, F.lit(0))))
    other = F.get(F.when(F.col("flats"), F.array(*map(F.lit, FLATS))).otherwise(F.array(*map(F.lit, SHARPS))), F.col("pc"))
    return rows.select("mode", "tonic", "pc", F.when(step >= 0, tone).otherwise(other).alias("note"))


def progression_fit(degrees: Column, chords: Column, weights: Column) -> Column:
    """Mean share of a melody's weight (by pitch class) that the chords (pitch classes by degree) hold; 0 without weight."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    held = lambda d: F.aggregate(F.get(chords, d - 1), F.lit(0.0), lambda a, pc: a + F.get(weights, pc))
    return let(total, lambda t: F.when(t <= 0, 0.0).otherwise(F.aggregate(degrees, F.lit(0.0), lambda a, d: a + held(d) / t) / F.size(degrees)))


def grid_beats(grid: Column) -> Column:
    """Beats of a note value such as 1/8."""
    return 4.0 / F.element_at(F.split(grid, "/"), 2).cast("int")


def bar_seconds(bpm: Column) -> Column:
    return BEATS_PER_BAR * 60.0 / bpm


def spoken_seconds(start: Column, nominal_end: Column, duration: Column) -> Column:
    """What is spoken of a clip, within [0, duration]."""
    return F.greatest(F.lit(0.0), F.least(duration, nominal_end - start))


def ending_seconds(ending: Column, ring_out: Column, alone_ring: Column) -> Column:
    """How long an ending lasts after the last bar."""
    return F.when(ending == "held_chord", ring_out + END_MARGIN_S).when(ending == "stop", alone_ring + END_MARGIN_S).otherwise(END_MARGIN_S)


def tail_ms(version: Column, ending: Column) -> Column:
    """Music made past the last bar, where a song is held or stopped."""
    return F.when((version >= 2) & ending.isin("held_chord", "stop"), TAIL_MS).otherwise(0)


def used_slots(groups: Column, slots: Column) -> Column:
    """Which slots hold the groups: all, or the first ones and the last."""
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    return F.when(groups >= slots, upto(slots)).when(groups == 1, F.array(F.lit(0))).otherwise(F.concat(upto(groups - 1), F.array(slots - 1)))


def tempo_styles(bpm: Column, key: Column, feel: Column) -> Column:
    tempo = F.regexp_replace(F.format_string("%.6f", bpm.cast("double")), r"\.?0+$", "")
    return F.concat(F.array(F.concat(tempo, F.lit(" BPM")), key), F.when(feel != "normal", F.array(F.concat(feel, F.lit(" feel")))).otherwise(F.array().cast("array<string>")))


def word_spans(words: DataFrame, clips: DataFrame, keys: list[str], rate: float, width_ms: int) -> DataFrame:
    """Words whose middle lies in a clip, in samples of the mix, with a tail, inside the clip's own span.

    Words are (keys, pos, w, start_ms, end_ms), clips (keys, clip, clip_start, clip_end, at, until).  Cells of ``width_ms`` turn
    the range join into one by equality.
    """
    middle = (F.col("start_ms") + F.col("end_ms")) / 2
    x = words.withColumn("__m", middle).withColumn("__cell", F.floor(middle / width_ms))
    y = clips.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("clip_start") / width_ms), F.floor(F.col("clip_end") / width_ms))))
    met = x.join(y, [*keys, "__cell"]).filter((F.col("__m") >= F.col("clip_start")) & (F.col("__m") < F.col("clip_end")))
    samples = lambda ms: F.bround(ms * rate / 1000).cast("long")
    start = F.greatest(F.col("at") + samples(F.col("start_ms") - F.col("clip_start")), F.col("at"))
    end = F.least(F.col("at") + samples(F.col("end_ms") + 1000 * WORD_TAIL_S - F.col("clip_start")), F.col("until"))
    return met.select(*keys, "clip", "pos", "w", start.alias("start_sample"), end.alias("end_sample"))


def flagged_spans(words: DataFrame, keys: list[str], order: str, flagged: Column, text: str, *also: Column) -> DataFrame:
    """Runs of consecutive flagged words: first and last place, their text, and ``also`` aggregates."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("text")
    return runs_where(words, keys, order, flagged, joined, *also).drop("n")


def sentence_of(words: DataFrame, sentences: DataFrame, keys: list[str], word: str, width: int = 64) -> DataFrame:
    """Adds ``id`` of the sentence whose words [word_start, word_end) hold a word index."""
    x = words.withColumn("__cell", F.floor(F.col(word) / width))
    y = sentences.select(*keys, "id", "word_start", "word_end", F.explode(F.sequence(F.floor(F.col("word_start") / width), F.floor((F.col("word_end") - 1) / width))).alias("__cell"))
    return x.join(y, [*keys, "__cell"]).filter((F.col(word) >= F.col("word_start")) & (F.col(word) < F.col("word_end"))).drop("__cell", "word_start", "word_end")


def needs_retry(kind: Column) -> Column:
    """Aggregate: is there a problem that another answer can mend?"""
    return F.bool_or(F.coalesce(kind.isin(*RETRY_KINDS), F.lit(False)))


def usable_all(n: Column) -> Column:
    """Aggregate: usable clips over all lengths, none if one length has none."""
    return F.when(F.min(n) == 0, 0).otherwise(F.coalesce(F.sum(n), F.lit(0)))


def clip_counts(count: Column, tolerance: Column, asked: Column, required: Column) -> tuple[Column, Column, Column]:
    """Count, least and most of a selection: as asked, or the preset's give or take, never under what is required."""
    n, spread = F.coalesce(asked, count), F.when(asked.isNotNull(), 0).otherwise(tolerance)
    return n, F.greatest(F.lit(1), n - spread, required), F.greatest(n + spread, required)


def distinct_in_order(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): distinct values that aren't null or empty, in the order they first come."""
    first = df.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(key, value).agg(F.min(order).alias("__at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", value))), lambda x: x[value]).alias("values"))


def channel_levels(frames: DataFrame, keys: list[str], db: str) -> DataFrame:
    """Level per frame with the channels' energies averaged."""
    return frames.groupBy(*keys).agg((10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col(db) / 10)) + 1e-12)).alias("level_db"))


def late_entries(bars: DataFrame, most: int) -> DataFrame:
    """(song, n, late): sections after a silent one that open near-silent and come in within ``most`` bars.

    ``bars`` is (song, n, quiet, quiet_before, bar, level); a section is late if its first bar is far under its median, by the
    first bar near the median, and no later than half the section.
    """
    mid = bars.groupBy("song", "n").agg(F.median("level").alias("mid"), F.count("*").alias("n_bars"), F.min_by("level", "bar").alias("opens"), F.bool_or("quiet").alias("quiet"), F.bool_or("quiet_before").alias("before"),
        F.collect_list(F.when(F.col("bar") <= most, F.struct("bar", "level"))).alias("first"))
    slow = mid.filter(F.col("before") & ~F.col("quiet") & (F.col("opens") < F.col("mid") - LATE_DB))
    near = F.filter("first", lambda x: x["level"] >= F.col("mid") - ENTRY_DB)
    late = slow.withColumn("late", F.array_min(F.transform(near, lambda x: x["bar"])))
    return late.filter(2 * F.col("late") <= F.col("n_bars")).select("song", "n", "late")


def arc_problems(parts: DataFrame, clips: DataFrame) -> DataFrame:
    """(song, part, kind): what is wrong with an arc of parts (song, part from 1, role, bars, treatment, clips) for clips (song, pos, clip, quote).

    Known roles have a flag ``known``.  Order, quotes and totals are of the whole arc, part null.
    """
    speech = F.col("known") & (F.col("role") == "speech_bed")
    music = F.col("known") & (F.col("role") != "speech_bed")
    each = F.array_compact(
        F.array(
            F.when(~F.col("known"), "unknown role"), F.when(speech & (F.size("clips") == 0), "no clip"), F.when(music & (F.size("clips") > 0), "clips in music"),
            F.when(music & ~F.col("bars").between(1, MOST_PART_BARS), "bars"),
        )
    )
    own = parts.select("song", "part", F.explode(each).alias("kind"))
    played = parts.filter("known").select("song", "part", "treatment", F.posexplode("clips").alias("i", "clip"), (F.col("role") == "speech_bed").alias("spoken"))
    listed = lambda df, *order: df.groupBy("song").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "clip"))), lambda x: x["clip"]).alias("order"))
    order = listed(clips, "pos").join(listed(played.filter("spoken"), "part", "i").withColumnRenamed("order", "arc"), "song", "left")
    wrong = order.filter(F.coalesce(F.col("arc") != F.col("order"), F.lit(True))).select("song", F.lit("order").alias("kind"))
    quoted = parts.select("song", "part", "role", "treatment", F.explode("clips").alias("clip")).join(clips.select("song", "clip", "quote").distinct(), ["song", "clip"], "left").withColumn("quote", F.coalesce("quote", "clip"))
    torn = quoted.groupBy("song", "quote").agg(F.count_distinct("part").alias("n")).filter("n > 1").select("song", F.lit("torn quote").alias("kind"))
    mixed = quoted.filter("role = 'speech_bed' AND treatment = 'alone'").groupBy("song", "part").agg(F.count_distinct("quote").alias("n")).filter("n > 1").select("song", "part", F.lit("alone").alias("kind"))
    totals = parts.groupBy("song").agg(F.count("*").alias("n"), F.count_if(speech & (F.col("treatment") == "alone")).alias("alone"), F.sum(F.when(music, F.col("bars"))).alias("bars"))
    many = F.array_compact(F.array(F.when(F.col("n") > MOST_PARTS, "parts"), F.when(F.col("alone") > MOST_ALONE, "many alone"), F.when(F.col("bars") > MOST_MUSIC_BARS, "music bars")))
    whole = wrong.unionByName(torn).unionByName(totals.select("song", F.explode(many).alias("kind"))).select("song", F.lit(None).cast("int").alias("part"), "kind")
    return own.unionByName(mixed).unionByName(whole)


def resolved_runs(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """(ref, run, found): the run a reference names: ``latest`` (or null), its own id, or the only one it begins.

    Prefixes meet ids by their first characters, so a reference is compared only with ids that share them.
    """
    last = runs.agg(F.max("run").alias("run"))
    head = lambda c: F.substring(c, 1, 4)
    named = refs.filter("ref IS NOT NULL AND ref <> 'latest'")
    begun = runs.select("run", F.explode(F.array_distinct(F.array(*(F.substring("run", 1, k) for k in (1, 2, 3))))).alias("__p"))
    short = named.filter(F.length("ref") < 4).join(begun, F.col("ref") == F.col("__p"), "left").drop("__p")
    long = named.filter(F.length("ref") >= 4).join(runs, (head(F.col("ref")) == head(F.col("run"))) & F.startswith(F.col("run"), F.col("ref")), "left")
    met = short.unionByName(long).groupBy("ref").agg(F.count("run").alias("found"), F.max(F.when(F.col("run") == F.col("ref"), F.col("run"))).alias("same"), F.max("run").alias("only"))
    one = F.coalesce("same", F.when(F.col("found") == 1, F.col("only")))
    newest = refs.filter("ref IS NULL OR ref = 'latest'").distinct().join(F.broadcast(last))  # one row
    return met.select("ref", one.alias("run"), "found").unionByName(newest.select("ref", "run", F.col("run").isNotNull().cast("long").alias("found")))


def by_precedence(df: DataFrame, *choices: tuple[str, Column]) -> DataFrame:
    """Adds ``value`` and ``origin``: the first choice that isn't null, and its name."""
    value, origin = F.coalesce(*(c for _, c in choices)), F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in choices))
    return df.withColumns({"value": value, "origin": origin})


def uncovered_words(words: DataFrame, ranges: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Words (keys, pos) outside every range (keys, lo, hi): a running maximum of range ends over words and ranges in order."""
    marks = ranges.select(*keys, F.col("lo").alias(order), F.lit(0).alias("__kind"), F.col("hi").alias("__hi"))
    both = words.select(*keys, order, F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__hi")).unionByName(marks.withColumn("__hi", F.col("__hi").cast("long")))
    reach = F.max("__hi").over(Window.partitionBy(*keys).orderBy(order, "__kind"))
    return both.withColumn("__reach", reach).filter((F.col("__kind") == 1) & (F.coalesce("__reach", F.lit(0)) <= F.col(order))).select(*keys, order)
