"""Stored runs by rule: probes, reviews, shared calls, takes, lengths, checks of styles and places, texts of plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.text import let, one_decimal

from .timeline import cycle_length, energy_bounds, placed

# Limits of styles, words of voices, seconds past the last bar, decibels of endings, words of plans.
MOST_STYLES, MOST_STYLE_CHARS, MOST_PLAN_STYLES, MOST_CHORDS = 4, 80, 50, 8
VOICES = r"vocals?|vocalists?|voices?|sing|singing|singers?|sung|lyrics?|choirs?|choral|chants?|chanting|spoken|speech|narrat[\p{L}\p{N}_]*|raps?|rapping|humming|whisper[\p{L}\p{N}_]*"
SONG_TAIL_S = 2.0
DEAD_LU, ABRUPT_DB, SETTLED_DB, SILENT_DB = 25.0, 20.0, 50.0, -80.0
TEMPO_SLACK, KEY_COST, OTHER_KEY_COST, DEAD_COST = 0.005, {"same": 0.0, "relative": 0.15}, 0.3, 0.5
SHAPE_WORDS = {"rise": ["steadily building", "rising energy throughout, from moderate to intense"], "fall": ["fading out to silence at the end"]}
PROBE = (
    "struct<streams:array<struct<codec_type:string,codec_name:string,sample_rate:string,channels:int,channel_layout:string,bit_rate:string,duration:string,disposition:struct<attached_pic:int>>>,"
    "format:struct<format_name:string,duration:string,bit_rate:string>>"
)


def probed(data: Column) -> Column:
    """A media probe's JSON as a struct about its first audio stream; null without one.

    Cover art is no video.  Bit rate: the stream's, else the file's; length: the file's, else the stream's; what isn't a number, or
    is zero, counts as absent.
    """
    number = lambda c: F.nullif(c.try_cast("double"), F.lit(0.0))

    def summary(x: Column) -> Column:
        first = F.get(F.filter(x["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))
        video = F.exists(x["streams"], lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0))
        fields = F.struct(
            F.coalesce(x["format"]["format_name"], F.lit("unknown")).alias("format_name"), F.coalesce(number(x["format"]["duration"]), number(first["duration"])).alias("duration_s"),
            video.alias("has_video"), first["codec_name"].alias("codec"), first["sample_rate"].cast("int").alias("sample_rate"), first["channels"].alias("channels"),
            first["channel_layout"].alias("channel_layout"), F.coalesce(number(first["bit_rate"]), number(x["format"]["bit_rate"])).cast("long").alias("bit_rate"),
        )
        return F.when(first.isNotNull(), fields)

    return let(F.from_json(data, PROBE), summary)


def style_faults(styles: Column) -> Column:
    """Struct of what is wrong with extra styles: too many of them, how many are too long, the voice words they hold."""
    word = rf"(?i)(?<![\p{{L}}\p{{N}}_])({VOICES})(?![\p{{L}}\p{{N}}_])"
    voiced = F.filter(F.transform(styles, lambda s: F.lower(F.regexp_extract(s, word, 1))), lambda w: w != "")
    return F.struct((F.size(styles) > MOST_STYLES).alias("many"), F.size(F.filter(styles, lambda s: F.length(s) > MOST_STYLE_CHARS)).alias("long"), voiced.alias("voiced"))


def placement_problems(sections: DataFrame, clips: DataFrame, totals: DataFrame, bpm: float) -> DataFrame:
    """(song, n, kind): a clip starts ``before`` the song, overlaps the ``one before``, or runs ``past`` its end; ``total``: the bars don't add up.

    Sections are (song, n, start_bar, bars, clip, offset_beats) with their own start bars, clips (clip, duration_s), totals (song, total_bars).
    """
    beat = 60.0 / bpm
    ends = sections.groupBy("song").agg(F.max_by(F.col("start_bar") + F.greatest(F.col("bars"), F.lit(1)), "n").alias("end_bar"))
    start = (F.col("start_bar") * 4 + F.col("offset_beats")) * beat
    at = sections.filter("clip is not null").join(clips.select("clip", "duration_s"), "clip").withColumn("s", start).withColumn("e", start + F.col("duration_s"))
    at = at.withColumn("prev", F.lag("e").over(Window.partitionBy("song").orderBy("s", "e", "n"))).join(ends, "song")
    kinds = F.array_compact(F.array(F.when(F.col("s") < 0, "before"), F.when(F.col("s") < F.col("prev") - 1e-9, "one before"), F.when(F.col("e") > F.col("end_bar") * 4 * beat + SONG_TAIL_S + 1e-9, "past")))
    wrong = totals.join(ends, "song").filter("total_bars <> end_bar").select("song", F.lit(None).cast("int").alias("n"), F.lit("total").alias("kind"))
    return at.select("song", "n", F.explode(kinds).alias("kind")).unionByName(wrong)


def endings(frames: DataFrame, stream: str, i: str, level: str, start: Column, tail: int = 2) -> DataFrame:
    """(stream, settled, abrupt) of 250 ms frames, from ``start`` to the end.

    ``settled``: one past the last frame within 50 dB of the whole song's loudest, or the start; ``abrupt``: the mean level of the last
    ``tail`` frames is within 20 dB of the loudest from the start on, unless that is silent.
    """
    by = Window.partitionBy(stream)
    rows = frames.withColumn("__s", start).withColumn("__top", F.max(level).over(by)).withColumn("__end", F.max(i).over(by))
    late = F.col(i) >= F.col("__s")
    energy = F.avg(F.when(F.col(i) > F.col("__end") - tail, F.pow(F.lit(10.0), F.col(level) / 10)))
    top = F.max(F.when(late, F.col(level)))
    settled = F.max(F.when(late & (F.col(level) >= F.col("__top") - SETTLED_DB), F.col(i) + 1))
    abrupt = (top >= SILENT_DB) & (10 * F.log10(energy + 1e-12) >= top - ABRUPT_DB)
    return rows.groupBy(stream).agg(F.coalesce(settled, F.least(F.max("__s"), F.max(i) + 1)).alias("settled"), F.coalesce(abrupt, F.lit(False)).alias("abrupt"))


def live_starts(spans: DataFrame, reference: Column) -> DataFrame:
    """(song, n, start): the last span (song, n, start, lufs) within 25 LU of the reference (null: any that is heard), else the last one."""
    live = F.col("lufs").isNotNull() & F.coalesce(F.col("lufs") >= reference - DEAD_LU, F.lit(True))
    best = F.max_by(F.struct("n", "start"), F.struct(live, "n"))
    return spans.groupBy("song").agg(best.alias("x")).select("song", "x.n", "x.start")


def for_length(base: DataFrame, overlay: DataFrame, keys: list[str], default: dict[str, object]) -> DataFrame:
    """A preset's rows with a length's values laid over them, then the defaults; the overlay's other rows are ignored."""
    values = [c for c in base.columns if c not in keys]
    over = overlay.select(*keys, *(F.col(c).alias(f"__{c}") for c in values if c in overlay.columns))
    met = base.join(over, keys, "left")
    choose = lambda c: F.coalesce(*([F.col(f"__{c}")] if c in overlay.columns else []), F.col(c), F.lit(default.get(c)))
    return met.select(*keys, *(choose(c).alias(c) for c in values))


def reviewed(order: Column, commands: Column) -> Column:
    """Struct (kept, dropped, refused) after commands (name, clips, at) over an ordered set of clips.

    ``drop`` and ``keep`` move a clip between the lists (kept ones go last), ``move`` puts a kept clip at place ``at`` from 1,
    ``order`` takes a permutation of the kept ones.  Any other command, unknown clip or bad place changes nothing and counts as refused.
    """
    state = F.struct(order.alias("kept"), F.slice(order, F.lit(1), F.lit(0)).alias("dropped"), F.lit(0).alias("refused"))
    made = lambda kept, dropped, refused: F.struct(kept.alias("kept"), dropped.alias("dropped"), refused.alias("refused"))

    def step(s: Column, c: Column) -> Column:
        clip, one = F.get(c["clips"], F.lit(0)), F.size(c["clips"]) == 1
        rest = F.filter(s["kept"], lambda k: k != clip)
        placed_at = F.concat(F.slice(rest, F.lit(1), c["at"] - 1), F.array(clip), F.filter(rest, lambda _, i: i >= c["at"] - 1))
        same = lambda a, b: F.array_sort(a) == F.array_sort(b)
        has = lambda xs: F.coalesce(F.array_contains(xs, clip), F.lit(False))
        return (
            F.when((c["name"] == "drop") & one & has(s["kept"]), made(rest, F.concat(s["dropped"], F.array(clip)), s["refused"]))
            .when((c["name"] == "keep") & one & has(s["dropped"]), made(F.concat(s["kept"], F.array(clip)), F.filter(s["dropped"], lambda k: k != clip), s["refused"]))
            .when((c["name"] == "move") & one & has(s["kept"]) & c["at"].between(1, F.size(s["kept"])), made(placed_at, s["dropped"], s["refused"]))
            .when((c["name"] == "order") & same(c["clips"], s["kept"]), made(c["clips"], s["dropped"], s["refused"]))
            .otherwise(made(s["kept"], s["dropped"], s["refused"] + 1))
        )

    return F.aggregate(commands, state, step)


def review_holds(made_for: Column, current: Column, order: Column, dropped: Column, ids: Column) -> Column:
    """Is a stored review one for the current selection, with known clips only?"""
    return made_for.eqNullSafe(current) & (F.size(F.array_except(F.array_union(order, dropped), ids)) == 0)


def shared_answers(wanted: DataFrame, calls: DataFrame, request: list[str]) -> DataFrame:
    """Adds leader: the first call (by ``made``) of another length in the run that chose this length's clips for the same request.

    Wanted are (run, length, request), calls (run, leader, made, length, request, shared): a row for each length a call answered;
    answers that were shared from another call don't count.
    """
    own = calls.filter("shared is null").select("run", "leader", "made", "length", *request)
    first = own.filter("leader <> length").groupBy("run", "length", *request).agg(F.min_by("leader", F.struct("made", "leader")).alias("leader"))
    return wanted.join(first, ["run", "length", *request], "left")


def batch_leaders(batch: DataFrame) -> DataFrame:
    """Adds leader: the first earlier length of a command (run, pos, length, needs) whose call will choose this one's clips too."""
    before = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return batch.withColumn("leader", F.first(F.when(F.col("needs"), F.col("length")), ignorenulls=True).over(before))


def take_grid(grid: Column, response: Column) -> Column:
    """Chunk lengths of a take: stored, or from the plan in its first response; null if a chunk there has none."""
    chunks = F.from_json(response, "struct<composition_plan:struct<chunks:array<struct<duration_ms:bigint>>>>")["composition_plan"]["chunks"]
    found = F.when((F.size(chunks) > 0) & ~F.exists(chunks, lambda c: c["duration_ms"].isNull()), F.transform(chunks, lambda c: c["duration_ms"]))
    return F.coalesce(grid, found)


def undone(file: Column, history: Column, gone: Column) -> Column:
    """Struct (file, history, undone): a take one version back; unchanged without an earlier version."""
    back = F.struct(F.element_at(history, -1).alias("file"), F.slice(history, F.lit(1), F.greatest(F.size(history) - 1, F.lit(0))).alias("history"), F.concat(gone, F.array(file)).alias("undone"))
    return F.when(F.size(history) > 0, back).otherwise(F.struct(file.alias("file"), history.alias("history"), gone.alias("undone")))


def measured_spans(sections: DataFrame, bpm: float) -> DataFrame:
    """(song, n, energy, from_s, to_s): what a take is measured against, in music time; silences and rests are left out."""
    bar = 240.0 / bpm
    rows = energy_bounds(placed(sections)).filter("not silent and not rest")
    return rows.select("song", "n", F.round((F.col("e_start") + F.col("e_end")) / 2, 4).alias("energy"), F.round(F.col("music_bar") * bar, 4).alias("from_s"), F.round((F.col("music_bar") + F.col("bars")) * bar, 4).alias("to_s"))


def listed(df: DataFrame, key: str, order: str, line: Column, sep: str = "\n") -> DataFrame:
    """(key, text): a line per row, in order."""
    rows = df.select(key, order, line.alias("__line")).filter("__line is not null")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__line"))), lambda x: x["__line"]), sep).alias("text"))


def sentence_line(number: Column, start_s: Column, end_s: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(" | "), one_decimal(start_s), F.lit("-"), one_decimal(end_s), F.lit(" | "), one_decimal(end_s - start_s), F.lit("s | "), text)


def part_line(role: Column, bars: Column, clips: Column, alone: Column, styles: Column) -> Column:
    """A part of an arc as a line: clips of speech, bars of music, styles of its own."""
    extra = F.when(F.size(styles) > 0, F.concat(F.lit(" ["), F.array_join(styles, "; "), F.lit("]"))).otherwise("")
    speech = F.concat(F.lit("- speech_bed"), F.when(alone, " (alone)").otherwise(""), F.lit(": "), F.array_join(clips, ", "), extra)
    return F.when(role == "speech_bed", speech).otherwise(F.concat(F.lit("- "), role, F.lit(": "), bars.cast("string"), F.lit(" bars"), extra))


def deduped(styles: Column, most: int = MOST_PLAN_STYLES) -> Column:
    """Trimmed styles, the first of those that differ only by case or blanks, at most ``most``."""
    first = lambda clean, low: F.slice(F.filter(clean, lambda s, i: F.array_position(low, F.lower(s)) == i + 1), F.lit(1), F.lit(most))
    clean = F.filter(F.transform(styles, lambda s: F.trim(s)), lambda s: s != "")
    return let(clean, lambda xs: let(F.transform(xs, lambda s: F.lower(s)), lambda low: first(xs, low)))


def shape_words(shape: Column) -> Column:
    lists = {k: F.array(*map(F.lit, v)) for k, v in SHAPE_WORDS.items()}
    return F.when(shape == "rise", lists["rise"]).when(shape == "fall", lists["fall"]).otherwise(F.array().cast("array<string>"))


def chord_words(chords: Column, speech: Column) -> Column:
    """Chords as words: neighbours that repeat collapse, then the shortest cycle, eight names at most."""
    text = lambda head, cycle: F.array(F.concat(F.lit(head), F.array_join(cycle, " - ")))
    words = lambda cycle: F.when(F.size(cycle) == 1, text("harmony resting on ", cycle)).when(speech, text("slow chord changes ", cycle)).otherwise(text("chord progression ", cycle))
    once = lambda names: let(F.slice(names, F.lit(1), F.least(cycle_length(names), F.lit(MOST_CHORDS))), words)
    none = F.array().cast("array<string>")
    return let(chords, lambda cs: let(F.filter(cs, lambda c, i: (i == 0) | (c != F.get(cs, i - 1))), lambda names: F.when(F.size(names) == 0, none).otherwise(once(names))))


def passage_gains(passages: DataFrame, margin: float, most_cut: float) -> DataFrame:
    """Adds margin_db and gain_db to (…, speech_db, music_db): music comes down until it sits ``margin`` under the speech, by ``most_cut`` (negative) at most."""
    under = F.col("speech_db") - F.col("music_db")
    gain = F.greatest(F.lit(most_cut), F.least(F.lit(0.0), under - margin))
    return passages.withColumn("margin_db", F.round(under, 2)).withColumn("gain_db", F.round(gain, 2))


def stage_table(stages: DataFrame, lengths: DataFrame, records: DataFrame) -> DataFrame:
    """(run, length, stage, state, took): every stage of a run, those of songs for each of its lengths (others: length ``-``).

    Stages are (stage, pos, scope), lengths (run, length), records (run, length, stage, status, took).  The stages are a fixed list.
    """
    runs = lengths.select("run").distinct()
    songs = lengths.select("run", "length", F.lit("song").alias("scope"))
    rows = runs.select("run", F.lit("-").alias("length"), F.lit("run").alias("scope")).unionByName(songs).join(F.broadcast(stages), "scope")
    return rows.join(records, ["run", "length", "stage"], "left").select("run", "length", "stage", "pos", F.coalesce("status", F.lit("not run")).alias("state"), "took")


def retry_estimates(calls: DataFrame) -> DataFrame:
    """Two rows for each call (…, usd): the call, and its retry if the answer fails its checks."""
    return calls.withColumn("description", F.explode(F.array(F.lit("call"), F.lit("retry, only if the answer fails validation"))))


def take_score(error: Column, tolerance: Column, relation: Column, correlation: Column, dead_share: Column) -> Column:
    """From 1 down: tempo off by more than a little, another key, levels that don't follow the arrangement, the share that is near-silent.

    ``error`` and ``tolerance`` are relative to the tempo; an unknown tempo costs nothing, an unknown key or correlation all.
    """
    excess = F.greatest(F.lit(0.0), F.coalesce(error, F.lit(0.0)) - TEMPO_SLACK)
    tempo = 0.4 * F.least(F.lit(1.0), excess / F.greatest(tolerance - TEMPO_SLACK, F.lit(1e-9)))
    key = F.when(relation == "same", KEY_COST["same"]).when(relation == "relative", KEY_COST["relative"]).otherwise(OTHER_KEY_COST)
    return F.round(1.0 - tempo - key - 0.3 * (1 - F.greatest(F.lit(0.0), F.coalesce(correlation, F.lit(0.0)))) - DEAD_COST * dead_share, 3)


def preset_problems(arcs: DataFrame, roles: DataFrame) -> DataFrame:
    """(preset, kind, role): an arc without speech, roles it uses that the preset lacks, and bars that a part can't have.

    Arcs are (preset, pos, role, bars), roles (preset, role, bars, silent); the speech role has neither bars nor silence of its own.
    """
    none = F.lit(None).cast("string")
    speech = F.col("role") == "speech_bed"
    mute = arcs.groupBy("preset").agg(F.bool_or(speech).alias("s")).filter("not s").select("preset", F.lit("no speech").alias("kind"), none.alias("role"))
    unknown = arcs.select("preset", "role").distinct().join(roles.select("preset", "role"), ["preset", "role"], "left_anti").select("preset", F.lit("unknown").alias("kind"), "role")
    bars = arcs.filter(F.col("bars").isNotNull() & (speech | ~F.col("bars").between(1, 64))).select("preset", F.lit("bars").alias("kind"), "role").distinct()
    own = roles.filter(speech).select("preset", F.explode(F.array_compact(F.array(F.when(F.col("bars").isNotNull(), "speech bars"), F.when(F.col("silent"), "silent speech")))).alias("kind"), "role")
    return mute.unionByName(unknown).unionByName(bars).unionByName(own)


def anchor_takes(wanted: DataFrame, takes: DataFrame, backend: str) -> DataFrame:
    """(song, take, song_id): the anchor's take a song is conditioned on: the one it was made with, else the chosen one.

    Wanted are (song, made_with, chosen), takes (song, take, archived, backend, song_id).  A take in place comes before its archived
    copy; takes of another backend, or without an id, don't count.
    """
    number = wanted.select("song", F.coalesce("made_with", "chosen").alias("take")).filter("take is not null")
    found = takes.groupBy("song", "take").agg(F.min_by(F.struct("backend", "song_id"), F.struct("archived", "song_id", "backend")).alias("t"))
    return number.join(found, ["song", "take"]).filter((F.col("t.backend") == backend) & F.col("t.song_id").isNotNull()).select("song", "take", "t.song_id")
