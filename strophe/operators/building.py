"""Building a song from its parts: arcs with clips, sections with chords and answers, edits of a range."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.text import let

from .intervals import overlap_join
from .songs import progression_fit
from .timeline import MAX_CHUNK_MS, MIN_CHUNK_MS, in_song, placed

# Progressions of a role as scale degrees, bars for each chord, what a repeated progression costs, limits of a plan.
PROGRESSIONS = {
    "minor": {
        "intro": [[1, 6], [1, 6, 3, 7], [6, 1]],
        "build": [[6, 7, 4, 5], [4, 6, 7, 7], [6, 4, 7, 7]],
        "drop": [[1, 6, 3, 7], [6, 7, 1, 1], [1, 7, 6, 7], [6, 3, 7, 1]],
        "breakdown": [[6, 3, 7, 1], [4, 1, 6, 7], [1, 3, 6, 7]],
        "outro": [[6, 7, 1, 1], [4, 6, 1, 1]],
        "ending": [[1]],
    },
    "major": {
        "intro": [[1, 4], [1, 5, 6, 4], [4, 1]],
        "build": [[4, 5, 6, 5], [2, 4, 5, 5], [6, 4, 5, 5]],
        "drop": [[1, 5, 6, 4], [6, 4, 1, 5], [4, 1, 5, 6], [1, 6, 4, 5]],
        "breakdown": [[6, 4, 1, 5], [4, 6, 5, 1], [1, 3, 4, 5]],
        "outro": [[4, 5, 1, 1], [4, 1, 4, 1]],
        "ending": [[1]],
    },
}
BARS_PER_CHORD = {"intro": 2, "outro": 2}
REPEAT_PENALTY = 0.5
MIN_RANGE_MS, MAX_CHUNKS = 50, 30
SPEECH = "speech_bed"


def arc_parts(entries: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, role, bars, clips): an arc with groups of clips shared out over its speech slots.

    Entries are (keys, pos, role, bars), groups (keys, g, clips) with g from 0.  All slots are used, or the first ones and the last;
    speech slots without a group go.
    """
    slot = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1
    speech = entries.filter(F.col("role") == SPEECH).withColumn("__slot", slot)
    slots = speech.groupBy(*keys).agg(F.count("*").alias("__slots"))
    sizes = groups.groupBy(*keys).agg(F.count("*").alias("__groups"))
    last = (F.col("g") == F.col("__groups") - 1) & (F.col("__groups") > 1) & (F.col("__groups") < F.col("__slots"))
    at = groups.join(sizes, keys).join(slots, keys).select(*keys, F.when(last, F.col("__slots") - 1).otherwise(F.col("g")).alias("__slot"), "clips")
    filled = speech.join(at, [*keys, "__slot"]).select(*keys, "pos", "role", F.lit(None).cast("int").alias("bars"), "clips")
    music = entries.filter(F.col("role") != SPEECH).select(*keys, "pos", "role", F.col("bars").cast("int").alias("bars"), F.lit(None).cast("array<string>").alias("clips"))
    return music.unionByName(filled)


def bed_chords(own: Column, bars: Column, offset_beats: Column) -> Column:
    """A clip's chords, bar by bar: the first one through the lead-in, then round and round."""
    lead = F.least(bars, F.floor(offset_beats / 4).cast("int"))
    rest = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(bars - lead, F.lit(0))), lambda i: i < bars - lead), lambda i: F.get(own, i % F.size(own)))
    return F.concat(F.array_repeat(F.get(own, F.lit(0)), lead), rest)


def progressions(mode: Column, role: Column) -> Column:
    """The progressions a role may take in a mode; null where it has none."""
    degrees = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    table = F.create_map(*chain.from_iterable((F.lit(f"{m} {r}"), degrees(rows)) for m, roles in PROGRESSIONS.items() for r, rows in roles.items()))
    return F.try_element_at(table, F.concat_ws(" ", mode, role))


def section_chords(sections: DataFrame) -> DataFrame:
    """(song, n, degrees, chords): the progression each music section takes and its chord names by bar.

    Sections are (song, n, role, bars, mode, triads, names, weights): pitch classes and names by degree, the melody's weight by
    pitch class.  The best fit wins (equal to nine digits: the first), less a penalty for what the role's previous section took;
    so a role is one ordered fold over its few sections in a song.  An outro of two bars or more ends on the first degree.
    Roles without progressions have no rows.
    """
    options = sections.withColumn("__o", progressions(F.col("mode"), F.col("role"))).filter("__o is not null and bars >= 1")
    fits = F.transform("__o", lambda o: F.round(progression_fit(o, F.col("triads"), F.col("weights")), 9))
    lists = options.withColumn("__f", fits).groupBy("song", "role").agg(F.array_sort(F.collect_list(F.struct("n", "__f"))).alias("xs"))

    def best(x: Column, last: Column) -> Column:
        scored = F.transform(x["__f"], lambda f, i: F.struct(F.round(f - F.when(i == last, REPEAT_PENALTY).otherwise(0.0), 9).alias("s"), (-i).alias("i")))
        return -F.array_max(scored)["i"]

    none = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<n:int,pick:int>>").alias("picks"))
    step = lambda acc, x: let(best(x, acc["last"]), lambda p: F.struct(p.alias("last"), F.concat(acc["picks"], F.array(F.struct(x["n"].alias("n"), p.alias("pick")))).alias("picks")))
    picks = lists.select("song", F.explode(F.aggregate("xs", none, step)["picks"]).alias("p")).select("song", "p.n", "p.pick")
    chosen = options.join(picks, ["song", "n"]).withColumn("degrees", F.get("__o", F.col("pick")))
    per = F.coalesce(F.try_element_at(F.create_map(*chain.from_iterable((F.lit(r), F.lit(b)) for r, b in BARS_PER_CHORD.items())), F.col("role")), F.lit(1))
    named = lambda i: F.get("names", F.get("degrees", (F.floor(i / per) % F.size("degrees")).cast("int")) - 1)
    home = (F.col("role") == "outro") & (F.col("bars") >= 2)
    chords = F.transform(F.sequence(F.lit(0), F.col("bars") - 1), lambda i: F.when(home & (i == F.col("bars") - 1), F.get("names", F.lit(0))).otherwise(named(i)))
    return chosen.select("song", "n", "degrees", chords.alias("chords"))


def arranged(sections: DataFrame, noted: DataFrame, bpm: float, layer_roles: tuple[str, ...]) -> DataFrame:
    """Sections of (song, n, role, bars, clip, silent, rest, shape, main, ending) as an arrangement.

    Adds start_bar, start_s and seconds; occurrence (a role's first or last of several); replay (the clip heard last, in the
    layer's roles); answers (the clip that the first music after a passage answers, at first ``main``, where ``noted`` has its
    clip); home (the last bar lands on the tonic).  The last music falls in a fade; otherwise it holds, and where it is a
    passage, so does a fall before it.
    """
    w, role, whole = in_song(), Window.partitionBy("song", "role").orderBy("n"), Window.partitionBy("song")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    music = F.col("clip").isNull()
    sounding, asking = ~F.col("rest") & ~F.col("silent"), music & ~F.col("silent")
    rows = placed(sections).withColumn("__heard", F.last("clip", ignorenulls=True).over(before))
    # music that sounds before a section, and before the passage heard last: equal for the first music after it
    rows = rows.withColumn("__m", F.coalesce(F.sum(F.when(asking, 1).otherwise(0)).over(before), F.lit(0)))
    first = F.col("__m") == F.coalesce(F.last(F.when(~music, F.col("__m")), ignorenulls=True).over(before), F.lit(0))
    rows = rows.withColumn("__answer", F.when(asking & first, F.coalesce("__heard", "main")))
    # the role's sections around a section, and the song's last ones, come by one more sort
    earlier, later = (f(F.lit(True)).over(role).isNotNull() for f in (F.lag, F.lead))
    occurrence = F.when(music & ~earlier & later, "first").when(music & earlier & ~later, "last")
    last = F.max(F.when(sounding, F.struct("n", (~music).alias("spoken")))).over(whole)
    rows = rows.withColumn("occurrence", occurrence).withColumn("__last", last).withColumn("__before", F.max(F.when(sounding & music, F.col("n"))).over(whole))
    ends, holds = F.col("n") == F.col("__last.n"), F.col("ending") != "fade"
    falls = F.col("shape") == "fall"
    steady = holds & falls & (ends | (F.col("__last.spoken") & (F.col("n") == F.col("__before"))))
    shape = F.when(ends & ~holds, "fall").when(steady, "flat").otherwise(F.col("shape"))
    bar = 240.0 / bpm
    made = rows.select(
        "song", "n", "role", "bars", "start_bar", F.round(F.col("start_bar") * bar, 4).alias("start_s"), F.round(F.col("bars") * bar, 4).alias("seconds"), "occurrence",
        F.when(music & F.col("role").isin(*layer_roles), F.col("__heard")).alias("replay"), "__answer", shape.alias("shape"), F.coalesce(ends & holds, F.lit(False)).alias("home"),
    )
    # most sections answer nothing: the join deals those out by song, as one null key would bring them all to one task
    known = noted.select(F.col("clip").alias("__clip")).distinct()
    met = made.join(known, (F.coalesce("__answer", F.concat("song", F.lit(" answers none"))) == F.col("__clip")) & F.col("__answer").isNotNull(), "left")
    return met.select(*made.columns[:9], F.when(F.col("__clip").isNotNull(), F.col("__answer")).alias("answers"), "shape", "home")


def joined_spans(spans: Column) -> Column:
    """Ordered spans (a, b) with each under 3 s joined to the one before, or the next joined to it."""
    brief = lambda x: x["b"] - x["a"] < MIN_CHUNK_MS
    tip = lambda acc: F.try_element_at(acc, F.lit(-1))
    grown = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(tip(acc)["a"].alias("a"), x["b"].alias("b"))))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (brief(x) | brief(tip(acc))), grown(acc, x)).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(spans, F.slice(spans, F.lit(1), F.lit(0)), step)


def _touched(short: Column, start: str, end: str) -> tuple[Column, Column]:
    """What of a chunk is made again: all of it for a short range, else its part in the range."""
    return F.when(short, F.col(start)).otherwise(F.greatest(start, "from_ms")), F.when(short, F.col(end)).otherwise(F.least(end, "to_ms"))


def regenerated_pieces(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """(song, piece, start_ms, end_ms): a range of a song along the borders of its chunks.

    Chunks are (song, start_ms, end_ms), ranges (song, from_ms, to_ms), one per song.  A range under 3 s grows to the chunks it
    touches; a piece under 3 s joins the one before, or the next joins it.  A plan has at most 30 chunks, so this is a short fold.
    """
    met = chunks.join(ranges, "song").withColumn("__short", F.col("to_ms") - F.col("from_ms") < MIN_CHUNK_MS)
    touched = met.filter((F.col("start_ms") < F.col("to_ms")) & (F.col("end_ms") > F.col("from_ms")))
    a, b = _touched(F.col("__short"), "start_ms", "end_ms")
    lists = touched.select("song", a.alias("a"), b.alias("b")).filter("b > a").groupBy("song").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("xs"))
    return lists.select("song", F.posexplode(joined_spans(F.col("xs"))).alias("piece", "x")).select("song", "piece", F.col("x.a").alias("start_ms"), F.col("x.b").alias("end_ms"))


def with_main_section(pieces: DataFrame, bounds: DataFrame, width: int = 30_000) -> DataFrame:
    """Adds main_n: the sounding section that fills most of a piece, the first of equals; pieces without one go."""
    sounding = bounds.filter("not silent and not rest and end_ms > start_ms").select("song", "n", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    both = overlap_join(pieces, sounding, ["song"], ("start_ms", "end_ms"), ("s", "e"), width)
    shared = F.least("end_ms", "e") - F.greatest("start_ms", "s")
    return both.groupBy("song", "piece", "start_ms", "end_ms").agg(F.max_by("n", F.struct(shared, -F.col("n"))).alias("main_n"))


def kept_slices(start: Column, end: Column) -> Column:
    """[start, end) as slices no longer than a chunk may be; none if it is under 50 ms."""
    span = end - start
    parts = F.greatest(F.lit(1), F.ceil(span / MAX_CHUNK_MS)).cast("int")
    edge = lambda i: start + F.bround(i * span / parts).cast("long")
    slices = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(edge(i).alias("start_ms"), edge(i + 1).alias("end_ms")))
    return F.when(span >= MIN_RANGE_MS, slices).otherwise(F.slice(slices, F.lit(1), F.lit(0)))


def inpaint_plan(pieces: DataFrame, totals: DataFrame) -> DataFrame:
    """(song, start_ms, end_ms, main_n): what is kept around the pieces (no main_n), and the pieces; totals are (song, total_ms)."""
    edges = pieces.groupBy("song").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b")).join(totals, "song")
    kept = edges.select("song", F.explode(F.concat(kept_slices(F.lit(0).cast("long"), F.col("a")), kept_slices(F.col("b"), F.col("total_ms")))).alias("x"))
    return kept.select("song", "x.*", F.lit(None).cast("int").alias("main_n")).unionByName(pieces.select("song", "start_ms", "end_ms", F.col("main_n").cast("int").alias("main_n")))


def section_edits(bounds: DataFrame, chosen: Column) -> DataFrame:
    """The inpaint plan that makes the ``chosen`` sections of each song again, along the borders of all its sections.

    As regenerated_pieces, with_main_section and inpaint_plan on the sections of ``bounds`` (song, n, start_ms, end_ms, silent, rest), but
    a song's range, length and pieces come from its own rows, so that the sections are made and dealt once and joined to nothing.
    Only sections that meet the range are gathered.
    """
    whole = Window.partitionBy("song")
    rows = bounds.filter("song is not null").select("song", "n", "start_ms", "end_ms", (~F.col("silent") & ~F.col("rest")).alias("__s"), chosen.alias("__c"))
    mine = lambda f, c: f(F.when(F.col("__c"), F.col(c))).over(whole)
    rows = rows.withColumn("total_ms", F.max("end_ms").over(whole)).withColumn("from_ms", mine(F.min, "start_ms")).withColumn("to_ms", mine(F.max, "end_ms"))
    a, b = _touched(F.col("to_ms") - F.col("from_ms") < MIN_CHUNK_MS, "start_ms", "end_ms")
    met = (F.col("end_ms") > F.col("start_ms")) & (F.col("start_ms") < F.col("to_ms")) & (F.col("end_ms") > F.col("from_ms")) & (b > a)
    rows = rows.withColumn("__m", F.when(met, F.struct(a.alias("a"), b.alias("b"))))
    rows = rows.withColumn("__lo", F.min("__m.a").over(whole)).withColumn("__hi", F.max("__m.b").over(whole))
    near = rows.filter("end_ms > start_ms and start_ms < __hi and end_ms > __lo")
    heard = F.when(F.col("__s"), F.struct("n", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))
    songs = near.groupBy("song").agg(F.max("total_ms").alias("total_ms"), F.array_sort(F.collect_list("__m")).alias("xs"), F.collect_list(heard).alias("ys"))

    def most(x: Column) -> Column:
        both = F.filter("ys", lambda y: (x["a"] < y["e"]) & (y["s"] < x["b"]))
        return -F.array_max(F.transform(both, lambda y: F.struct((F.least(x["b"], y["e"]) - F.greatest(x["a"], y["s"])).alias("ms"), (-y["n"]).alias("n"))))["n"]

    piece = lambda x: F.struct(x["a"].alias("start_ms"), x["b"].alias("end_ms"), most(x).cast("int").alias("main_n"))
    made = songs.select("song", "total_ms", F.filter(F.transform(joined_spans(F.col("xs")), piece), lambda p: p["main_n"].isNotNull()).alias("made"))
    kept = lambda lo, hi: F.transform(kept_slices(lo, hi), lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), F.lit(None).cast("int").alias("main_n")))
    edges = F.array_min("made.start_ms"), F.array_max("made.end_ms")
    plan = made.filter(F.size("made") > 0).select("song", F.explode(F.concat(kept(F.lit(0).cast("long"), edges[0]), kept(edges[1], F.col("total_ms")), "made")).alias("x"))
    return plan.select("song", "x.*")


def inpaint_problems(plan: DataFrame) -> DataFrame:
    """(song, chunks, too_many, bad_kept, bad_made): counts of slices outside 50 ms to 120 s and of made chunks outside 3 to 120 s."""
    ms = F.col("end_ms") - F.col("start_ms")
    bad = lambda least: ~ms.between(least, MAX_CHUNK_MS)
    return plan.groupBy("song").agg(
        F.count("*").alias("chunks"), (F.count("*") > MAX_CHUNKS).alias("too_many"), F.count_if(F.col("main_n").isNull() & bad(MIN_RANGE_MS)).alias("bad_kept"), F.count_if(F.col("main_n").isNotNull() & bad(MIN_CHUNK_MS)).alias("bad_made"),
    )
