"""Song timelines: sections in order, their places in the song and in the music, energies, runs and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import island_ids

MAX_CHUNK_MS, MIN_CHUNK_MS = 120_000, 3_000


def in_song(song: str = "song", n: str = "n") -> Window:
    return Window.partitionBy(song).orderBy(n)


def placed(sections: DataFrame) -> DataFrame:
    """Adds start_bar (running sum of bars) and music_bar (without the rests before)."""
    before = in_song().rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("bars").over(before), F.lit(0))
    rests = F.coalesce(F.sum(F.when(F.col("rest"), F.col("bars")).otherwise(0)).over(before), F.lit(0))
    return sections.withColumn("start_bar", start).withColumn("music_bar", start - rests)


def energy_bounds(sections: DataFrame, step: float = 0.25) -> DataFrame:
    """Adds e_start and e_end: a rise climbs to the loudest of the next two sections (or by ``step``), a fall goes to 0."""
    ahead = F.coalesce(F.max("energy").over(in_song().rowsBetween(1, 2)), F.lit(0.0))
    e = F.col("energy")
    end = F.when(F.col("shape") == "rise", F.when(ahead > e, ahead).otherwise(F.least(F.lit(1.0), e + step))).when(F.col("shape") == "fall", 0.0).otherwise(e)
    return sections.withColumn("e_start", e).withColumn("e_end", end)


def bar_energies(sections: DataFrame, *kept: str) -> DataFrame:
    """(song, bar, energy): the mean energy of each bar; columns of the sections named in ``kept`` follow."""
    bounded = energy_bounds(placed(sections)).filter("bars > 0")
    bars = bounded.select("song", "start_bar", "bars", "e_start", "e_end", *kept, F.explode(F.sequence(F.lit(0), F.col("bars") - 1)).alias("k"))
    return bars.select("song", (F.col("start_bar") + F.col("k")).alias("bar"), (F.col("e_start") + (F.col("e_end") - F.col("e_start")) * (F.col("k") + 0.5) / F.col("bars")).alias("energy"), *kept)


def passages(sections: DataFrame) -> DataFrame:
    """Sections with a clip, numbered in runs that touch and share their treatment (rest or not)."""
    beds = placed(sections).filter("clip is not null")
    w = in_song()
    touch = (F.lag(F.col("start_bar") + F.col("bars")).over(w) == F.col("start_bar")) & (F.lag("rest").over(w) == F.col("rest"))
    return island_ids(beds.withColumn("__t", touch), ["song"], ["n"], ~F.col("__t"), "passage").drop("__t")


def bounds_ms(sections: DataFrame, bpm: float) -> DataFrame:
    """Adds start_ms and end_ms in the music; a rest takes no time there."""
    bar = 240_000.0 / bpm
    at = placed(sections).withColumn("start_ms", F.bround(F.col("music_bar") * bar).cast("long"))
    return at.withColumn("end_ms", F.when(F.col("rest"), F.col("start_ms")).otherwise(F.bround((F.col("music_bar") + F.col("bars")) * bar).cast("long")))


def role_spans(sections: DataFrame, bpm: float) -> DataFrame:
    """(song, role, k, start_ms, end_ms): where each role sounds, neighbours of a role joined; k counts per role from 1."""
    sounding = bounds_ms(sections, bpm).filter("not silent and not rest and end_ms > start_ms")
    w = in_song()
    joined = (F.lag("role").over(w) == F.col("role")) & (F.lag("end_ms").over(w) == F.col("start_ms"))
    runs = island_ids(sounding.withColumn("__j", joined), ["song"], ["n"], ~F.col("__j"), "__run")
    spans = runs.groupBy("song", "role", "__run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return spans.withColumn("k", F.row_number().over(Window.partitionBy("song", "role").orderBy("start_ms"))).drop("__run")


def anchored(spans: DataFrame, wanted: DataFrame, most: int = 30_000) -> DataFrame:
    """Ordinal join: the k-th of ``count`` takes the anchor's k-th, the last its last; at most ``most`` ms from the middle."""
    sizes = spans.groupBy("role").agg(F.max("k").alias("size"))
    pick = F.when(F.col("number") == F.col("count"), F.col("size")).otherwise(F.least("number", "size"))
    met = wanted.join(sizes, "role").withColumn("k", pick).join(spans, ["role", "k"])
    extra = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms") - most)
    cut = F.col("start_ms") + F.floor(extra / 2)
    return met.select(*wanted.columns, cut.alias("from_ms"), F.when(extra > 0, cut + most).otherwise(F.col("end_ms")).alias("to_ms"))


def cycle_length(names: Column) -> Column:
    """The shortest period that repeats through an array."""
    fits = lambda p: F.forall(F.transform(names, lambda x, i: x == F.get(names, i % p)), lambda ok: ok)
    return F.when(F.size(names) > 0, F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.size(names), F.lit(1))), fits), F.lit(0)))


def tail_limits(clips: DataFrame, key: str, start: str, end: str, total: Column, most: int) -> DataFrame:
    """Adds limit: how long a tail may ring, until the next start or the end of the song."""
    nxt = F.coalesce(F.lead(start).over(Window.partitionBy(key).orderBy(start, end)), total)
    return clips.withColumn("limit", F.greatest(F.lit(0), F.least(F.lit(most), nxt - F.col(end))))


def structure_problems(sections: DataFrame, clips: DataFrame) -> DataFrame:
    """(song, n, kind): gaps between sections, empty sections, unknown clips.  ``sections`` bring their own start_bar."""
    w = in_song()
    expected = F.coalesce(F.lag(F.col("start_bar") + F.greatest(F.col("bars"), F.lit(1))).over(w), F.lit(0))
    checked = sections.withColumn("__e", expected)
    gap = checked.filter("start_bar <> __e").select("song", "n", F.lit("gap").alias("kind"))
    empty = checked.filter("bars < 1").select("song", "n", F.lit("empty").alias("kind"))
    unknown = checked.filter("clip is not null").join(clips.select("clip").distinct(), "clip", "left_anti").select("song", "n", F.lit("unknown clip").alias("kind"))
    return gap.unionByName(empty).unionByName(unknown)


def layout(sections: DataFrame, bpm: float) -> DataFrame:
    """(song, chunk, start_ms, end_ms, first_n, last_n): sections grouped into chunks of 3 to 120 s.

    Whether a section joins the chunk before depends on how long that has become, so a song is one ordered fold.
    """
    rows = bounds_ms(sections, bpm).filter("not rest")
    song = rows.groupBy("song").agg(F.array_sort(F.collect_list(F.struct("n", "role", "silent", "start_ms", "end_ms"))).alias("s"))

    def chunks(items: list) -> list[list]:
        out: list[list] = []
        lead = None
        for x in items:
            last = out[-1] if out else None
            if x["silent"] and last is None:
                lead = lead or x
            elif x["silent"] or last is not None and last[0] == x["role"] and x["end_ms"] - last[1] <= MAX_CHUNK_MS:
                last[2], last[4] = x["end_ms"], x["n"]
            else:
                out.append([x["role"], x["start_ms"], x["end_ms"], x["n"], x["n"]])
                if lead:
                    out[0][1], out[0][3], lead = lead["start_ms"], lead["n"], None
        wide: list[list] = []
        for c in out:
            if c[2] - c[1] < MIN_CHUNK_MS and wide:
                wide[-1][2], wide[-1][4] = c[2], c[4]
            else:
                wide.append(c)
        if len(wide) > 1 and wide[0][2] - wide[0][1] < MIN_CHUNK_MS:
            first = wide.pop(0)
            wide[0][1], wide[0][3] = first[1], first[3]
        cut = []
        for _, a, b, n0, n1 in wide:
            parts = max(1, -(-(b - a) // MAX_CHUNK_MS))
            edges = [a + round(i * (b - a) / parts) for i in range(parts + 1)]
            cut += [(x, y, n0, n1) for x, y in zip(edges, edges[1:], strict=False)]
        return cut

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(song, i, *c) for song, s in zip(pdf["song"], pdf["s"], strict=True) for i, c in enumerate(chunks(list(s)))]
            yield pd.DataFrame(rows, columns=["song", "chunk", "start_ms", "end_ms", "first_n", "last_n"])

    return song.mapInPandas(run, "song bigint, chunk bigint, start_ms bigint, end_ms bigint, first_n bigint, last_n bigint")
