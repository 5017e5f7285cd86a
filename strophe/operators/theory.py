"""Music theory over pitch tables: tuning, keys, scales, tempo, rhythm, chords."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scan import each_block, exclusive_scan, key_starts

# Tonic names, scales, key profiles (Krumhansl and Kessler), chord priors and moves.
TONICS = {
    "major": ["C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"],
    "minor": ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "G#", "A", "Bb", "B"],
}
SCALES = {"major": [0, 2, 4, 5, 7, 9, 11], "minor": [0, 2, 3, 5, 7, 8, 10]}
PROFILES = {
    "major": [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88],
    "minor": [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17],
}
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
DEGREE_PRIOR = {
    "major": {1: 0.3, 2: 0.05, 3: 0.05, 4: 0.2, 5: 0.2, 6: 0.15, 7: 0.0},
    "minor": {1: 0.3, 2: 0.0, 3: 0.1, 4: 0.15, 5: 0.1, 6: 0.2, 7: 0.15},
}
MOVES = {
    "major": [(1, 4), (1, 5), (1, 6), (4, 5), (4, 1), (5, 1), (5, 6), (6, 4), (2, 5), (6, 2), (3, 6), (4, 2)],
    "minor": [(1, 6), (1, 4), (1, 7), (6, 7), (7, 1), (4, 5), (5, 1), (6, 3), (3, 7), (4, 1), (7, 3), (6, 4)],
}
MOVE_BONUS, STAY_BONUS, FIRST_BONUS, ROOT_BONUS, DRIFT = 0.15, 0.05, 0.2, 0.3, 0.04


def keys(spark: SparkSession) -> DataFrame:
    """The 24 keys, in listing order: (k, tonic, mode, name, pc, profile), a row per pitch class."""
    rows = [(k, tonic, mode, f"{TONICS[mode][tonic]} {mode}", pc, PROFILES[mode][(pc - tonic) % 12]) for k, (mode, tonic) in enumerate((m, t) for m in TONICS for t in range(12)) for pc in range(12)]
    return spark.createDataFrame(rows, "k int, tonic int, mode string, name string, pc int, profile double")


def triads(mode: str, tonic: int) -> list[tuple[int, list[int]]]:
    """Degree and pitch classes of the seven triads of a key."""
    scale = [(tonic + s) % 12 for s in SCALES[mode]]
    return [(i + 1, [scale[i], scale[(i + 2) % 7], scale[(i + 4) % 7]]) for i in range(7)]


def half_even(x: Column) -> Column:
    return F.bround(x)


def pitch_classes(df: DataFrame, key: str, pitch: str, weight: str) -> DataFrame:
    """(key, pc, w) for all twelve pitch classes: weight per class, 0 where none."""
    own = df.filter(F.col(pitch).isNotNull()).groupBy(key, F.pmod(half_even(F.col(pitch)).cast("int"), F.lit(12)).alias("pc")).agg(F.sum(weight).alias("w"))
    grid = own.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pc"))
    return grid.join(own, [key, "pc"], "left").select(key, "pc", F.coalesce("w", F.lit(0.0)).alias("w"))


def tuning(pitch: Column, weight: Column) -> Column:
    """Aggregate: weighted circular mean distance to the semitone grid."""
    turn = 2 * math.pi * pitch
    offset = F.atan2(F.sum(weight * F.sin(turn)), F.sum(weight * F.cos(turn))) / (2 * math.pi)
    return offset - half_even(offset)


def ranked_keys(hist: DataFrame, key: str, table: DataFrame, prefer: str | None = None, bonus: float = 0.05) -> DataFrame:
    """(key, name, score, rank): correlation of each histogram with all profiles; ties keep the listing order."""
    met = hist.join(F.broadcast(table), "pc")  # 288 rows
    scored = met.groupBy(key, "k", "name", "mode").agg(F.corr("w", "profile").alias("score")).filter("score is not null")
    scored = scored.withColumn("score", F.col("score") + F.when(F.col("mode") == prefer, bonus).otherwise(0.0)) if prefer else scored
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.round("score", 9).desc(), "k")))


def snapped(pitch: Column, scale: Column, strength: float) -> Column:
    """Towards the nearest scale tone, the lower of two equally near."""
    base = F.floor(pitch)
    tones = F.filter(F.transform(F.sequence(F.lit(-2), F.lit(3)), lambda d: (base + d).cast("int")), lambda q: F.array_contains(scale, F.pmod(q, F.lit(12))))
    nearest = F.array_min(F.transform(tones, lambda q: F.struct(F.abs(q - pitch).alias("d"), q.alias("q"))))["q"]
    return pitch + strength * (nearest - pitch)


def in_octaves(df: DataFrame, key: str, pitch: str, center: int = 60, low: int = 55, high: int = 84) -> DataFrame:
    """Adds shift (octaves that bring the median into place, in semitones) and placed (folded into the span)."""
    median = F.expr(f"percentile({pitch}, 0.5)").over(Window.partitionBy(key))
    shifted = df.withColumn("shift", (12 * F.ceil((center - median) / 12)).cast("int")).withColumn("__p", F.col(pitch) + F.col("shift"))
    up = F.greatest(F.lit(0), F.ceil((low - F.col("__p")) / 12)) * 12
    raised = F.col("__p") + up
    down = F.greatest(F.lit(0), F.ceil((raised - high) / 12)) * 12
    return shifted.withColumn("placed", raised - down).drop("__p")


def off_grid(x: Column) -> Column:
    return F.abs(x - half_even(x))


def tempo(df: DataFrame, key: str, duration: str, onset: str, bpm: float, tolerance: float, grid: float) -> DataFrame:
    """(key, bpm, cost): the whole tempo near ``bpm`` on which clips and onsets sit best; a drift costs a little."""
    low = math.ceil(bpm - tolerance - 1e-9)
    tried = df.withColumn("bpm", F.explode(F.sequence(F.lit(low), F.lit(math.floor(bpm + tolerance + 1e-9)))))
    beat = 60.0 / F.col("bpm")
    cost = F.coalesce(F.avg(off_grid(F.col(duration) / beat)), F.lit(0.0)) + 0.5 * F.coalesce(F.avg(off_grid(F.col(onset) / (beat * grid))), F.lit(0.0))
    scored = tried.groupBy(key, "bpm").agg(cost.alias("cost"))
    away = F.abs(F.col("bpm") - bpm)
    best = F.struct(F.round(F.col("cost") + DRIFT * away / tolerance, 6), away, "bpm")
    return scored.groupBy(key).agg(F.min_by(F.struct("bpm", "cost"), best).alias("b")).select(key, "b.*")


def quantized(df: DataFrame, key: str, i: str, start: str, end: str, bpm: float | Column, grid: float) -> DataFrame:
    """Notes on the grid, at least a step long; of notes with one start the longest (the first) stays; overlaps are cut."""
    beat = 60.0 / bpm
    on = lambda c: half_even(F.col(c) / beat / grid) * grid
    placed = df.withColumn("start_beat", on(start)).withColumn("beats", F.greatest(F.lit(grid), on(end) - on(start)))
    first = Window.partitionBy(key, "start_beat").orderBy(F.col("beats").desc(), i)
    kept = placed.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")
    nxt = F.lead("start_beat").over(Window.partitionBy(key).orderBy("start_beat"))
    return kept.withColumn("beats", F.least(F.col("beats"), F.coalesce(nxt - F.col("start_beat"), F.col("beats"))))


def bar_weights(notes: DataFrame, key: str, start: str, beats: str, pc: str) -> DataFrame:
    """(key, bar, pc, w): beats that each pitch class sounds in each bar of four."""
    end = F.col(start) + F.col(beats)
    bars = notes.filter(F.col(beats) > 0).withColumn("bar", F.explode(F.sequence(F.floor(F.col(start) / 4), F.ceil(end / 4) - 1)))
    over = F.least(end, 4.0 * (F.col("bar") + 1)) - F.greatest(F.col(start), 4.0 * F.col("bar"))
    return bars.groupBy(key, "bar", pc).agg(F.sum(over).alias("w"))


def chord_rows(bars: DataFrame, key: str, bar: str, w12: str, mode: str, tonic: int, block: int = 4096) -> DataFrame:
    """(key, bar, degree): the best chord per bar over the seven triads of a key (``bar`` counts from 0 in its key).

    Keys of at most a block of bars are decoded many at a time, bar by bar.  Of longer ones, the best score up to a bar is a max-plus product of its bars' matrices, so blocks of bars are scanned in both
    directions: forward for the scores that a block begins with, backward for the chord that its last bar leads to.
    Time grows with the bars; a song is as many tasks as it has blocks.  The first of equal scores wins; beyond the first
    block scores are sums in another order, equal up to rounding.
    """
    table = triads(mode, tonic)
    prior, moves = DEGREE_PRIOR[mode], set(MOVES[mode])
    step = np.array([[(MOVE_BONUS if (p, d) in moves else 0.0) + (STAY_BONUS if p == d else 0.0) for d, _ in table] for p, _ in table])
    kind = dict(bars.dtypes)[key]

    def fits(w: np.ndarray) -> np.ndarray:
        total = np.array([sum(x) for x in w.tolist()])
        fit = np.stack([w[:, pcs[0]] * (1 + ROOT_BONUS) + w[:, pcs[1]] + w[:, pcs[2]] for _, pcs in table], axis=1)
        return np.where(total[:, None] > 0, fit / np.where(total > 0, total, 1.0)[:, None], 0.0) + [prior[d] for d, _ in table]

    opening = np.array([FIRST_BONUS if d == 1 else 0.0 for d, _ in table])

    def emissions(first_bar: int, ws: list) -> np.ndarray:
        out = fits(np.array([np.asarray(x, float) for x in ws]))
        if first_bar == 0:
            out[0] += opening
        return out

    def product(columns: dict) -> list[float]:
        """Best score from each chord before the block to each chord at its end; in a song's first block there is none before."""
        e = emissions(columns[bar][0], columns[w12])
        m = np.where(np.eye(7, dtype=bool), 0.0, -np.inf)
        for i, x in enumerate(e):
            m = np.repeat(x[None, :], 7, axis=0) if i == 0 and columns[bar][0] == 0 else (m[:, :, None] + step[None]).max(axis=1) + x
        return m.ravel().tolist()

    def pointers(columns: dict, before: list | None) -> tuple[np.ndarray, np.ndarray]:
        e = emissions(columns[bar][0], columns[w12])
        score = None if before is None else np.asarray(before).reshape(7, 7).max(axis=0)
        back = np.zeros((len(e), 7), dtype=int)
        for i, x in enumerate(e):
            if score is None:
                score = x
                continue
            ways = score[:, None] + step
            back[i] = ways.argmax(axis=0)
            score = ways.max(axis=0) + x
        return back, score

    def traced(back: np.ndarray, last: int) -> list[int]:
        """States of the block's bars, and that of the bar before it."""
        path = [last]
        for row in back[::-1]:
            path.append(int(row[path[-1]]))
        return path[::-1]

    maxplus = lambda a, b: (np.asarray(a).reshape(7, 7)[:, :, None] + np.asarray(b).reshape(7, 7)[None]).max(axis=1).ravel()
    def decoded(whole: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        """Chords of all keys of a table, from the rows where they begin."""
        flat = whole.column(w12).combine_chunks().flatten()
        e = fits(flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, 12))
        e[begins[whole.column(bar).to_numpy()[begins] == 0]] += opening
        n = np.diff(np.r_[begins, len(e)])
        longest_first = np.argsort(-n, kind="stable")
        at, n = begins[longest_first], n[longest_first]
        live = [int(np.searchsorted(-n, -t, side="left")) for t in range(n[0])]  # keys with more than t bars come first
        back, score = np.zeros((len(e), 7), dtype=np.int8), e[at]
        for t in range(1, n[0]):
            ways = score[: live[t], :, None] + step
            back[at[: live[t]] + t] = ways.argmax(axis=1)
            score[: live[t]] = ways.max(axis=1) + e[at[: live[t]] + t]
        state, degree = score.argmax(axis=1), np.zeros(len(e), dtype=np.int32)
        names = np.array([d for d, _ in table], dtype=np.int32)
        for t in reversed(range(n[0])):
            here = at[: live[t]] + t
            degree[here] = names[state[: live[t]]]
            state[: live[t]] = back[here, state[: live[t]]]
        return pa.RecordBatch.from_arrays([whole.column(key).combine_chunks(), whole.column(bar).combine_chunks().cast(pa.int64()), pa.array(degree)], names=[key, bar, "degree"])

    def at_once(batches):
        held = None  # the rows of the last key, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = pa.Table.from_batches([batch]).select([key, bar, w12])
            seen = pa.concat_tables([held, seen]).combine_chunks() if held is not None else seen
            begins = key_starts(seen.column(key).combine_chunks())
            if begins[-1]:
                yield decoded(seen.slice(0, begins[-1]), begins[:-1])
            held = seen.slice(begins[-1])
        if held is not None:
            yield decoded(held, np.zeros(1, dtype=np.int64))

    rows = bars.select(key, bar, w12)
    schema, own = f"{key} {kind}, {bar} bigint, degree int", Window.partitionBy(key).orderBy(bar).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = rows.agg(F.max(bar)).first()[0] or 0
    if most < block:
        return rows.repartition(key).sortWithinPartitions(key, bar).mapInArrow(at_once, schema)
    topped = rows.withColumn("top", F.max(bar).over(own))
    short = topped.filter(F.col("top") < block).drop("top").sortWithinPartitions(key, bar).mapInArrow(at_once, schema)
    rows = topped.filter(F.col("top") >= block).drop("top").withColumn("block", F.floor(F.col(bar) / block))
    maps = each_block(rows, [key, "block"], bar, lambda c, _: [(c[key][0], c["block"][0], product(c))], f"{key} {kind}, block bigint, value array<double>")
    before = exclusive_scan(maps, key, "block", "value", maxplus)

    def to_back(columns: dict, carried: list | None) -> list[tuple]:
        back, score = pointers(columns, carried)
        lead = [float(traced(back, k)[0]) for k in range(7)]
        return [(columns[key][0], columns["block"][0], lead, int(np.argmax(score)))]

    leads = each_block(rows, [key, "block"], bar, to_back, f"{key} {kind}, block bigint, value array<double>, top bigint", before)
    ends = leads.groupBy(key).agg(F.max("block").alias("n"), F.max_by("top", "block").alias("top"))
    turned = leads.join(ends.select(key, "n"), key).select(key, (F.col("n") - F.col("block")).alias("block"), "value")
    after = exclusive_scan(turned, key, "block", "value", lambda a, b: np.asarray(b)[np.asarray(a).astype(int)])
    last = after.join(ends, key).select(key, (F.col("n") - F.col("block")).alias("block"), F.coalesce(F.get("before", F.col("top")), F.col("top").cast("double")).cast("double").alias("state"))
    both = before.join(last, [key, "block"]).select(key, "block", F.struct("before", "state").alias("before"))

    def to_rows(columns: dict, carried) -> list[tuple]:
        back, _ = pointers(columns, carried["before"])
        return [(columns[key][0], b, table[k][0]) for b, k in zip(columns[bar], traced(back, int(carried["state"]))[1:], strict=True)]

    return each_block(rows, [key, "block"], bar, to_rows, schema, both).unionByName(short)


def chords(weights: DataFrame, key: str, bar: str, w12: str, mode: str, tonic: int) -> DataFrame:
    """(key, degrees): the best chords of each key's bars in one array, ``bar`` being any order."""
    numbered = weights.withColumn("__n", (F.row_number().over(Window.partitionBy(key).orderBy(bar)) - 1).cast("bigint"))
    rows = chord_rows(numbered, key, "__n", w12, mode, tonic)
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "degree"))), lambda x: x["degree"]).alias("degrees"))


def midi_of(hz: Column) -> Column:
    return 69 + 12 * F.log2(hz / 440.0)


def hz_of(midi: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (midi - 69) / 12)


def letter_class(letter: Column, accidental: Column) -> Column:
    """Pitch class of a letter and its sharps or flats."""
    base = F.element_at(F.create_map(*(F.lit(x) for p in LETTERS.items() for x in p)), letter)
    count = lambda c: F.length(accidental) - F.length(F.replace(accidental, F.lit(c), F.lit("")))
    return F.pmod(base + count("#") - count("b"), F.lit(12))


def parsed_key(text: Column) -> Column:
    """Struct (tonic, mode) of "Bb maj", "c# minor", "F"; null if it isn't a key."""
    pattern = r"^\s*([A-Ga-g])\s*([#b]?)\s*(maj(?:or)?|min(?:or)?|m)?\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    mode = F.when(F.lower(part(3)).isin("m", "min", "minor"), "minor").otherwise("major")
    return F.when(text.rlike(pattern), F.struct(letter_class(F.upper(part(1)), part(2)).alias("tonic"), mode.alias("mode")))


def parsed_chord(text: Column) -> Column:
    """Root, third and fifth of a triad's name; null if it isn't one."""
    pattern = r"^([A-G])(#{1,2}|b{1,2})?(m|dim)?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    root = letter_class(part(1), part(2))
    third = F.when(part(3).isin("m", "dim"), 3).otherwise(4)
    fifth = F.when(part(3) == "dim", 6).otherwise(7)
    return F.when(text.rlike(pattern), F.array(root, F.pmod(root + third, F.lit(12)), F.pmod(root + fifth, F.lit(12))))


def tempo_reading(estimate: Column, target: float) -> Column:
    """Struct (ratio, error): the half, same or double reading nearest in logarithm."""
    reading = lambda r: F.struct(F.abs(F.log(estimate / (target * r))).alias("d"), F.lit([0.5, 1.0, 2.0].index(r)).alias("i"), F.lit(r).alias("ratio"), F.abs(estimate / (target * r) - 1).alias("error"))
    best = F.least(*(reading(r) for r in (0.5, 1.0, 2.0)))
    return F.struct(best["ratio"].alias("ratio"), best["error"].alias("error"))
