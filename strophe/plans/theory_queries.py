"""Queries over pitches, keys, tempi and chords (events as voiced frames, embeddings as weight vectors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators import theory as H
from strophe.tables import FRAMES, frames, load

from .registry import query

_HIST = f"""{FRAMES}, own AS (SELECT stream, (round_even(midi, 0)::INT % 12) AS pc, sum(v) AS w FROM frames WHERE midi IS NOT NULL GROUP BY ALL),
  hist AS (SELECT g.stream, g.pc, coalesce(w, 0) AS w FROM (SELECT stream, unnest(range(0, 12))::INT AS pc FROM (SELECT DISTINCT stream FROM own)) g LEFT JOIN own USING (stream, pc))"""


@query(f"WITH {_HIST} SELECT stream, pc, round(w, 6) AS w FROM hist")
def a5_pitch_classes(spark: SparkSession, d: str) -> DataFrame:
    return H.pitch_classes(frames(spark, d), "stream", "midi", "v").select("stream", "pc", F.round("w", 6).alias("w"))


@query(f"WITH {FRAMES}, o AS (SELECT stream, atan2(sum(v * sin(2 * pi() * midi)), sum(v * cos(2 * pi() * midi))) / (2 * pi()) AS o FROM frames WHERE midi IS NOT NULL GROUP BY stream) SELECT stream, round(o - round_even(o, 0), 6) AS tuning FROM o")
def a6_tuning(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).filter("midi is not null").groupBy("stream").agg(F.round(H.tuning(F.col("midi"), F.col("v")), 6).alias("tuning"))


def _keys_sql() -> str:
    rows = [f"({k}, '{H.TONICS[m][t]} {m}', '{m}', {pc}, {H.PROFILES[m][(pc - t) % 12]})" for k, (m, t) in enumerate((m, t) for m in H.TONICS for t in range(12)) for pc in range(12)]
    return "keys(k, name, mode, pc, profile) AS (VALUES " + ", ".join(rows) + ")"


@query(f"""WITH {_HIST}, {_keys_sql()}, s AS (SELECT stream, k, name, corr(w, profile::DOUBLE) + CASE WHEN mode = 'minor' THEN 0.05 ELSE 0 END AS score FROM hist JOIN keys USING (pc) GROUP BY stream, k, name, mode)
  SELECT stream, name, round(score, 6) AS score, row_number() OVER (PARTITION BY stream ORDER BY round(score, 9) DESC, k)::INT AS rank FROM s""")
def f6_rank_keys(spark: SparkSession, d: str) -> DataFrame:
    hist = H.pitch_classes(frames(spark, d), "stream", "midi", "v")
    return H.ranked_keys(hist, "stream", H.keys(spark), "minor").select("stream", "name", F.round("score", 6).alias("score"), "rank")


_SCALE = "[0, 2, 3, 5, 7, 8, 10]"


@query(f"""WITH {FRAMES} SELECT stream, i, round(midi + 0.8 * (list_min(list_transform(list_filter(range(-2, 4), lambda d: list_contains({_SCALE}, ((floor(midi)::INT + d) % 12)::INT)), lambda d: {{'d': abs(floor(midi)::INT + d - midi), 'q': floor(midi)::INT + d}})).q - midi), 6) AS snapped
  FROM frames WHERE midi IS NOT NULL""")
def c9_snap_to_scale(spark: SparkSession, d: str) -> DataFrame:
    scale = F.array(*map(F.lit, H.SCALES["minor"]))
    return frames(spark, d).filter("midi is not null").select("stream", "i", F.round(H.snapped(F.col("midi"), scale, 0.8), 6).alias("snapped"))


@query(f"""WITH {FRAMES}, s AS (SELECT stream, i, midi, (12 * ceil((60 - median(midi) OVER (PARTITION BY stream)) / 12))::INT AS shift FROM frames WHERE midi IS NOT NULL),
  u AS (SELECT *, midi + shift + 12 * greatest(0, ceil((55 - midi - shift) / 12)) AS r FROM s) SELECT stream, i, shift, round(r - 12 * greatest(0, ceil((r - 84) / 12)), 6) AS placed FROM u""")
def c10_place_octaves(spark: SparkSession, d: str) -> DataFrame:
    return H.in_octaves(frames(spark, d).filter("midi is not null"), "stream", "midi").select("stream", "i", "shift", F.round("placed", 6).alias("placed"))


@query("""WITH o AS (SELECT user_id, bpm, avg(abs(value / (60.0 / bpm) - round_even(value / (60.0 / bpm), 0))) + 0.5 * avg(abs(value * 1.7 / (60.0 / bpm * 0.5) - round_even(value * 1.7 / (60.0 / bpm * 0.5), 0))) AS cost
   FROM events, (SELECT unnest(range(116, 125)) AS bpm) GROUP BY ALL), b AS (SELECT user_id, arg_min({'bpm': bpm, 'cost': cost}, (round(cost + 0.04 * abs(bpm - 120) / 4, 6), abs(bpm - 120), bpm)) AS b FROM o GROUP BY user_id)
  SELECT user_id, b.bpm::INT AS bpm, round(b.cost, 6) AS cost FROM b""")
def c2_search_tempo(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select("user_id", F.col("value").alias("x"), (F.col("value") * 1.7).alias("y"))
    return H.tempo(rows, "user_id", "x", "y", 120.0, 4.0, 0.5).select("user_id", "bpm", F.round("cost", 6).alias("cost"))


_READ = "list_min(list_transform([{'r': 0.5, 'i': 0}, {'r': 1.0, 'i': 1}, {'r': 2.0, 'i': 2}], lambda x: {'d': abs(ln(v / (120 * x.r::DOUBLE))), 'i': x.i, 'ratio': x.r::DOUBLE, 'error': abs(v / (120 * x.r::DOUBLE) - 1)}))"


@query(f"SELECT event_id, b.ratio AS ratio, round(b.error, 6) AS error FROM (SELECT event_id, {_READ} AS b FROM (SELECT event_id, value + 1 AS v FROM events))")
def c4_tempo_fit(spark: SparkSession, d: str) -> DataFrame:
    reading = load(spark, d, "events").select("event_id", H.tempo_reading(F.col("value") + 1, 120.0).alias("r"))
    return reading.select("event_id", "r.ratio", F.round("r.error", 6).alias("error"))


_NOTES = "SELECT user_id, event_id AS i, epoch_us(ts) % 600000000 / 1000000.0 AS s, epoch_us(ts) % 600000000 / 1000000.0 + value / 40 AS e, event_id % 12 AS pc FROM events"
_GRID = f"""notes AS ({_NOTES}), q AS (SELECT *, round_even(s / 0.5 / 0.5, 0)::DOUBLE * 0.5 AS sb, greatest(0.5, round_even(e / 0.5 / 0.5, 0)::DOUBLE * 0.5 - round_even(s / 0.5 / 0.5, 0)::DOUBLE * 0.5) AS bs FROM notes),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sb ORDER BY bs DESC, i) AS r FROM q) WHERE r = 1), grid AS (SELECT user_id, i, pc, sb AS start_beat, least(bs, coalesce(lead(sb) OVER (PARTITION BY user_id ORDER BY sb) - sb, bs)) AS beats FROM k)"""


def _notes(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) % 600_000_000 / 1_000_000.0
    return load(spark, d, "events").select("user_id", F.col("event_id").alias("i"), at.alias("s"), (at + F.col("value") / 40).alias("e"), (F.col("event_id") % 12).alias("pc"))


@query(f"WITH {_GRID} SELECT user_id, i, start_beat, beats FROM grid")
def f9_quantize(spark: SparkSession, d: str) -> DataFrame:
    return H.quantized(_notes(spark, d), "user_id", "i", "s", "e", 120.0, 0.5).select("user_id", "i", "start_beat", "beats")


@query(f"""WITH {_GRID}, b AS (SELECT *, unnest(range(floor(start_beat / 4)::BIGINT, ceil((start_beat + beats) / 4)::BIGINT)) AS bar FROM grid)
  SELECT user_id, bar, pc, round(sum(least(start_beat + beats, 4.0 * (bar + 1)) - greatest(start_beat, 4.0 * bar))::DOUBLE, 6) AS w FROM b GROUP BY ALL""")
def a8_bar_weights(spark: SparkSession, d: str) -> DataFrame:
    notes = H.quantized(_notes(spark, d), "user_id", "i", "s", "e", 120.0, 0.5)
    return H.bar_weights(notes, "user_id", "start_beat", "beats", "pc").withColumn("w", F.round("w", 6))


def _viterbi_sql() -> str:
    table, prior, moves = H.triads("minor", 9), H.DEGREE_PRIOR["minor"], set(H.MOVES["minor"])
    em = lambda k: f"coalesce((w[{table[k][1][0] + 1}] * 1.3 + w[{table[k][1][1] + 1}] + w[{table[k][1][2] + 1}]) / nullif(list_sum(w), 0), 0) + {prior[k + 1]}"
    steps = []
    for k in range(7):
        bonus = [(0.15 if (j + 1, k + 1) in moves else 0.0) + (0.05 if j == k else 0.0) for j in range(7)]
        opts = ", ".join(f"{{'s': a.s{j + 1} + {bonus[j]}, 'j': {-j}}}" for j in range(7))
        steps.append(f"list_max([{opts}]) AS o{k + 1}, {em(k)} AS e{k + 1}")
    paths = ", ".join(f"o{k + 1}.s + e{k + 1} AS s{k + 1}, list_append([p1, p2, p3, p4, p5, p6, p7][1 - o{k + 1}.j], {k + 1}) AS p{k + 1}" for k in range(7))
    first = ", ".join(f"({em(k)} + {0.2 if k == 0 else 0.0})::DOUBLE AS s{k + 1}, [{k + 1}] AS p{k + 1}" for k in range(7))
    last = ", ".join(f"{{'s': s{k + 1}, 'i': {-k}, 'p': p{k + 1}}}" for k in range(7))
    return f"""WITH RECURSIVE b AS (SELECT vec_id // 16 AS label, vec_id, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) AS bar, list_transform(embedding[1:12], lambda x: abs(x)::DOUBLE) AS w FROM embeddings),
      v AS (SELECT label, bar, {first} FROM b WHERE bar = 1 UNION ALL SELECT label, bar, {paths} FROM (SELECT a.label, n.bar, {', '.join(f'a.p{k + 1}' for k in range(7))}, {', '.join(steps)} FROM v a JOIN b n ON n.label = a.label AND n.bar = a.bar + 1))
      SELECT label AS song, array_to_string(list_max([{last}]).p, ' ') AS degrees FROM v JOIN (SELECT label, max(bar) AS bar FROM b GROUP BY label) USING (label, bar)"""


@query(_viterbi_sql())
def d10_choose_chords(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as bars: the first twelve dimensions are pitch-class weights; a song has 16 bars."""
    w = F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x).cast("double"))
    bars = load(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("song"), "vec_id", w.alias("w"))
    return H.chords(bars, "song", "vec_id", "w", "minor", 9).select("song", F.array_join("degrees", " ").alias("degrees"))


@query("SELECT event_id, round(69 + 12 * log2((value + 60) / 440.0), 6) AS midi, round(440.0 * pow(2.0, (value / 2 - 69) / 12), 6) AS hz FROM events")
def f1_pitch_units(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.round(H.midi_of(F.col("value") + 60), 6).alias("midi"), F.round(H.hz_of(F.col("value") / 2), 6).alias("hz"))


_NAMES = "SELECT p_partkey, ['C', 'D', 'E', 'F', 'G', 'A', 'B', 'H'][p_partkey % 8 + 1] || ['', '#', 'b'][p_partkey % 3 + 1] AS root, ['', ' maj', 'm', ' minor'][p_size % 4 + 1] AS mode, ['', 'm', 'dim', 'x'][p_size % 4 + 1] AS q FROM part"
_ROOT = "(MAP {'C': 0, 'D': 2, 'E': 4, 'F': 5, 'G': 7, 'A': 9, 'B': 11}[left(root, 1)] + CASE substr(root, 2) WHEN '#' THEN 1 WHEN 'b' THEN 11 ELSE 0 END) % 12"


@query(f"""SELECT p_partkey, CASE WHEN root[1] <> 'H' THEN {_ROOT} END AS tonic, CASE WHEN root[1] <> 'H' THEN CASE WHEN mode IN ('m', ' minor') THEN 'minor' ELSE 'major' END END AS mode,
  CASE WHEN root[1] <> 'H' AND q <> 'x' THEN array_to_string([{_ROOT}, ({_ROOT} + CASE WHEN q = '' THEN 4 ELSE 3 END) % 12, ({_ROOT} + CASE WHEN q = 'dim' THEN 6 ELSE 7 END) % 12], ' ') END AS chord FROM ({_NAMES})""")
def f2_parse_keys_and_chords(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    root = F.concat(pick(["C", "D", "E", "F", "G", "A", "B", "H"], F.col("p_partkey") % 8), pick(["", "#", "b"], F.col("p_partkey") % 3))
    rows = load(spark, d, "part").select("p_partkey", F.concat(root, pick(["", " maj", "m", " minor"], F.col("p_size") % 4)).alias("key"), F.concat(root, pick(["", "m", "dim", "x"], F.col("p_size") % 4)).alias("chord"))
    key = H.parsed_key(F.col("key"))
    return rows.select("p_partkey", key["tonic"].alias("tonic"), key["mode"].alias("mode"), F.array_join(H.parsed_chord(F.col("chord")), " ").alias("chord"))
