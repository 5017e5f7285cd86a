"""Queries over sample streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.operators import cuts as C
from strophe.operators import signals as G
from strophe.tables import FRAMES, SAMPLES, SECTIONS, frames, load, samples, sections

from .registry import query

RATE = 4000.0


def _filter_sql(sections: list[G.Section], source: str = "samples") -> str:
    """The recurrence sample by sample: y of each section from its input and the two before."""
    first = ", ".join(f"0.0::DOUBLE AS p{k}, 0.0::DOUBLE AS q{k}" for k in range(len(sections)))
    inputs, nexts = "n.v", []
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        y = f"({b0!r} * ({inputs}) + f.p{k})"
        nexts.append(f"{b1!r} * ({inputs}) - ({a1!r}) * {y} + f.q{k} AS p{k}, {b2!r} * ({inputs}) - ({a2!r}) * {y} AS q{k}")
        inputs = y
    return f"""filtered AS (SELECT DISTINCT stream, -1::BIGINT AS i, 0.0::DOUBLE AS v, {first} FROM {source}
  UNION ALL SELECT n.stream, n.i, {inputs} AS v, {', '.join(nexts)} FROM filtered f JOIN {source} n ON n.stream = f.stream AND n.i = f.i + 1)"""


@query(f"WITH RECURSIVE {SAMPLES}, {_filter_sql(G.k_weighting(RATE))} SELECT stream, i, round(v, 6) + 0.0 AS v FROM filtered WHERE i >= 0")
def z2_filtered(spark: SparkSession, d: str) -> DataFrame:
    """K-weighted samples; a stream is as many tasks as it has blocks."""
    out = G.filtered(samples(spark, d), "stream", "i", "v", G.k_weighting(RATE), 1024)
    return out.select("stream", "i", (F.round("v", 6) + 0.0).alias("v"))


@query(f"WITH RECURSIVE {SAMPLES}, {_filter_sql(G.band_pass(RATE, 200, 1500))} SELECT stream, i, round(v, 6) + 0.0 AS v FROM filtered WHERE i >= 0")
def z2_band_passed(spark: SparkSession, d: str) -> DataFrame:
    out = G.filtered(samples(spark, d), "stream", "i", "v", G.band_pass(RATE, 200, 1500), 1024)
    return out.select("stream", "i", (F.round("v", 6) + 0.0).alias("v"))


_GATES = f"""sizes AS (SELECT stream, count(*) AS n FROM samples GROUP BY stream HAVING count(*) >= {round(0.4 * RATE)}),
  gates AS (SELECT stream, unnest(range(0, (round_even((n / {RATE} - 0.4) / 0.1, 0) + 1)::BIGINT)) AS k FROM sizes),
  energies AS (SELECT g.stream, k, sum(v * v) / {round(0.4 * RATE)} AS e FROM gates g JOIN filtered f ON f.stream = g.stream AND f.i >= floor(0.1 * k * {RATE}) AND f.i < floor(0.1 * k * {RATE}) + {round(0.4 * RATE)} GROUP BY ALL),
  loud AS (SELECT *, -0.691 + 10 * log10(e) AS l FROM energies WHERE e > 0), gated AS (SELECT *, -0.691 + 10 * log10(avg(e) OVER (PARTITION BY stream)) AS m FROM loud WHERE l >= -70)"""


@query(f"WITH RECURSIVE {SAMPLES}, {_filter_sql(G.k_weighting(RATE))}, {_GATES} SELECT stream, round(-0.691 + 10 * log10(avg(e)), 6) AS lufs FROM gated WHERE l > m - 10 GROUP BY stream")
def z2_weighted_loudness(spark: SparkSession, d: str) -> DataFrame:
    """Gated loudness (A13) of the filter's output."""
    return G.loudness(samples(spark, d), "stream", "i", "v", RATE, 1024).select("stream", F.round("lufs", 6).alias("lufs"))


_TAPS = ", ".join(f"({p}, {j - G.HALF_TAPS}, {h!r})" for p, row in enumerate(G.upsampling_taps().tolist()) for j, h in enumerate(row))
_POINTS = f"""taps(p, back, h) AS (VALUES {_TAPS}), points AS (SELECT s.stream, s.i, t.p, sum(t.h * x.v) AS y FROM samples s JOIN taps t ON true JOIN samples x ON x.stream = s.stream AND x.i = s.i - t.back GROUP BY ALL),
  peaks AS (SELECT s.stream, s.i, greatest(max(abs(y)), any_value(abs(s.v))) AS peak FROM samples s JOIN points p ON p.stream = s.stream AND p.i = s.i GROUP BY s.stream, s.i)"""


@query(f"WITH {SAMPLES}, {_POINTS} SELECT stream, i // {G.LIMIT_SAMPLES} AS span, round(max(peak), 6) AS peak FROM peaks GROUP BY ALL")
def r6_true_peaks(spark: SparkSession, d: str) -> DataFrame:
    """True peaks of the spans a limiter works on; blocks share the samples at their edges."""
    peaks = G.true_peaks(samples(spark, d), "stream", "i", "v", 1024)
    return peaks.groupBy("stream", F.floor(F.col("i") / G.LIMIT_SAMPLES).alias("span")).agg(F.round(F.max("peak"), 6).alias("peak"))


@query()
def r5_mastered(spark: SparkSession, d: str) -> DataFrame:
    """Streams brought to -14 LUFS under -1 dB; a test holds rounds, gain and trim against plain Python."""
    told, _ = G.mastered(samples(spark, d), "stream", "i", "v", RATE, -14.0, -1.0)
    return told.select("stream", *(F.round(c, 6).alias(c) for c in ("gain_db", "trim_db", "lufs", "true_peak_db")), "rounds")


_FPS, _SLOW, _FAST = 10.0, 20, 2


@query(f"""WITH {FRAMES}, e AS (SELECT stream, i, v - avg(v) OVER (PARTITION BY stream) AS v FROM frames), sizes AS (SELECT stream, max(i) AS n FROM frames GROUP BY stream),
  wanted AS (SELECT stream, unnest(range(0, least(n, 23) + 1)) AS lag FROM sizes), ac AS (SELECT w.stream, w.lag, coalesce(sum(a.v * b.v), 0) AS ac FROM wanted w JOIN e a ON a.stream = w.stream LEFT JOIN e b ON b.stream = a.stream AND b.i = a.i + w.lag GROUP BY ALL),
  l AS (SELECT *, ac / nullif(max(CASE WHEN lag = 0 THEN ac END) OVER (PARTITION BY stream), 0) AS share, lag(ac) OVER o AS before, lead(ac) OVER o AS after FROM ac WINDOW o AS (PARTITION BY stream ORDER BY lag)),
  g AS (SELECT stream, arg_max(lag, {{'s': round(ln(1 + 1e6 * share) - 0.5 * pow(log2(60 * {_FPS} / lag) - log2(120), 2), 9), 'l': -lag}}) AS guess FROM l WHERE lag BETWEEN {_FAST} AND {_SLOW} AND share > 0 GROUP BY stream),
  b AS (SELECT l.stream, arg_max({{'lag': l.lag, 'x': before, 'y': ac, 'z': after}}, {{'s': round(share, 12), 'l': -l.lag}}) AS b FROM l JOIN g USING (stream) WHERE l.lag BETWEEN greatest(2, floor(guess * 0.96)) AND floor(guess * 1.04) GROUP BY l.stream)
  SELECT stream, round(60 * {_FPS} / (b.lag + coalesce(CASE WHEN b.x - 2 * b.y + b.z < 0 THEN 0.5 * (b.x - b.z) / (b.x - 2 * b.y + b.z) END, 0)), 6) AS bpm FROM b""")
def z3_tempo(spark: SparkSession, d: str) -> DataFrame:
    """Tempo of each stream's values as an onset envelope of ten frames a second."""
    return G.tempos(frames(spark, d), "stream", "i", "v", _FPS, 1024).select("stream", F.round("bpm", 6).alias("bpm"))


# Cuts.  Sections are the parts of a song's quote, searched in one of the sample streams.

_PARTS = """parts AS (SELECT song AS quote, n AS part, song % 4 AS stream, song // 4 + n * 12 AS start_at, bars FROM sections),
  searches AS (SELECT *, start_at - bars - 2 AS start_lo, start_at + 3 AS start_hi, start_at + 8 AS end_at, start_at + 5 AS end_lo, start_at + 8 + bars AS end_hi FROM parts)"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    at = F.floor(F.col("song") / 4) + F.col("n") * 12
    rows = sections(spark, d).select(F.col("song").alias("quote"), F.col("n").alias("part"), F.pmod("song", F.lit(4)).alias("stream"), at.alias("start_at"), "bars")
    moved = {"start_lo": F.col("start_at") - F.col("bars") - 2, "start_hi": F.col("start_at") + 3, "end_at": F.col("start_at") + 8, "end_lo": F.col("start_at") + 5, "end_hi": F.col("start_at") + 8 + F.col("bars")}
    return rows.withColumns(moved).drop("bars")


def _cut_sql(name: str, source: str, point: str) -> str:
    """One row for each search of ``source`` (quote, part, stream, lo, hi, boundary): its point and level."""
    return f"""{name}_q AS (SELECT s.*, l.i, l.level, min(l.level) OVER (PARTITION BY s.quote, s.part) AS least FROM {source} s JOIN levels l ON l.stream = s.stream AND l.i BETWEEN s.lo AND s.hi),
  {name}_z AS (SELECT *, i - row_number() OVER (PARTITION BY quote, part ORDER BY i) AS g FROM {name}_q WHERE level <= least + 0.5),
  {name}_r AS (SELECT quote, part, any_value(boundary) AS boundary, min(i) AS first, max(i) AS last, list(i ORDER BY i) AS places, list(level ORDER BY i) AS heard FROM {name}_z GROUP BY quote, part, g),
  {name} AS (SELECT quote, part, arg_min({{'p': {point}, 'l': heard[list_position(places, {point})]}}, (greatest(0, first - boundary, boundary - last), first)) AS c FROM {name}_r GROUP BY quote, part)"""


@query(f"""WITH {SAMPLES}, {SECTIONS}, {_PARTS}, levels AS (SELECT stream, i, 10 * log10(avg(v * v) OVER (PARTITION BY stream ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) + 1e-12) AS level FROM samples),
  end_in AS (SELECT quote, part, stream, end_lo AS lo, greatest(end_lo, end_hi) AS hi, end_at AS boundary FROM searches), {_cut_sql('e', 'end_in', 'least(last, first + 2)')},
  floored AS (SELECT s.*, greatest(start_lo, coalesce(lag(e.c.p) OVER (PARTITION BY s.quote ORDER BY s.part), 0)) AS floor FROM searches s JOIN e ON e.quote = s.quote AND e.part = s.part),
  start_in AS (SELECT quote, part, stream, least(floor, start_hi) AS lo, start_hi AS hi, start_at AS boundary FROM floored), {_cut_sql('b', 'start_in', 'greatest(first, last - 2)')}
  SELECT b.quote, b.part, b.c.p AS start, round(b.c.l, 6) AS start_db, e.c.p AS "end", round(e.c.l, 6) AS end_db FROM b JOIN e ON e.quote = b.quote AND e.part = b.part""")
def c8_cut_quotes(spark: SparkSession, d: str) -> DataFrame:
    """The quietest stretches around the parts of quotes; no part starts before the one ahead has ended."""
    levels = C.sample_levels(samples(spark, d), "stream", "i", "v", 4, 1024)
    cuts = C.cut_quotes(_parts(spark, d), levels, "quote", "stream", "i", 2, bucket=16, longest=32)
    return cuts.select("quote", "part", "start", F.round("start_db", 6).alias("start_db"), "end", F.round("end_db", 6).alias("end_db"))


_MUSIC, _REST = 240, 60


@query(f"""WITH {SAMPLES}, t AS (SELECT stream, count(*) AS total FROM samples GROUP BY stream), r AS (SELECT stream, total, unnest(range(0, total // {_MUSIC} + 1)) AS k FROM t),
  runs AS (SELECT *, least({_MUSIC}, total - k * {_MUSIC} - 7) AS size, k < total // {_MUSIC} AS rest_after FROM r),
  m AS (SELECT runs.*, s.v, s.i - k * {_MUSIC} AS pos FROM runs JOIN samples s ON s.stream = runs.stream AND s.i >= k * {_MUSIC} AND s.i < k * {_MUSIC} + size),
  g AS (SELECT *, CASE WHEN k = 0 OR pos >= least(8, size) THEN 1.0::DOUBLE ELSE coalesce(pos::DOUBLE / nullif(least(8, size) - 1, 0), 0) END AS rise, least(CASE WHEN rest_after THEN 4 ELSE 12 END, size) AS n FROM m)
  SELECT stream, k * {_MUSIC + _REST} + pos AS i, round(v * rise * CASE WHEN n <= 1 OR pos < size - n THEN 1.0::DOUBLE ELSE (size - 1 - pos)::DOUBLE / (n - 1) END, 6) + 0.0 AS v FROM g""")
def l18_spliced(spark: SparkSession, d: str) -> DataFrame:
    """Streams as takes: a rest of 60 samples opens after each 240; the song's end cuts the last seven away."""
    rows = samples(spark, d)
    totals = rows.groupBy("stream").agg(F.count("*").alias("total"))
    runs = totals.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / _MUSIC))))
    size = F.least(F.lit(_MUSIC), F.col("total") - F.col("k") * _MUSIC - 7)
    start = F.col("k") * (_MUSIC + _REST)
    runs = runs.select("stream", (F.col("k") * _MUSIC).alias("source"), start.alias("start"), (start + size).alias("stop"), (F.col("k") == 0).alias("first"), (F.col("k") < F.floor(F.col("total") / _MUSIC)).alias("rest_after"), "total")
    return C.spliced(rows, runs, "stream", "i", "v", 8, 4, 12, 1024).select("stream", "i", (F.round("v", 6) + 0.0).alias("v"))


_PLACED = """b AS (SELECT song, n, clip, (sum(bars) OVER (PARTITION BY song ORDER BY n) - bars)::BIGINT AS bar, (sum(bars) OVER (PARTITION BY song))::BIGINT AS bars FROM sections),
  placed AS (SELECT song, clip, bar * 4 AS start, bars * 4 AS frames FROM b WHERE clip IS NOT NULL), clips AS (SELECT 'c' || p_partkey AS clip, p_size AS size, unnest(range(0, p_size)) AS i, p_retailprice AS price FROM part)"""


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    by = Window.partitionBy("song").orderBy("n")
    upto = F.sum("bars").over(by)
    rows = sections(spark, d).select("song", "clip", ((upto - F.col("bars")) * 4).alias("start"), "bars")
    grids = rows.groupBy("song").agg((F.sum("bars") * 4).alias("frames"))
    return rows.filter("clip IS NOT NULL").select("song", "clip", "start"), grids


@query(f"""WITH {SECTIONS}, {_PLACED} SELECT song, start + i AS i, arg_max(round((price * (i + 1)) % 2.0 - 1, 4) + 0.0, (start, p.clip)) AS v FROM placed p JOIN clips USING (clip) WHERE start + i < frames GROUP BY song, start + i""")
def z5_stems(spark: SparkSession, d: str) -> DataFrame:
    """Parts as clips on the grid of each song; a later clip covers an earlier one, and none goes past the end."""
    placed, grids = _placed(spark, d)
    clips = load(spark, d, "part").select(F.concat(F.lit("c"), "p_partkey").alias("clip"), F.explode(F.sequence(F.lit(0), F.col("p_size") - 1)).alias("i"), F.col("p_retailprice").alias("price")).withColumn("v", F.round((F.col("price") * (F.col("i") + 1)) % 2.0 - 1, 4) + 0.0)
    return C.stem(placed, clips, grids, "song", "clip", "i", "v")


@query(f"""WITH {SECTIONS}, {_PLACED} SELECT song, clip, count(*) AS n FROM (SELECT DISTINCT song, clip, start, size, frames FROM placed JOIN clips USING (clip)) WHERE start + size > frames GROUP BY ALL""")
def z5_overruns(spark: SparkSession, d: str) -> DataFrame:
    """Clips that end past the end of their song."""
    placed, grids = _placed(spark, d)
    sizes = load(spark, d, "part").select(F.concat(F.lit("c"), "p_partkey").alias("clip"), F.col("p_size").alias("size"))
    return C.overruns(placed, sizes, grids, "song", "clip").groupBy("song", "clip").agg(F.count("*").alias("n"))


_KNOTS = """k AS (SELECT song, n, sum(bars) OVER (PARTITION BY song ORDER BY n) - bars AS a, sum(bars) OVER (PARTITION BY song ORDER BY n) - CASE WHEN rest THEN 1 ELSE 0 END AS b, energy AS e0, coalesce(lead(energy) OVER (PARTITION BY song ORDER BY n), energy) AS e1 FROM sections)"""


@query(f"""WITH {SECTIONS}, {_KNOTS}, p AS (SELECT song, unnest(range(0, sum(bars)::BIGINT + 2)) AS i FROM sections GROUP BY song)
  SELECT p.song, p.i, round(coalesce(arg_max(e0 + coalesce((i - a)::DOUBLE / nullif(b - a - 1, 0), 0) * (e1 - e0), n), 0), 6) AS energy FROM p LEFT JOIN k ON k.song = p.song AND p.i >= a AND p.i < b GROUP BY ALL""")
def z9_energy_curve(spark: SparkSession, d: str) -> DataFrame:
    """A value for each bar, on the line between a section's energy and the next one's; rests leave their last bar empty."""
    by = Window.partitionBy("song").orderBy("n")
    upto = F.sum("bars").over(by)
    rows = sections(spark, d).select("song", "n", (upto - F.col("bars")).alias("a"), (upto - F.when(F.col("rest"), 1).otherwise(0)).alias("b"), F.col("energy").alias("energy_start"), F.coalesce(F.lead("energy").over(by), F.col("energy")).alias("energy_end"))
    grids = sections(spark, d).groupBy("song").agg((F.sum("bars") + 2).alias("frames"))
    return C.energy_curve(grids, rows, "song", "i", 64).select("song", "i", F.round("energy", 6).alias("energy"))
