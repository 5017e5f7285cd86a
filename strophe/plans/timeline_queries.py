"""Queries over song timelines (order lines as sections)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.operators import timeline as L
from strophe.tables import SECTIONS, load, sections

from .registry import query

_BEFORE = "OVER (PARTITION BY song ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_PLACED = f"""{SECTIONS}, placed AS (SELECT *, coalesce(sum(bars) {_BEFORE}, 0)::BIGINT AS start_bar,
  (coalesce(sum(bars) {_BEFORE}, 0) - coalesce(sum(CASE WHEN rest THEN bars ELSE 0 END) {_BEFORE}, 0))::BIGINT AS music_bar FROM sections)"""
_ENERGY = f"""{_PLACED}, ahead AS (SELECT *, coalesce(max(energy) OVER (PARTITION BY song ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS ah FROM placed),
  eb AS (SELECT *, energy AS e_start, CASE shape WHEN 'rise' THEN CASE WHEN ah > energy THEN ah ELSE least(1.0, energy + 0.25) END WHEN 'fall' THEN 0.0 ELSE energy END AS e_end FROM ahead)"""
_MS = f"""{_PLACED}, ms AS (SELECT *, CASE WHEN rest THEN start_ms ELSE round_even((music_bar + bars) * 2000.0, 0)::BIGINT END AS end_ms FROM (SELECT *, round_even(music_bar * 2000.0, 0)::BIGINT AS start_ms FROM placed))"""


@query(f"WITH {_PLACED} SELECT song, n, start_bar, music_bar FROM placed")
def w9_music_bars(spark: SparkSession, d: str) -> DataFrame:
    return L.placed(sections(spark, d)).select("song", "n", "start_bar", "music_bar")


@query(f"WITH {_ENERGY} SELECT song, n, round(e_start, 6) AS e_start, round(e_end, 6) AS e_end FROM eb")
def w10_energy_bounds(spark: SparkSession, d: str) -> DataFrame:
    return L.energy_bounds(sections(spark, d)).select("song", "n", F.round("e_start", 6).alias("e_start"), F.round("e_end", 6).alias("e_end"))


@query(f"WITH {_ENERGY}, k AS (SELECT *, unnest(range(0, bars)) AS k FROM eb) SELECT song, start_bar + k AS bar, round(e_start + (e_end - e_start) * (k + 0.5) / bars, 6) AS energy FROM k")
def w11_bar_energies(spark: SparkSession, d: str) -> DataFrame:
    return L.bar_energies(sections(spark, d)).select("song", "bar", F.round("energy", 6).alias("energy"))


_PASSAGE = f"""{_PLACED}, pa AS (SELECT *, sum(CASE WHEN coalesce(pe = start_bar AND pr = rest, false) THEN 0 ELSE 1 END) OVER (PARTITION BY song ORDER BY n) AS passage
  FROM (SELECT *, lag(start_bar + bars) OVER w AS pe, lag(rest) OVER w AS pr FROM placed WHERE clip IS NOT NULL WINDOW w AS (PARTITION BY song ORDER BY n)))"""


@query(f"WITH {_PASSAGE} SELECT song, passage::BIGINT AS passage, min(start_bar) AS start_bar, sum(bars)::BIGINT AS bars, string_agg(clip, ',' ORDER BY n) AS clips FROM pa GROUP BY ALL")
def w12_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = L.passages(sections(spark, d))
    clips = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "clip"))), lambda x: x["clip"]), ",")
    return rows.groupBy("song", "passage").agg(F.min("start_bar").alias("start_bar"), F.sum("bars").alias("bars"), clips.alias("clips"))


@query(f"WITH {_MS} SELECT song, n, start_ms, end_ms FROM ms")
def l3_section_bounds(spark: SparkSession, d: str) -> DataFrame:
    return L.bounds_ms(sections(spark, d), 120.0).select("song", "n", "start_ms", "end_ms")


_SPANS = f"""{_MS}, so AS (SELECT *, sum(CASE WHEN coalesce(pr = role AND pe = start_ms, false) THEN 0 ELSE 1 END) OVER (PARTITION BY song ORDER BY n) AS run
  FROM (SELECT *, lag(role) OVER w AS pr, lag(end_ms) OVER w AS pe FROM ms WHERE NOT silent AND NOT rest AND end_ms > start_ms WINDOW w AS (PARTITION BY song ORDER BY n))),
  sp AS (SELECT song, role, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM so GROUP BY song, role, run),
  spans AS (SELECT *, row_number() OVER (PARTITION BY song, role ORDER BY start_ms) AS k FROM sp)"""


@query(f"WITH {_SPANS} SELECT song, role, k::INT AS k, start_ms, end_ms FROM spans")
def w14_anchor_spans(spark: SparkSession, d: str) -> DataFrame:
    return L.role_spans(sections(spark, d), 120.0).select("song", "role", "k", "start_ms", "end_ms")


@query(f"""WITH {_SPANS}, an AS (SELECT role, k, start_ms, end_ms FROM spans WHERE song = 1), sz AS (SELECT role, max(k) AS size FROM an GROUP BY role),
  wa AS (SELECT song, role, k AS number, max(k) OVER (PARTITION BY song, role) AS count FROM spans),
  mt AS (SELECT wa.*, an.start_ms, an.end_ms, greatest(0, an.end_ms - an.start_ms - 5000) AS extra FROM wa JOIN sz USING (role) JOIN an ON an.role = wa.role AND an.k = CASE WHEN number = count THEN size ELSE least(number, size) END)
  SELECT song, role, number::INT AS number, count::INT AS count, start_ms + extra // 2 AS from_ms, CASE WHEN extra > 0 THEN start_ms + extra // 2 + 5000 ELSE end_ms END AS to_ms FROM mt""")
def j22_anchor_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Every song's spans conditioned on song 1, at most 5 s each."""
    spans = L.role_spans(sections(spark, d), 120.0)
    anchor = spans.filter("song = 1").drop("song")
    wanted = spans.select("song", "role", F.col("k").alias("number"), F.max("k").over(Window.partitionBy("song", "role")).alias("count"))
    return L.anchored(anchor, wanted, 5000)


@query(f"""WITH {SECTIONS}, g AS (SELECT song, list(role ORDER BY n) AS names FROM sections GROUP BY song)
  SELECT song, list_filter(range(1, len(names) + 1), lambda p: len(list_filter(range(1, len(names) + 1), lambda i: names[i] <> names[(i - 1) % p + 1])) = 0)[1]::INT AS period FROM g""")
def w15_chord_cycle(spark: SparkSession, d: str) -> DataFrame:
    names = sections(spark, d).groupBy("song").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "role"))), lambda x: x["role"]).alias("names"))
    return names.select("song", L.cycle_length(F.col("names")).alias("period"))


@query(f"""WITH {_PLACED}, c AS (SELECT song, n, (start_bar * 88200)::BIGINT AS s, (start_bar * 88200 + bars * 44100)::BIGINT AS e, sum(bars) OVER (PARTITION BY song) * 88200 AS total FROM placed),
  x AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY song ORDER BY s, e), total) AS nx FROM c) SELECT song, n, greatest(0, least(264600, nx - e))::BIGINT AS tail FROM x""")
def w8_tail_limits(spark: SparkSession, d: str) -> DataFrame:
    at = L.placed(sections(spark, d)).withColumn("total", F.sum("bars").over(Window.partitionBy("song")) * 88200)
    clips = at.select("song", "n", "total", (F.col("start_bar") * 88200).alias("s"), (F.col("start_bar") * 88200 + F.col("bars") * 44100).alias("e"))
    return L.tail_limits(clips, "song", "s", "e", F.col("total"), 264600).select("song", "n", F.col("limit").cast("long").alias("tail"))


@query(f"""WITH {_PLACED}, ed AS (SELECT song, n, clip, start_bar + CASE WHEN n = 3 AND song % 5 = 0 THEN 1 ELSE 0 END AS start_bar, CASE WHEN song % 7 = 0 AND n = 2 THEN 0 ELSE bars END AS bars FROM placed),
  ex AS (SELECT *, coalesce(lag(start_bar + greatest(bars, 1)) OVER (PARTITION BY song ORDER BY n), 0) AS e FROM ed)
  SELECT song, n, 'gap' AS kind FROM ex WHERE start_bar <> e UNION ALL SELECT song, n, 'empty' FROM ex WHERE bars < 1 UNION ALL SELECT song, n, 'unknown clip' FROM ex WHERE clip IS NOT NULL AND clip NOT IN (SELECT 'c' || p_partkey FROM part WHERE p_size > 5)""")
def p6_structure_problems(spark: SparkSession, d: str) -> DataFrame:
    at = L.placed(sections(spark, d))
    edited = at.withColumn("start_bar", F.col("start_bar") + F.when((F.col("n") == 3) & (F.col("song") % 5 == 0), 1).otherwise(0)).withColumn("bars", F.when((F.col("song") % 7 == 0) & (F.col("n") == 2), 0).otherwise(F.col("bars")))
    clips = load(spark, d, "part").filter("p_size > 5").select(F.concat(F.lit("c"), F.col("p_partkey")).alias("clip"))
    return L.structure_problems(edited, clips)


@query(f"WITH {SECTIONS} SELECT 'c' || p_partkey AS clip FROM part WHERE 'c' || p_partkey NOT IN (SELECT clip FROM sections WHERE clip IS NOT NULL)")
def p7_unplayed_clips(spark: SparkSession, d: str) -> DataFrame:
    kept = load(spark, d, "part").select(F.concat(F.lit("c"), F.col("p_partkey")).alias("clip"))
    return kept.join(sections(spark, d).filter("clip is not null").select("clip"), "clip", "left_anti")


@query()
def l4_layout_chunks(spark: SparkSession, d: str) -> DataFrame:
    return L.layout(sections(spark, d), 120.0)


@query(f"WITH {_MS} SELECT song, count(*) FILTER (end_ms - start_ms < 3000 OR end_ms - start_ms > 120000) AS bad_length, count(*) > 30 AS too_many, sum(end_ms - start_ms)::BIGINT AS total_ms, sum(end_ms - start_ms) NOT BETWEEN 3000 AND 600000 AS bad_total FROM ms WHERE NOT rest GROUP BY song")
def p8_check_plan(spark: SparkSession, d: str) -> DataFrame:
    length = F.col("end_ms") - F.col("start_ms")
    total = F.sum(length)
    chunks = L.bounds_ms(sections(spark, d), 120.0).filter("not rest")
    return chunks.groupBy("song").agg(F.count_if((length < 3000) | (length > 120_000)).alias("bad_length"), (F.count("*") > 30).alias("too_many"), total.alias("total_ms"), (~total.between(3000, 600_000)).alias("bad_total"))


@query(f"""WITH {SECTIONS}, s AS (SELECT song, lower(trim(role || CASE WHEN n % 2 = 0 THEN ' ' ELSE '' END)) AS k, role AS r, n FROM sections), u AS (SELECT song, k, arg_min(r, n) AS style, min(n) AS n FROM s GROUP BY song, k)
  SELECT song, string_agg(style, ',' ORDER BY n) AS styles FROM u GROUP BY song""")
def u1_distinct_styles(spark: SparkSession, d: str) -> DataFrame:
    rows = sections(spark, d).withColumn("k", F.lower(F.trim("role")))
    first = rows.groupBy("song", "k").agg(F.min_by("role", "n").alias("style"), F.min("n").alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "style"))), lambda x: x["style"]), ",")
    return first.groupBy("song").agg(joined.alias("styles"))


@query(f"""WITH {SECTIONS} SELECT song, max(n) - min(n) + 1 = count(DISTINCT n) AS contiguous, min(n) AS first_n, max(n) AS last_n FROM sections WHERE role <> 'outro' GROUP BY song""")
def u2_contiguous_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = sections(spark, d).filter("role <> 'outro'")
    return rows.groupBy("song").agg((F.max("n") - F.min("n") + 1 == F.count_distinct("n")).alias("contiguous"), F.min("n").alias("first_n"), F.max("n").alias("last_n"))


@query(f"""WITH {_ENERGY}, k AS (SELECT *, unnest(range(0, bars)) AS k FROM eb), b AS (SELECT song, start_bar + k AS bar, e_start + (e_end - e_start) * (k + 0.5) / bars AS e, clip IS NOT NULL AS speech FROM k)
  SELECT song, bar // 4 AS col, round(avg(e), 10) AS level, bool_or(speech) AS speech FROM b GROUP BY ALL""")
def l10_timeline_strip(spark: SparkSession, d: str) -> DataFrame:
    rows = sections(spark, d)
    bars = L.bar_energies(rows.withColumn("speech", F.col("clip").isNotNull()), "speech")
    return bars.groupBy("song", F.floor(F.col("bar") / 4).alias("col")).agg(F.round(F.avg("energy"), 10).alias("level"), F.bool_or("speech").alias("speech"))
