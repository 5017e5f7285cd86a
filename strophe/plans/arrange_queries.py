"""Queries that put clips on sentences and songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators import arrange as R
from strophe.operators import sentences as S
from strophe.operators import timeline as TL
from strophe.tables import FRAMES, SECTIONS, frames, load, sections, talk_words

from .registry import query
from .text_queries import _TIMED
from .timeline_queries import _PLACED

_SENT = "se AS (SELECT talk_id, sentence + 1 AS id, string_agg(w, ' ' ORDER BY pos) AS text, arg_min(start_ms, pos) AS start_ms, max(end_ms) AS end_ms FROM st GROUP BY talk_id, sentence)"


@query(f"""WITH {_TIMED}, {_SENT}, cl AS (SELECT conv_id AS talk_id, turn AS clip, turn * 2 + 1 AS first, turn * 2 + 1 + turn % 3 AS last FROM conversations)
  SELECT cl.talk_id, clip, string_agg(text, ' ' ORDER BY id) AS text, max(end_ms) - arg_min(start_ms, id) AS length_ms FROM cl JOIN se ON se.talk_id = cl.talk_id AND id BETWEEN first AND last GROUP BY cl.talk_id, clip, first, last HAVING count(*) = last - first + 1""")
def j10_clip_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = S.sentence_rows(S.timed_sentences(talk_words(spark, d), "talk_id", 1500), "talk_id").select("talk_id", "id", "text", "start_ms", "end_ms")
    t = F.col("turn")
    clips = load(spark, d, "conversations").select(F.col("conv_id").alias("talk_id"), t.alias("clip"), (t * 2 + 1).alias("first"), (t * 2 + 1 + t % 3).alias("last"))
    return R.clip_spans(clips, rows)


@query(f"""WITH {SECTIONS}, o AS (SELECT song, list(role ORDER BY n) AS names FROM sections GROUP BY song) SELECT song, array_to_string(list_transform(names, lambda r: CASE r WHEN 'drop' THEN 'chorus' WHEN 'intro' THEN 'opening' ELSE r END), ',') AS renamed FROM o""")
def j14_renamed(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*map(F.lit, ("drop", "chorus", "intro", "opening")))
    order = sections(spark, d).groupBy("song").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "role"))), lambda x: x["role"]).alias("o"))
    return order.select("song", F.array_join(R.renamed(F.col("o"), names), ",").alias("renamed"))


@query(f"WITH {_PLACED} SELECT song, n, clip, start_bar * 88200 AS start_sample, start_bar * 88200 + p_size * 1000 AS end_sample FROM placed JOIN part ON clip = 'c' || p_partkey WHERE p_size > 3")
def j16_place_clips(spark: SparkSession, d: str) -> DataFrame:
    lengths = load(spark, d, "part").filter("p_size > 3").select(F.concat(F.lit("c"), F.col("p_partkey")).alias("clip"), (F.col("p_size") * 1000).cast("long").alias("samples"))
    return R.placed_clips(TL.placed(sections(spark, d)), lengths, 120.0, 44_100)


@query("SELECT event_id, round(value + 1.25, 3) AS start, round(value + 2.25, 3) AS word_end FROM events")
def j20_shifted_segments(spark: SparkSession, d: str) -> DataFrame:
    word = F.struct(F.lit("w").alias("w"), F.col("value").alias("start"), (F.col("value") + 1).alias("end"))
    segments = F.array(F.struct(F.col("value").alias("start"), (F.col("value") + 1).alias("end"), F.array(word).alias("words")))
    moved = load(spark, d, "events").select("event_id", F.get(R.shifted(segments, 1.25), F.lit(0)).alias("s"))
    return moved.select("event_id", "s.start", F.get("s.words", F.lit(0))["end"].alias("word_end"))


@query(f"WITH {FRAMES}, t AS (SELECT *, max(db) OVER (PARTITION BY stream) AS top FROM frames) SELECT stream, max(CASE WHEN db >= top - 3 THEN i END)::BIGINT AS last FROM t GROUP BY stream")
def w21_audible_end(spark: SparkSession, d: str) -> DataFrame:
    return R.audible_end(frames(spark, d), "stream", "i", "db", 3.0).select("stream", F.col("last").cast("long").alias("last"))


@query(f"""WITH {_PLACED}, p AS (SELECT song, (start_bar * 100)::BIGINT AS s, ((start_bar + bars) * 100)::BIGINT AS e, -bars * 1.0::DOUBLE AS g FROM placed WHERE clip IS NOT NULL), a AS (SELECT song, (start_bar * 100 + k * 90)::BIGINT AS p FROM (SELECT song, start_bar, unnest(range(0, bars)) AS k FROM placed)),
  m AS (SELECT a.song, a.p, min(g * CASE WHEN (a.p - (s - 60)) / 60.0 < 1 THEN 0.5 - 0.5 * cos(pi() * (a.p - (s - 60)) / 60.0) WHEN a.p >= e THEN 0.5 + 0.5 * cos(pi() * (a.p - e) / 60.0) ELSE 1 END) AS d FROM a LEFT JOIN p ON p.song = a.song AND a.p >= greatest(0, s - 60) AND a.p < e + 60 GROUP BY 1, 2)
  SELECT song, p AS "at", round(coalesce(d, 0), 6) AS gain_db FROM m""")
def w19_passage_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = TL.placed(sections(spark, d))
    start, end = F.col("start_bar") * 100, (F.col("start_bar") + F.col("bars")) * 100
    passages = rows.filter("clip is not null").select("song", start.alias("start"), end.alias("end"), (-F.col("bars").cast("double")).alias("gain_db"))
    at = rows.select("song", "start_bar", F.explode(F.sequence(F.lit(0), F.col("bars") - 1)).alias("k")).select("song", (F.col("start_bar") * 100 + F.col("k") * 90).alias("at")).distinct()
    return R.passage_gains(passages, "song", at, 60).withColumn("gain_db", F.round("gain_db", 6)).select("song", "at", "gain_db")


@query(f"""WITH {SECTIONS}, c AS (SELECT song, role, n, list_transform(range(0, bars), lambda i: ['A', 'F', 'C', 'G'][(i % (bars % 4 + 1)) % 4 + 1]) AS ch FROM sections)
  SELECT song, role, row_number() OVER (PARTITION BY song, role ORDER BY n)::INT AS k, array_to_string(ch[1:list_filter(range(1, len(ch) + 1), lambda p: len(list_filter(range(1, len(ch) + 1), lambda i: ch[i] <> ch[(i - 1) % p + 1])) = 0)[1]], ' ') AS chords FROM c""")
def j23_role_cycles(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, "AFCG"))
    chords = F.transform(F.sequence(F.lit(0), F.col("bars") - 1), lambda i: F.get(names, i % (F.col("bars") % 4 + 1) % 4))
    return R.role_cycles(sections(spark, d).withColumn("chords", chords)).withColumn("chords", F.array_join("chords", " "))


@query(f"WITH {SECTIONS} SELECT DISTINCT clip FROM sections WHERE clip IS NOT NULL AND clip NOT IN (SELECT 'c' || p_partkey FROM part WHERE p_size % 2 = 0)")
def p10_missing_references(spark: SparkSession, d: str) -> DataFrame:
    known = load(spark, d, "part").filter("p_size % 2 = 0").select(F.concat(F.lit("c"), F.col("p_partkey")).alias("clip"))
    return R.missing_references(sections(spark, d).filter("clip is not null"), known, "clip")
