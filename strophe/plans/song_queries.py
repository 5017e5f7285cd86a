"""Queries over songs, talks and pages by rule, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.operators import sentences as S
from strophe.operators import songs as G
from strophe.operators import theory as H
from strophe.sources import pages as P
from strophe.tables import FRAMES, SECTIONS, TALK_WORDS, frames, load, sections, talk_words

from .registry import query
from .text_queries import _OFFICIAL, _TIMED

_LETTER = "strpos('CDEFGAB', letter) - 1"
_NAMES = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""WITH {FRAMES}, k AS (SELECT mode, t::INT AS tonic, n AS nm, s FROM (SELECT 'major' AS mode, unnest(range(12)) AS t, unnest({_NAMES(H.TONICS['major'])}) AS n, {H.SCALES['major']} AS s UNION ALL SELECT 'minor', unnest(range(12)), unnest({_NAMES(H.TONICS['minor'])}), {H.SCALES['minor']})),
  r AS (SELECT k.*, left(nm, 1) AS letter, unnest(range(12))::INT AS pc FROM k), a AS (SELECT *, list_position(s, (pc - tonic + 12) % 12) - 1 AS step FROM r),
  b AS (SELECT *, ({_LETTER} + step) % 7 AS li FROM a), c AS (SELECT *, ((pc - [0, 2, 4, 5, 7, 9, 11][li + 1] + 18) % 12 - 6) AS off FROM b),
  spelled AS (SELECT mode, tonic, pc, CASE WHEN step >= 0 THEN substr('CDEFGAB', li + 1, 1) || repeat('#', greatest(off, 0)) || repeat('b', greatest(-off, 0))
    WHEN list_contains(CASE mode WHEN 'major' THEN {G.FLAT_KEYS['major']} ELSE {G.FLAT_KEYS['minor']} END, tonic) THEN {_NAMES(G.FLATS)}[pc + 1] ELSE {_NAMES(G.SHARPS)}[pc + 1] END AS note FROM c), heard AS (SELECT stream, CASE WHEN stream % 2 = 0 THEN 'minor' ELSE 'major' END AS mode, (stream % 12)::INT AS tonic, (round_even(midi, 0)::INT % 12)::INT AS pc, count(*) AS n FROM frames WHERE midi IS NOT NULL GROUP BY ALL)
  SELECT stream, mode, tonic, pc, note, n FROM heard JOIN spelled USING (mode, tonic, pc)""")
def f3_spelled_keys(spark: SparkSession, d: str) -> DataFrame:
    """The pitch classes that each stream's voiced frames sound, spelled in the stream's key."""
    key = [F.when(F.col("stream") % 2 == 0, "minor").otherwise("major").alias("mode"), (F.col("stream") % 12).cast("int").alias("tonic")]
    heard = frames(spark, d).filter("midi IS NOT NULL").groupBy("stream", *key, (F.bround("midi").cast("int") % 12).alias("pc")).agg(F.count("*").alias("n"))
    return heard.join(F.broadcast(G.spelled_keys(spark)), ["mode", "tonic", "pc"]).select("stream", "mode", "tonic", "pc", "note", "n")  # 288 notes


@query("""SELECT p_partkey, 4.0::DOUBLE / CASE p_size % 3 WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 16 END AS beats, round(4 * 60.0 / (60 + p_size), 9) AS bar_s, round(greatest(0.0, least(p_retailprice / 100, p_size - 3.5)), 9) AS spoken_s,
  CASE p_size % 4 WHEN 0 THEN 4.5 WHEN 1 THEN 1.7 ELSE 0.5 END::DOUBLE AS ending_s, CASE WHEN p_size % 3 >= 2 AND p_size % 4 < 2 THEN 20000 ELSE 0 END AS tail_ms FROM part""")
def f10_tempo_and_endings(spark: SparkSession, d: str) -> DataFrame:
    """F10, F12, F14, F15, F30."""
    parts, size = load(spark, d, "part"), F.col("p_size")
    grid = F.when(size % 3 == 0, "1/4").when(size % 3 == 1, "1/8").otherwise("1/16")
    ending = F.when(size % 4 == 0, "held_chord").when(size % 4 == 1, "stop").otherwise("fade")
    return parts.select(
        "p_partkey", G.grid_beats(grid).alias("beats"), F.round(G.bar_seconds((60 + size).cast("double")), 9).alias("bar_s"), F.round(G.spoken_seconds(F.lit(3.5), size.cast("double"), F.col("p_retailprice") / 100), 9).alias("spoken_s"),
        G.ending_seconds(ending, F.lit(4.0), F.lit(1.2)).alias("ending_s"), G.tail_ms(size % 3, ending).alias("tail_ms"),
    )


@query("""SELECT p_partkey, list_aggregate(CASE WHEN g >= s THEN range(s) WHEN g = 1 THEN [0] ELSE list_concat(range(g - 1), [s - 1]) END, 'string_agg', ',') AS slots FROM (SELECT p_partkey, p_size % 5 + 1 AS g, p_size % 7 + 1 AS s FROM part)""")
def d6_used_slots(spark: SparkSession, d: str) -> DataFrame:
    slots = G.used_slots((F.col("p_size") % 5 + 1).cast("int"), (F.col("p_size") % 7 + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", F.array_join(F.transform(slots, lambda x: x.cast("string")), ",").alias("slots"))


@query("""SELECT p_partkey, array_to_string(list_concat([CASE WHEN b % 2 = 0 THEN (b // 2)::VARCHAR ELSE (b // 2)::VARCHAR || '.5' END || ' BPM', 'A minor'], CASE WHEN p_size % 3 = 0 THEN [] ELSE ['half-time feel'] END), '|') AS styles FROM (SELECT *, (p_size + 160)::INT AS b FROM part)""")
def f31_tempo_styles(spark: SparkSession, d: str) -> DataFrame:
    feel = F.when(F.col("p_size") % 3 == 0, "normal").otherwise("half-time")
    return load(spark, d, "part").select("p_partkey", F.array_join(G.tempo_styles((F.col("p_size") + 160) / 2, F.lit("A minor"), feel), "|").alias("styles"))


_SPANS = "cl AS (SELECT conv_id AS talk_id, turn AS clip, turn * 4000 + 700 AS cs, turn * 4000 + 3300 AS ce, turn * 200000 AS lo, turn * 200000 + 110000 AS until FROM conversations)"


@query(f"""WITH {TALK_WORDS}, {_SPANS} SELECT cl.talk_id, clip, pos, w, greatest(lo + round_even((start_ms - cs) * 44.1, 0)::BIGINT, lo) AS start_sample, least(lo + round_even((end_ms + 150.0 - cs) * 44.1, 0)::BIGINT, until) AS end_sample
  FROM cl JOIN talk_words w ON w.talk_id = cl.talk_id AND (start_ms + end_ms) / 2 >= cs AND (start_ms + end_ms) / 2 < ce""")
def p13_word_spans(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    clips = load(spark, d, "conversations").select(F.col("conv_id").alias("talk_id"), t.alias("clip"), (t * 4000 + 700).alias("clip_start"), (t * 4000 + 3300).alias("clip_end"), (t * 200_000).alias("at"), (t * 200_000 + 110_000).alias("until"))
    return G.word_spans(talk_words(spark, d), clips, ["talk_id"], 44_100.0, 4000)


@query(f"""WITH {_OFFICIAL}, m AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS g FROM official WHERE pos % 11 IN (3, 4, 5)) SELECT doc_id, line, min(pos) AS first, max(pos) AS last, string_agg(word, ' ' ORDER BY pos) AS text FROM m GROUP BY doc_id, line, g""")
def p16_unspoken_spans(spark: SparkSession, d: str) -> DataFrame:
    words = S.official_words(load(spark, d, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), "word", F.col("line").cast("long").alias("line"))
    return G.flagged_spans(words, ["doc_id", "line"], "pos", (F.col("pos") % 11).isin(3, 4, 5), "word")


@query(f"""WITH {TALK_WORDS}, m AS (SELECT *, pos - row_number() OVER (PARTITION BY talk_id ORDER BY pos) AS g FROM talk_words WHERE pos % 9 IN (4, 5)) SELECT talk_id, min(pos) AS first, max(pos) AS last, string_agg(w, ' ' ORDER BY pos) AS text, arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS end_ms FROM m GROUP BY talk_id, g""")
def p17_asr_only_spans(spark: SparkSession, d: str) -> DataFrame:
    return G.flagged_spans(talk_words(spark, d), ["talk_id"], "pos", (F.col("pos") % 9).isin(4, 5), "w", F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"))


@query(f"""WITH {_TIMED}, se AS (SELECT talk_id, sentence + 1 AS id, min(pos) AS ws, max(pos) + 1 AS we FROM st GROUP BY ALL), q AS (SELECT conv_id AS talk_id, turn * 5 AS word FROM conversations) SELECT q.talk_id, word, id FROM q JOIN se ON se.talk_id = q.talk_id AND word >= ws AND word < we""")
def j12_sentence_of(spark: SparkSession, d: str) -> DataFrame:
    rows = S.sentence_rows(S.timed_sentences(talk_words(spark, d), "talk_id", 1500), "talk_id").withColumn("id", F.col("id").cast("long"))
    return G.sentence_of(load(spark, d, "conversations").select(F.col("conv_id").alias("talk_id"), (F.col("turn") * 5).alias("word")), rows, ["talk_id"], "word")


@query(f"""WITH {TALK_WORDS}, r AS (SELECT conv_id AS talk_id, turn * 7 AS lo, turn * 7 + 4 AS hi FROM conversations) SELECT talk_id, pos FROM talk_words t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.talk_id = t.talk_id AND t.pos >= lo AND t.pos < hi)""")
def w24_uncovered_words(spark: SparkSession, d: str) -> DataFrame:
    """The words that W24 gives to sentences of their own or to neighbours."""
    ranges = load(spark, d, "conversations").select(F.col("conv_id").alias("talk_id"), (F.col("turn") * 7).alias("lo"), (F.col("turn") * 7 + 4).alias("hi"))
    words = talk_words(spark, d).withColumn("pos", F.col("pos").cast("long"))
    return G.uncovered_words(words, ranges, ["talk_id"])


@query("""SELECT l_orderkey, bool_or(k IN ('invalid', 'overlap', 'budget', 'required')) AS retry, CASE WHEN min(l_quantity % 5) = 0 THEN 0 ELSE sum(l_quantity % 5) END::BIGINT AS usable FROM (SELECT *, ['score', 'order', 'invalid', 'count', 'overlap', 'budget', 'required', 'role', 'text'][l_partkey % 9 + 1] AS k FROM lineitem) GROUP BY l_orderkey""")
def p2_retry_and_usable(spark: SparkSession, d: str) -> DataFrame:
    """P2 and A19."""
    kinds = F.get(F.array(*map(F.lit, ("score", "order", "invalid", "count", "overlap", "budget", "required", "role", "text"))), (F.col("l_partkey") % 9).cast("int"))
    usable = G.usable_all((F.col("l_quantity") % 5).cast("long"))
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(G.needs_retry(kinds).alias("retry"), usable.cast("long").alias("usable"))


@query("""SELECT p_partkey, coalesce(a, 8) AS n, greatest(1, coalesce(a, 8) - CASE WHEN a IS NULL THEN t ELSE 0 END, r) AS least, greatest(coalesce(a, 8) + CASE WHEN a IS NULL THEN t ELSE 0 END, r) AS most FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size END AS a, p_size % 11 AS t, p_size % 13 AS r FROM part)""")
def g2_clip_targets(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    n, least, most = G.clip_counts(F.lit(8), size % 11, F.when(size % 4 == 0, size), size % 13)
    return load(spark, d, "part").select("p_partkey", n.alias("n"), least.alias("least"), most.alias("most"))


@query(f"""WITH {FRAMES}, g AS (SELECT stream, round_even(midi, 0)::INT % 12 AS pc, sum(0.25 + i % 4) AS w FROM frames WHERE midi IS NOT NULL GROUP BY ALL)
  SELECT s.stream, p.pc::INT AS pc, coalesce(w, 0.0)::DOUBLE AS beats FROM (SELECT DISTINCT stream FROM g) s CROSS JOIN range(12) p(pc) LEFT JOIN g ON g.stream = s.stream AND g.pc = p.pc""")
def a7_pitch_weights(spark: SparkSession, d: str) -> DataFrame:
    notes = frames(spark, d).withColumn("beats", (F.col("i") % 4).cast("double") + 0.25)
    return H.pitch_classes(notes, "stream", "midi", "beats").withColumnRenamed("w", "beats")


@query(f"WITH {FRAMES} SELECT stream, i // 2 AS f, round(10 * log10(avg(pow(10.0::DOUBLE, db / 10)) + 1e-12), 6) AS level_db FROM frames GROUP BY ALL")
def a15_channel_levels(spark: SparkSession, d: str) -> DataFrame:
    two = frames(spark, d).withColumn("f", F.floor(F.col("i") / 2))
    return G.channel_levels(two, ["stream", "f"], "db").withColumn("level_db", F.round("level_db", 6))


@query(f"""WITH {SECTIONS} SELECT song, sum(bars)::BIGINT AS bars, sum(CASE WHEN rest THEN 0 ELSE bars END)::BIGINT AS music_bars, round((sum(bars) * 2.0 + CASE song % 3 WHEN 0 THEN 4.5 WHEN 1 THEN 1.7 ELSE 0.5 END)::DOUBLE, 6) AS seconds FROM sections GROUP BY song""")
def a17_song_seconds(spark: SparkSession, d: str) -> DataFrame:
    """All bars, those with music, and the seconds with the ending."""
    ending = F.when(F.col("song") % 3 == 0, "held_chord").when(F.col("song") % 3 == 1, "stop").otherwise("fade")
    total = sections(spark, d).groupBy("song").agg(F.sum("bars").alias("bars"), F.sum(F.when(F.col("rest"), 0).otherwise(F.col("bars"))).alias("music_bars"))
    return total.withColumn("seconds", F.round(F.col("bars") * G.bar_seconds(F.lit(120.0)) + G.ending_seconds(ending, F.lit(4.0), F.lit(1.2)), 6))


@query("""SELECT l_orderkey, sum(CASE WHEN l_suppkey % 3 = 0 THEN l_partkey ELSE l_quantity * 100 END)::BIGINT AS total_ms, round(sum(CASE WHEN l_suppkey % 3 = 0 THEN l_partkey ELSE l_quantity * 100 END) / 60000, 6) AS minutes FROM lineitem GROUP BY l_orderkey""")
def a18_plan_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Kept slices count by their range, generated ones by their duration."""
    kept = F.col("l_suppkey") % 3 == 0
    ms = F.when(kept, (F.col("l_partkey") + 500) - F.lit(500)).otherwise((F.col("l_quantity") * 100).cast("long"))
    total = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(ms).alias("total_ms"))
    return total.withColumn("minutes", F.round(F.col("total_ms") / 60_000, 6))


@query(f"""WITH {SECTIONS}, f AS (SELECT song, clip, min(n) AS n1 FROM sections WHERE clip IS NOT NULL GROUP BY ALL) SELECT song, string_agg(clip, ',' ORDER BY n1) AS refs FROM f GROUP BY song""")
def u3_plan_references(spark: SparkSession, d: str) -> DataFrame:
    return G.distinct_in_order(sections(spark, d), "song", "n", "clip").select("song", F.array_join("values", ",").alias("refs"))


@query(f"WITH {SECTIONS} SELECT song, (n - 1) // 3 AS chunk, arg_min(role, n) AS role, min(n) AS n FROM sections WHERE NOT silent GROUP BY ALL")
def l5_chunk_mains(spark: SparkSession, d: str) -> DataFrame:
    chunked = sections(spark, d).withColumn("chunk", F.floor((F.col("n") - 1) / 3).cast("int")).filter(~F.col("silent"))
    return chunked.groupBy("song", "chunk").agg(F.min_by("role", "n").alias("role"), F.min("n").alias("n"))


@query(f"""WITH {SECTIONS}, b AS (SELECT song, n, silent OR rest AS quiet, lag(silent OR rest) OVER (PARTITION BY song ORDER BY n) AS qb, bars, unnest(range(bars)) AS bar FROM sections), l AS (SELECT *, (bar * 5 + n * 7) % 31 - 40 - CASE WHEN bar < n % 3 THEN 30 ELSE 0 END AS level FROM b),
  m AS (SELECT song, n, median(level) AS mid, count(*) AS nb, arg_min(level, bar) AS opens FROM l WHERE NOT quiet AND qb GROUP BY song, n)
  SELECT l.song, l.n, min(bar)::INT AS late FROM l JOIN m ON m.song = l.song AND m.n = l.n WHERE opens < mid - 15 AND level >= mid - 6 GROUP BY l.song, l.n, nb HAVING min(bar) <= 4 AND 2 * min(bar) <= nb""")
def w17_late_entries(spark: SparkSession, d: str) -> DataFrame:
    quiet = F.col("silent") | F.col("rest")
    rows = sections(spark, d).withColumn("quiet", quiet).withColumn("quiet_before", F.coalesce(F.lag("quiet").over(Window.partitionBy("song").orderBy("n")), F.lit(False)))
    bars = rows.select("song", "n", "quiet", "quiet_before", F.explode(F.sequence(F.lit(0), F.col("bars") - 1)).alias("bar"))
    level = (F.col("bar") * 5 + F.col("n") * 7) % 31 - 40 - F.when(F.col("bar") < F.col("n") % 3, 30).otherwise(0)
    return G.late_entries(bars.withColumn("level", level), 4)


@query(f"""WITH {FRAMES}, g AS (SELECT stream, round_even(midi, 0)::INT % 12 AS pc, count(*)::DOUBLE AS w FROM frames WHERE midi IS NOT NULL GROUP BY ALL), t AS (SELECT stream, sum(w) AS total FROM g GROUP BY stream),
  c AS (SELECT unnest([0, 5, 7]) AS r, unnest([[0, 4, 7], [5, 9, 0], [7, 11, 2]]) AS pcs), h AS (SELECT stream, r, sum(w) AS held FROM g JOIN c ON list_contains(pcs, pc) GROUP BY ALL)
  SELECT t.stream, round(sum(coalesce(held, 0) * CASE r WHEN 0 THEN 2 ELSE 1 END) / any_value(total) / 4, 9) AS fit FROM t LEFT JOIN h ON h.stream = t.stream GROUP BY t.stream""")
def f7_progression_fit(spark: SparkSession, d: str) -> DataFrame:
    """Degrees 1 4 5 1 of C major over the pitch classes of each stream."""
    weights = H.pitch_classes(frames(spark, d).withColumn("one", F.lit(1.0)), "stream", "midi", "one")
    rows = weights.groupBy("stream").agg(F.transform(F.array_sort(F.collect_list(F.struct("pc", "w"))), lambda x: x["w"]).alias("ws"))  # twelve of each
    chords = F.array(*(F.array(*map(F.lit, pcs)) for _, pcs in H.triads("major", 0)))
    return rows.select("stream", F.round(G.progression_fit(F.array(*map(F.lit, (1, 4, 5, 1))), chords, F.col("ws")), 9).alias("fit"))


@query("""SELECT o_orderkey, coalesce(a, b, c, 'C major') AS value, CASE WHEN a IS NOT NULL THEN 'override' WHEN b IS NOT NULL THEN 'preset' WHEN c IS NOT NULL THEN 'detected' ELSE 'fallback' END AS origin
  FROM (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'D minor' END AS a, CASE WHEN o_custkey % 3 = 0 THEN 'E major' END AS b, CASE WHEN o_custkey % 5 = 0 THEN 'F major' END AS c FROM orders)""")
def f29_resolved_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey")
    chosen = G.by_precedence(load(spark, d, "orders"), ("override", F.when(k % 4 == 0, "D minor")), ("preset", F.when(k % 3 == 0, "E major")), ("detected", F.when(k % 5 == 0, "F major")), ("fallback", F.lit("C major")))
    return chosen.select("o_orderkey", "value", "origin")


@query("SELECT event_id, round(value * CASE event_type WHEN 'click' THEN 0.15 WHEN 'view' THEN 0.02 END, 9) AS usd FROM events")
def f19_unit_usd(spark: SparkSession, d: str) -> DataFrame:
    """Units by price, null where an item has none."""
    prices = spark.createDataFrame([("click", 0.15), ("view", 0.02)], "event_type string, price double")
    return load(spark, d, "events").join(F.broadcast(prices), "event_type", "left").select("event_id", F.round(F.col("value") * F.col("price"), 9).alias("usd"))


@query("SELECT o_orderkey, sha256('{\"customer\":' || o_custkey || ',\"status\":\"' || o_orderstatus || '\"}') AS digest FROM orders")
def k6_request_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digest of a request as JSON with sorted keys."""
    body = F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status")))
    return load(spark, d, "orders").select("o_orderkey", F.sha2(body, 256).alias("digest"))


_ARC = """p AS (SELECT l_orderkey AS song, part, ['intro', 'build', 'speech_bed', 'verse', 'speech_bed'][l_partkey % 5 + 1] AS role, (l_quantity::INT - 10) AS bars, CASE WHEN l_suppkey % 2 = 0 THEN 'alone' ELSE 'bed' END AS treatment,
    CASE WHEN l_partkey % 5 IN (2, 4) AND l_suppkey % 7 > 0 OR l_partkey % 11 = 0 THEN ['c' || part, 'd' || part] ELSE [] END AS clips FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)::INT AS part FROM lineitem)),
  c AS (SELECT song, (row_number() OVER (PARTITION BY song ORDER BY part, i))::INT AS pos, clip, 'q' || (part // 2 + CASE WHEN song % 2 = 0 THEN i ELSE 0 END) AS quote FROM (SELECT song, part, unnest(['c' || part, 'd' || part]) AS clip, unnest([0, 1]) AS i FROM p WHERE role = 'speech_bed'))"""


@query(f"""WITH {_ARC}, k AS (SELECT *, role <> 'verse' AS known FROM p), pl AS (SELECT song, part, role, treatment, known, unnest(clips) AS clip, generate_subscripts(clips, 1) AS i FROM k),
  a AS (SELECT song, list(clip ORDER BY pos) AS want FROM c GROUP BY song), b AS (SELECT song, list(clip ORDER BY part, i) AS have FROM pl WHERE role = 'speech_bed' GROUP BY song),
  q AS (SELECT pl.*, coalesce(c.quote, pl.clip) AS quote FROM pl LEFT JOIN c ON c.song = pl.song AND c.clip = pl.clip)
  SELECT song, part, 'unknown role' AS kind FROM k WHERE NOT known UNION ALL SELECT song, part, 'no clip' FROM k WHERE role = 'speech_bed' AND len(clips) = 0 UNION ALL SELECT song, part, 'clips in music' FROM k WHERE known AND role <> 'speech_bed' AND len(clips) > 0
  UNION ALL SELECT song, part, 'bars' FROM k WHERE known AND role <> 'speech_bed' AND bars NOT BETWEEN 1 AND 32 UNION ALL SELECT a.song, NULL, 'order' FROM a LEFT JOIN b ON b.song = a.song WHERE coalesce(a.want <> b.have, true)
  UNION ALL SELECT song, NULL, 'torn quote' FROM q GROUP BY song, quote HAVING count(DISTINCT part) > 1 UNION ALL SELECT song, part, 'alone' FROM q WHERE role = 'speech_bed' AND treatment = 'alone' GROUP BY song, part HAVING count(DISTINCT quote) > 1
  UNION ALL SELECT song, NULL, 'many alone' FROM k GROUP BY song HAVING count(CASE WHEN role = 'speech_bed' AND treatment = 'alone' THEN 1 END) > 2 UNION ALL SELECT song, NULL, 'music bars' FROM k GROUP BY song HAVING sum(CASE WHEN known AND role <> 'speech_bed' THEN bars END) > 160
  UNION ALL SELECT song, NULL, 'parts' FROM k GROUP BY song HAVING count(*) > 40""")
def p4_arc_problems(spark: SparkSession, d: str) -> DataFrame:
    part = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    rows = load(spark, d, "lineitem").withColumn("part", part)
    role = F.get(F.array(*map(F.lit, ("intro", "build", "speech_bed", "verse", "speech_bed"))), (F.col("l_partkey") % 5).cast("int"))
    own = F.array(F.concat(F.lit("c"), F.col("part")), F.concat(F.lit("d"), F.col("part")))
    held = F.when((F.col("l_partkey") % 5).isin(2, 4) & (F.col("l_suppkey") % 7 > 0) | (F.col("l_partkey") % 11 == 0), own).otherwise(F.array().cast("array<string>"))
    parts = rows.select(F.col("l_orderkey").alias("song"), "part", role.alias("role"), (F.col("l_quantity").cast("int") - 10).alias("bars"), F.when(F.col("l_suppkey") % 2 == 0, "alone").otherwise("bed").alias("treatment"), held.alias("clips"))
    beds = parts.filter("role = 'speech_bed'").select("song", "part", F.posexplode(F.array(F.concat(F.lit("c"), F.col("part")), F.concat(F.lit("d"), F.col("part")))).alias("i", "clip"))
    number = F.floor(F.col("part") / 2) + F.when(F.col("song") % 2 == 0, F.col("i")).otherwise(0)
    clips = beds.select("song", (F.col("part") * 2 + F.col("i")).alias("pos"), "clip", F.concat(F.lit("q"), number).alias("quote"))
    return G.arc_problems(parts.withColumn("known", F.col("role") != "verse"), clips)


_REFS = "SELECT DISTINCT CASE WHEN user_id % 9 = 0 THEN 'latest' WHEN user_id % 9 = 1 THEN NULL ELSE substr('run' || user_id, 1, (user_id % 5 + 2)::INT) END AS ref FROM events"


@query(f"""WITH runs AS (SELECT DISTINCT 'run' || c_custkey AS run FROM customer), refs AS ({_REFS}), m AS (SELECT ref, count(run) AS found, max(CASE WHEN run = ref THEN run END) AS same, max(run) AS one FROM refs LEFT JOIN runs ON starts_with(run, ref) WHERE ref IS NOT NULL AND ref <> 'latest' GROUP BY ref)
  SELECT ref, coalesce(same, CASE WHEN found = 1 THEN one END) AS run, found FROM m UNION ALL SELECT ref, (SELECT max(run) FROM runs), 1 FROM refs WHERE ref IS NULL OR ref = 'latest'""")
def s22_resolved_runs(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("user_id")
    name = F.when(user % 9 == 0, "latest").when(user % 9 != 1, F.expr("substr(concat('run', user_id), 1, cast(user_id % 5 + 2 as int))"))
    refs = load(spark, d, "events").select(name.alias("ref")).distinct()
    return G.resolved_runs(refs, load(spark, d, "customer").select(F.concat(F.lit("run"), F.col("c_custkey")).alias("run")).distinct())


@query(r"""WITH u AS (SELECT page_id, 'https://e.org/study' || regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) || CASE WHEN page_id % 2 = 0 THEN '?lang=spa' ELSE '' END AS url FROM pages)
  SELECT page_id, 'https://api.e.org/c?lang=' || CASE WHEN page_id % 2 = 0 THEN 'spa' ELSE 'eng' END || '&uri=' || replace(url_encode(rtrim(regexp_extract(url, '^https://e.org/study([^?#]*)', 1), '/')), '%20', '+') AS api FROM u""")
def s8_api_urls(spark: SparkSession, d: str) -> DataFrame:
    path = F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit(""))
    url = F.concat(F.lit("https://e.org/study"), path, F.when(F.col("page_id") % 2 == 0, "?lang=spa").otherwise(""))
    return load(spark, d, "pages").select("page_id", P.api_url(url, "https://api.e.org/c").alias("api"))


@query()
def s10_linked_talks(spark: SparkSession, d: str) -> DataFrame:
    """Pages with linked data put before them (their own have none)."""
    data = F.to_json(F.struct(F.lit("Article").alias("@type"), F.lower("url").alias("headline"), F.array(F.struct(F.lit("Ann").alias("name")), F.struct(F.lit("Bo").alias("name"))).alias("author"), F.struct(F.concat("url", F.lit(".mp3")).alias("contentUrl")).alias("audio")))
    page = F.concat(F.lit('<script type="application/ld+json">'), data, F.lit('</script><div class="talk">'), F.col("html"), F.lit("</div>"))
    return P.talks_from_pages(load(spark, d, "pages").select("url", page.alias("html")), "talk")


@query()
def s7_api_talks(spark: SparkSession, d: str) -> DataFrame:
    """Pages as an API gives them, the speaker in a paragraph of its own."""
    meta = F.struct(F.lit("").alias("title"), F.create_map(F.lit("data-content-type"), F.lit("talk")).alias("pageAttributes"), F.array(F.struct(F.lit("other").alias("variant"), F.concat("url", F.lit("/a.mp3")).alias("mediaUrl"))).alias("audio"))
    body = F.struct(F.concat(F.lit('<p class="author-name">By Ann Example</p>'), F.col("html")).alias("body"))
    return P.talks_from_json(load(spark, d, "pages").select("url", F.to_json(F.struct(meta.alias("meta"), body.alias("content"))).alias("page")), "talk")
