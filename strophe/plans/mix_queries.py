"""Queries over phrases, gains, notes, stage records and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.operators import intervals as I
from strophe.operators import ledger as L
from strophe.operators import mixing as X
from strophe.operators import timeline as TL
from strophe.tables import FRAMES, SECTIONS, TALK_WORDS, frames, load, sections, talk_words

from . import cache
from .registry import query
from .timeline_queries import _PLACED


@query(f"WITH {SECTIONS}, m AS (SELECT song, n, -60 * energy AS db, max(-60 * energy) OVER (PARTITION BY song) AS top, max(n) OVER (PARTITION BY song) AS last, count(*) OVER (PARTITION BY song) AS c FROM sections) SELECT song, n FROM m WHERE c >= 2 AND n < last AND db <= top - 32")
def c5_dead_sections(spark: SparkSession, d: str) -> DataFrame:
    return X.dead_sections(sections(spark, d).withColumn("db", -60 * F.col("energy")), "song", "n", "db")


@query(f"WITH {FRAMES} SELECT stream, i, round_even(50 + 50 * greatest(0.0, 1 - (max(db) OVER (PARTITION BY stream) - db) / 30), 0)::INT AS velocity FROM frames")
def a20_velocities(spark: SparkSession, d: str) -> DataFrame:
    return X.velocities(frames(spark, d), "stream", "db").select("stream", "i", "velocity")


@query(rf"""WITH {TALK_WORDS}, x AS (SELECT talk_id, pos AS i, max(end_ms) OVER (PARTITION BY talk_id) - start_ms AS lft, start_ms - lag(end_ms) OVER w AS gap,
   coalesce(regexp_matches(regexp_replace(lag(w) OVER w, '["'')”’»]+$', ''), '[,;:.!?—–…]$') OR lag(pos // 40) OVER w <> pos // 40, false) AS mk FROM talk_words WINDOW w AS (PARTITION BY talk_id ORDER BY pos))
  SELECT talk_id, coalesce(max(CASE WHEN mk THEN i END), arg_max(i, (gap, i)))::BIGINT AS i FROM x WHERE i >= 1 AND lft BETWEEN 2000 AND 6000 GROUP BY talk_id""")
def w16_last_phrase(spark: SparkSession, d: str) -> DataFrame:
    words = talk_words(spark, d).withColumn("clip", F.floor(F.col("pos") / 40)).withColumnRenamed("pos", "i")
    return X.last_phrase(words, "talk_id", 2000, 6000).select("talk_id", F.col("i").cast("long").alias("i"))


_FADE = "CASE WHEN i < k THEN x * (0.5 - 0.5 * cos(pi() * (i + 0.5) / k)) WHEN i >= n - k THEN x * (0.5 - 0.5 * cos(pi() * (n - 1 - i + 0.5) / k)) ELSE x END"


@query(f"WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n, least(8, len(embedding) // 2) AS k FROM embeddings) SELECT vec_id, i, round({_FADE}, 6) AS x FROM e")
def z1_fade_edges(spark: SparkSession, d: str) -> DataFrame:
    values = F.transform("embedding", lambda x: x.cast("double"))
    return load(spark, d, "embeddings").select("vec_id", F.posexplode(X.faded(values, 8)).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"""WITH {_PLACED}, s AS (SELECT song, n, start_bar * 4.0::DOUBLE AS f, (start_bar + bars) * 4.0::DOUBLE AS t, n % 4 AS phrase FROM placed), nt AS (SELECT vec_id % 4 AS phrase, (vec_id % 13)::DOUBLE AS start, (vec_id % 3 + 1)::DOUBLE AS beats FROM (SELECT unnest(range(0, 24)) AS vec_id)),
  k AS (SELECT song, n, f + k * 16 + start AS "at", t, beats FROM (SELECT s.song, s.n, s.f, s.t, nt.start, nt.beats, unnest(range(0, ceil((s.t - s.f) / 16)::INT)) AS k FROM s JOIN nt ON nt.phrase = s.phrase)) SELECT song, n, "at", least(beats, t - "at") AS beats, count(*) AS notes FROM k WHERE "at" < t GROUP BY ALL""")
def l13_looped_notes(spark: SparkSession, d: str) -> DataFrame:
    at = TL.placed(sections(spark, d))
    spans = at.select("song", "n", (F.col("start_bar") * 4.0).alias("from_beat"), ((F.col("start_bar") + F.col("bars")) * 4.0).alias("to_beat"), (F.col("n") % 4).alias("phrase"))
    notes = spark.range(24).select((F.col("id") % 4).alias("phrase"), (F.col("id") % 13).cast("double").alias("start"), (F.col("id") % 3 + 1).cast("double").alias("beats"))
    return X.looped_counts(notes, spans, 16)


@query(f"""WITH {FRAMES}, l AS (SELECT *, max(i) OVER (PARTITION BY stream) // 16 AS last FROM frames), c AS (SELECT stream, i, unnest(range(greatest(0, (i - 4) // 16 - CASE WHEN i < 4 THEN 1 ELSE 0 END)::BIGINT, least((i + 4) // 16, last)::BIGINT + 1)) AS block FROM l)
  SELECT stream, block, max(i) - min(i) AS value, count(*) AS rows FROM c GROUP BY ALL""")
def r1_windows_with_context(spark: SparkSession, d: str) -> DataFrame:
    return X.windowed_map(frames(spark, d), "stream", "i", 16, 4, lambda i: (F.max(i) - F.min(i)).cast("long"))


@query()
def w7_segment_notes(spark: SparkSession, d: str) -> DataFrame:
    return X.note_pieces(frames(spark, d), "stream", "i", "midi", "db")


@query(f"""WITH {SECTIONS}, r AS (SELECT *, sum(CASE WHEN coalesce(lq = q, false) THEN 0 ELSE 1 END) OVER (PARTITION BY song ORDER BY n) AS run FROM (SELECT song, n, clip, bars % 2 AS q, lag(bars % 2) OVER (PARTITION BY song ORDER BY n) AS lq FROM sections))
  SELECT song, run::BIGINT AS run, min(n) AS first_n, count(*) AS parts FROM r GROUP BY ALL""")
def w13_quote_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = sections(spark, d).withColumn("q", F.col("bars") % 2)
    runs = I.island_ids(rows.withColumn("lq", F.lag("q").over(TL.in_song())), ["song"], ["n"], F.col("q") != F.col("lq"), "run")
    return runs.groupBy("song", "run").agg(F.min("n").alias("first_n"), F.count("*").alias("parts"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 'blocked' WHEN o_orderstatus = 'P' THEN 'not run' WHEN o_custkey % 7 = 0 THEN 'failed' WHEN o_custkey % 5 = 0 THEN 'interrupted' WHEN o_orderkey % 3 = 0 THEN 'stale' WHEN o_orderkey % 4 < 3 AND o_orderkey % 2 = 1 THEN 'missing outputs' ELSE 'complete' END AS state FROM orders""")
def k2_stage_states(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "P", None).when(c % 7 == 0, "failed").when(c % 5 == 0, "running").otherwise("complete")
    present = F.when((k % 4 < 3) & (k % 2 == 1), 1).otherwise(2)
    rows = load(spark, d, "orders").select("o_orderkey", (c % 11 == 0).cast("int").alias("waiting"), status.alias("status"), F.when(k % 3 == 0, "old").otherwise("new").alias("fingerprint"), F.lit("new").alias("wanted"), F.lit(2).alias("outputs"), present.alias("present"))
    return cache.states(rows).select("o_orderkey", "state")


@query("""SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(CASE WHEN b.p_partkey % 2 = 0 THEN b.p_brand END, a.p_brand) AS p_brand, coalesce(b.p_size, a.p_size) AS p_size
  FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 0) b USING (p_partkey)""")
def y5_merged_options(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    new = part.filter("p_partkey % 4 <> 0").withColumn("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")))
    return cache.merged_options(part.filter("p_partkey % 3 <> 0"), new, "p_partkey")


@query("""SELECT event_id, CASE WHEN b < 1000 THEN b || ' B' WHEN b < 1000000 THEN format('{:.1f} KB', b / 1e3) WHEN b < 1000000000 THEN format('{:.1f} MB', b / 1e6) ELSE format('{:.1f} GB', b / 1e9) END AS size,
  (c / 4)::BIGINT AS tokens FROM (SELECT event_id, event_id * event_id * 37 + 1 AS b, event_id * 8 AS c FROM events)""")
def f21_bytes_text(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("event_id") * F.col("event_id") * 37 + 1
    return load(spark, d, "events").select("event_id", L.bytes_text(b).alias("size"), F.bround(F.col("event_id") * 8 / 4).cast("long").alias("tokens"))


@query("SELECT user_id, props->>'$.k' AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s11_parse_props(spark: SparkSession, d: str) -> DataFrame:
    """JSON fields read with a declared schema, as the probe parser does."""
    rows = load(spark, d, "events").select("user_id", F.from_json("props", "k string").alias("p"), "value")
    return rows.groupBy("user_id", F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(r"SELECT doc_id, sha256(text) AS sha, length(text) AS size, regexp_matches(text, '^\s*$') AS blank FROM documents")
def k4_content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("size"), F.col("text").rlike(r"^\s*$").alias("blank"))


@query(f"""WITH {TALK_WORDS}, a AS (SELECT talk_id, pos, w, start_ms, end_ms FROM talk_words), wi AS (SELECT conv_id AS talk_id, (turn * 5000)::BIGINT AS lo, (turn * 5000 + 1500)::BIGINT AS hi FROM conversations),
  o AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM wi WHERE wi.talk_id = a.talk_id AND a.start_ms + 150 BETWEEN lo AND hi)), n AS (SELECT talk_id, 'new' AS w, lo + 100 AS start_ms, lo + 900 AS end_ms FROM wi),
  u AS (SELECT talk_id, w, start_ms, end_ms FROM o UNION ALL SELECT * FROM n), r AS (SELECT *, row_number() OVER x - 1 AS pos, coalesce(max(end_ms) OVER (PARTITION BY talk_id ORDER BY start_ms, end_ms, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM u WINDOW x AS (PARTITION BY talk_id ORDER BY start_ms, end_ms, w))
  SELECT talk_id, pos, w, greatest(start_ms, reach) AS start_ms, greatest(end_ms, start_ms, reach) AS end_ms FROM r""")
def j19_apply_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Words inside repair windows (midpoints, ends included) give way to new ones; times then never overlap."""
    words = talk_words(spark, d).withColumn("mid", F.col("start_ms") + 150)
    windows = load(spark, d, "conversations").select(F.col("conv_id").alias("talk_id"), (F.col("turn") * 5000).alias("lo"), (F.col("turn") * 5000 + 1500).alias("hi"))
    gone = I.containing_join(words, windows, ["talk_id"], "mid", ("lo", "hi"), 5000, closed=True).select("talk_id", "pos").distinct()
    kept = words.join(gone, ["talk_id", "pos"], "left_anti").select("talk_id", "w", "start_ms", "end_ms")
    new = windows.select("talk_id", F.lit("new").alias("w"), (F.col("lo") + 100).alias("start_ms"), (F.col("lo") + 900).alias("end_ms"))
    by = Window.partitionBy("talk_id").orderBy("start_ms", "end_ms", "w")
    reach = F.coalesce(F.max("end_ms").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = kept.unionByName(new).withColumn("pos", F.row_number().over(by) - 1).withColumn("reach", reach)
    return both.select("talk_id", "pos", "w", F.greatest("start_ms", "reach").alias("start_ms"), F.greatest("end_ms", "start_ms", "reach").alias("end_ms"))


@query(r"""SELECT doc_id, len(ws) AS words, len(list_filter(ws, lambda w: regexp_matches(w, '(?i)^(vocal|vocals|voice|singing|lyrics)[.,]*$'))) AS voice_words FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM documents)""")
def p5_style_words(spark: SparkSession, d: str) -> DataFrame:
    ws = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return load(spark, d, "documents").select("doc_id", F.size(ws).cast("long").alias("words"), F.size(F.filter(ws, lambda w: w.rlike("(?i)^(vocal|vocals|voice|singing|lyrics)[.,]*$"))).cast("long").alias("voice_words"))


