"""Queries over frames, gaps and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.operators import intervals as I
from strophe.operators import ledger as L
from strophe.operators import series as S
from strophe.operators import signals as G
from strophe.tables import FRAMES, TALK_WORDS, frames, load, talk_words

from .registry import ORACLE, query


@query("SELECT coalesce(l_returnflag, 'total') AS service, round(sum(l_extendedprice), 2) AS usd FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def a1_ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    entries = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("service"), F.col("l_extendedprice").cast("decimal(18,2)").alias("usd"))
    return L.totals(entries, "service", "usd").withColumn("usd", F.round(F.col("usd").cast("double"), 2))


@query("SELECT coalesce(CASE WHEN l_linenumber > 1 THEN strftime(l_shipdate, '%Y') END, 'summary') AS length, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS usd, count(*) AS n FROM lineitem GROUP BY 1")
def a2_costs_by_length(spark: SparkSession, d: str) -> DataFrame:
    length = F.coalesce(F.when(F.col("l_linenumber") > 1, F.date_format("l_shipdate", "yyyy")), F.lit("summary"))
    return load(spark, d, "lineitem").groupBy(length.alias("length")).agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 2).alias("usd"), F.count("*").alias("n"))


_PRICED = "SELECT o.o_orderkey, o.o_custkey, CASE WHEN p.p_size % 9 <> 0 THEN p.p_retailprice * (o.o_orderkey % 7 + 1) END AS usd FROM orders o JOIN part p ON p.p_partkey = o.o_orderkey % 200 + 1"


@query(f"SELECT o_custkey, round(CASE WHEN bool_or(usd IS NULL) THEN NULL ELSE sum(usd) END, 4) AS estimate, round(coalesce(sum(usd), 0), 4) AS known, count(*) FILTER (usd IS NULL) AS unpriced FROM ({_PRICED}) GROUP BY o_custkey")
def a3_estimates(spark: SparkSession, d: str) -> DataFrame:
    price = load(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size", "p_retailprice")
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 200 + 1).alias("k"))
    usd = F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice") * (F.col("o_orderkey") % 7 + 1))
    rows = orders.join(price, "k").select("o_custkey", usd.alias("usd"))
    return rows.groupBy("o_custkey").agg(F.round(L.estimate_total(F.col("usd")), 4).alias("estimate"), F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 4).alias("known"), F.count_if(F.col("usd").isNull()).alias("unpriced"))


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity * 100 * p_retailprice + l_partkey * p_size + l_suppkey * coalesce(CASE WHEN p_size % 2 = 0 THEN 0.5 END, 0.1 * p_retailprice)
   + l_linenumber * coalesce(CASE WHEN p_size % 3 = 0 THEN 2.0 END, 1.25 * p_retailprice)) / 1000000, 11) AS usd FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size % 10 <> 0) ON p_partkey = l_partkey""")
def f18_call_usd(spark: SparkSession, d: str) -> DataFrame:
    price = load(spark, d, "part").filter("p_size % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size")
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey").join(price, "l_partkey", "left")
    usd = L.call_usd(F.col("l_quantity") * 100, F.col("l_partkey"), F.col("p_retailprice"), F.col("p_size"), F.col("l_suppkey"), F.col("l_linenumber"), F.when(F.col("p_size") % 2 == 0, 0.5), F.when(F.col("p_size") % 3 == 0, 2.0))
    return lines.select("l_orderkey", "l_linenumber", F.round(usd, 11).alias("usd"))


@query("""SELECT event_id, CASE WHEN v = floor(v) OR abs(v) >= 100 THEN format('{:,}', round_even(v, 0)::BIGINT) ELSE format('{:,}', floor(round(v, 2))::BIGINT) || '.' || lpad((round(v * 100)::BIGINT % 100)::VARCHAR, 2, '0') END AS units,
    floor(round_even(value, 0) / 60)::BIGINT || ':' || lpad((round_even(value, 0)::BIGINT % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT event_id, value, round(value * CASE WHEN event_id % 3 = 0 THEN 1000 ELSE 1 END, 2) AS v FROM events)""")
def f20_units_text(spark: SparkSession, d: str) -> DataFrame:
    v = F.round(F.col("value") * F.when(F.col("event_id") % 3 == 0, 1000).otherwise(1), 2)
    return load(spark, d, "events").select("event_id", L.units_text(v).alias("units"), L.clock(F.col("value")).alias("clock"))


@query(f"WITH {FRAMES} SELECT stream, i, round(10 * log10(avg(v * v) OVER (PARTITION BY stream ORDER BY i ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) + 1e-12), 6) AS level_db FROM frames")
def w1_frame_levels(spark: SparkSession, d: str) -> DataFrame:
    return S.frame_levels(frames(spark, d), "stream", "i", "v", 8).select("stream", "i", F.round("level_db", 6).alias("level_db"))


_RUNS = "SELECT *, i - row_number() OVER (PARTITION BY stream ORDER BY i) AS g FROM frames WHERE {}"


@query(f"WITH {FRAMES} SELECT stream, min(i) AS start, max(i) + 1 AS \"end\" FROM ({_RUNS.format('midi IS NOT NULL')}) GROUP BY stream, g")
def w2_voiced_runs(spark: SparkSession, d: str) -> DataFrame:
    return S.voiced_runs(frames(spark, d), "stream", "i", "midi")


@query(f"""WITH {FRAMES}, r AS (SELECT *, sum((midi IS NULL)::INT) OVER (PARTITION BY stream ORDER BY i) AS run FROM frames)
  SELECT stream, i, round(median(midi) OVER (PARTITION BY stream, run, midi IS NOT NULL ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS midi FROM r""")
def w3_median_smooth(spark: SparkSession, d: str) -> DataFrame:
    return S.smoothed(frames(spark, d), "stream", "i", "midi").select("stream", "i", F.round("midi", 6).alias("midi"))


_OCTAVE = """oct AS (SELECT stream, i, CASE WHEN abs(midi - ref) <= 7 THEN midi WHEN abs(CASE WHEN ref > midi THEN midi + 12 ELSE midi - 12 END - ref) <= 4 THEN CASE WHEN ref > midi THEN midi + 12 ELSE midi - 12 END END AS midi
  FROM (SELECT *, median(midi) OVER (PARTITION BY stream ORDER BY i ROWS BETWEEN 21 PRECEDING AND 21 FOLLOWING) AS ref FROM frames))"""


@query(f"WITH {FRAMES}, {_OCTAVE} SELECT stream, i, round(midi, 6) AS midi FROM oct")
def w4_octave_jumps(spark: SparkSession, d: str) -> DataFrame:
    return S.without_octave_jumps(frames(spark, d), "stream", "i", "midi").select("stream", "i", F.round("midi", 6).alias("midi"))


@query(f"""WITH {FRAMES}, {_OCTAVE}, r AS (SELECT *, sum((midi IS NULL)::INT) OVER (PARTITION BY stream ORDER BY i) AS run FROM oct)
  SELECT stream, i, round(median(midi) OVER (PARTITION BY stream, run, midi IS NOT NULL ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS midi FROM r""")
def w5_clean_contour(spark: SparkSession, d: str) -> DataFrame:
    return S.smoothed(S.without_octave_jumps(frames(spark, d), "stream", "i", "midi"), "stream", "i", "midi").select("stream", "i", F.round("midi", 6).alias("midi"))


@query(f"WITH {FRAMES} SELECT stream, min(i) AS start, max(i) + 1 AS \"end\", min(db) AS deepest FROM ({_RUNS.format('db < -30')}) GROUP BY stream, g")
def w20_dips(spark: SparkSession, d: str) -> DataFrame:
    return S.dips(frames(spark, d), "stream", "i", "db", -30.0)


@query(f"""WITH {FRAMES}, a AS (SELECT stream, i, min(db + 0.4 * i) OVER (PARTITION BY stream ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 0.4 * i AS a FROM frames)
  SELECT stream, i, round(min(a - 0.12 * i) OVER (PARTITION BY stream ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 0.12 * i, 6) AS db FROM a""")
def r3_rate_limited(spark: SparkSession, d: str) -> DataFrame:
    return S.rate_limited(frames(spark, d), "stream", "i", "db", 0.4, 0.12).select("stream", "i", F.round("db", 6).alias("db"))


@query(f"""WITH {FRAMES}, l AS (SELECT stream, v * v / 1e7 AS e, -0.691 + 10 * log10(v * v / 1e7) AS l FROM frames WHERE v <> 0), m AS (SELECT *, -0.691 + 10 * log10(avg(e) OVER (PARTITION BY stream)) AS m FROM l WHERE l >= -70)
  SELECT stream, round(-0.691 + 10 * log10(avg(e)), 6) AS lufs FROM m WHERE l > m - 10 GROUP BY stream""")
def a13_gated_loudness(spark: SparkSession, d: str) -> DataFrame:
    energy = frames(spark, d).filter("v <> 0").withColumn("e", F.col("v") * F.col("v") / 1e7)
    return S.gated_loudness(energy, "stream", "e").select("stream", F.round("lufs", 6).alias("lufs"))


@query(f"WITH {FRAMES}, t AS (SELECT *, max(db) OVER (PARTITION BY stream) AS top FROM frames) SELECT stream, round(10 * log10(avg(pow(10.0, db / 10))), 6) AS level_db FROM t WHERE db >= top - 10 GROUP BY stream")
def a14_word_level(spark: SparkSession, d: str) -> DataFrame:
    return S.word_level(frames(spark, d), "stream", "db").select("stream", F.round("level_db", 6).alias("level_db"))


@query(f"WITH {FRAMES} SELECT stream, (i // 4)::BIGINT AS bar, round(CASE WHEN sqrt(avg(v * v)) > 0 THEN 20 * log10(sqrt(avg(v * v))) ELSE -120 END, 6) AS level_db FROM frames GROUP BY 1, 2")
def a10_bar_levels(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).groupBy("stream", F.floor(F.col("i") / 4).alias("bar")).agg(F.round(S.rms_db(F.col("v")), 6).alias("level_db"))


@query(f"""WITH {FRAMES}, a AS (SELECT *, median(db - 20 * (i % 5 / 4.0)) OVER (PARTITION BY stream) AS an, count(*) OVER (PARTITION BY stream) AS n FROM frames),
  t AS (SELECT stream, i, db, CASE WHEN n >= 2 THEN an + 20 * (i % 5 / 4.0) END AS target FROM a)
  SELECT stream, i, round(target, 6) AS target, round(coalesce(CASE WHEN abs(target - db) > 3 THEN sign(target - db) * least(abs(target - db) - 3, CASE WHEN target > db THEN 4 ELSE 9 END) ELSE 0 END, 0)::DOUBLE, 6) AS gain FROM t""")
def a16_energy_gains(spark: SparkSession, d: str) -> DataFrame:
    rows = frames(spark, d).withColumn("energy", F.col("i") % 5 / 4.0)
    return S.energy_gains(rows, "stream", "db", "energy", 20.0, 3.0, 9.0, 4.0).select("stream", "i", F.round("target", 6).alias("target"), F.round("gain", 6).alias("gain"))


@query(f"""WITH {FRAMES}, q AS (SELECT *, min(db) OVER (PARTITION BY stream) AS m FROM frames), z AS (SELECT stream, i, i - row_number() OVER (PARTITION BY stream ORDER BY i) AS g FROM q WHERE db <= m + 6),
  r AS (SELECT stream, min(i) AS first, max(i) AS last FROM z GROUP BY stream, g)
  SELECT stream, arg_min(least(greatest(10, first), last), (greatest(0, first - 10, 10 - last), first)) AS point, arg_min(first, (greatest(0, first - 10, 10 - last), first)) AS first, arg_min(last, (greatest(0, first - 10, 10 - last), first)) AS last FROM r GROUP BY stream""")
def c6_quietest_point(spark: SparkSession, d: str) -> DataFrame:
    found = S.quietest_point(frames(spark, d).withColumn("b", F.lit(10)), "stream", "i", "db", "b", 6.0)
    return found.select("stream", *(F.col(c).cast("long").alias(c) for c in ("point", "first", "last")))


@query(f"""WITH {FRAMES}, n AS (SELECT stream, i, least(1.0, 100.0 / greatest(v, 1e-9)) AS need FROM frames),
  a AS (SELECT *, min(need) OVER (PARTITION BY stream ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS a FROM n),
  c AS (SELECT stream, i, least((sum(a) OVER (o ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) + first_value(a) OVER o * greatest(0, 4 - row_number() OVER o)) / 4, need) AS cap FROM a WINDOW o AS (PARTITION BY stream ORDER BY i)),
  l AS (SELECT stream, list(cap ORDER BY i) AS cs FROM c GROUP BY stream),
  g AS (SELECT stream, list_reduce(list_transform(cs, lambda x: [x]), lambda acc, x: list_append(acc, least(x[1], acc[-1] * 0.9 + 0.1)), [1.0::DOUBLE])[2:] AS gs FROM l)
  SELECT stream, generate_subscripts(gs, 1) - 1 AS i, round(unnest(gs), 6) AS gain FROM g""")
def r4_limiter(spark: SparkSession, d: str) -> DataFrame:
    need = frames(spark, d).withColumn("need", F.least(F.lit(1.0), 100.0 / F.greatest("v", F.lit(1e-9))))
    return G.limiter(need, "stream", "i", "need", 3, 0.1).select("stream", F.col("i").cast("long").alias("i"), F.round("gain", 6).alias("gain"))


_SPEECH = "SELECT conv_id AS talk_id, (turn * 9000 + 400)::BIGINT AS s, (turn * 9000 + 400 + length(text) * 12)::BIGINT AS e FROM conversations WHERE text IS NOT NULL"


@query(f"""WITH {TALK_WORDS}, g AS (SELECT talk_id, coalesce(lag(end_ms) OVER (PARTITION BY talk_id ORDER BY start_ms), 0) AS lo, start_ms AS hi FROM talk_words UNION ALL SELECT talk_id, max(end_ms), max(end_ms) + 5000 FROM talk_words GROUP BY talk_id)
  SELECT g.talk_id, lo, hi, sum(least(hi, e) - greatest(lo, s))::BIGINT AS speech FROM g JOIN ({_SPEECH}) s ON s.talk_id = g.talk_id AND s.s < g.hi AND g.lo < s.e WHERE hi - lo >= 500 GROUP BY ALL HAVING sum(least(hi, e) - greatest(lo, s)) >= 200""")
def j17_find_holes(spark: SparkSession, d: str) -> DataFrame:
    holes = I.pauses(talk_words(spark, d), ["talk_id"], "start_ms", "end_ms", 5000).filter("hi - lo >= 500")
    at = F.col("turn") * 9000 + 400
    speech = load(spark, d, "conversations").filter("text is not null").select(F.col("conv_id").alias("talk_id"), at.alias("s"), (at + F.length("text") * 12).alias("e"))
    both = I.overlap_join(holes, speech, ["talk_id"], ("lo", "hi"), ("s", "e"), 8000)
    heard = both.groupBy("talk_id", "lo", "hi").agg(F.sum(F.least("hi", "e") - F.greatest("lo", "s")).alias("speech"))
    return heard.filter("speech >= 200")


@query(f"""WITH holes AS ({ORACLE['j17_find_holes']}), {TALK_WORDS}, g AS (SELECT talk_id, min(start_ms) - 100 AS s, max(end_ms) + 150 AS e, min(start_ms) AS first, max(end_ms) AS last FROM talk_words GROUP BY talk_id, pos // 12),
  x AS (SELECT h.talk_id, lo, hi, any_value(speech) AS speech, min(CASE WHEN lo BETWEEN first AND last AND lo - s <= 4000 THEN s END) AS s, max(CASE WHEN hi BETWEEN first AND last AND e - hi <= 4000 THEN e END) AS e FROM holes h LEFT JOIN g ON g.talk_id = h.talk_id AND g.last >= lo AND g.first <= hi GROUP BY h.talk_id, lo, hi),
  w AS (SELECT talk_id, lo, hi, speech, least(lo, s) AS s, greatest(hi, e) AS e FROM x), r AS (SELECT *, max(e) OVER (PARTITION BY talk_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
  n AS (SELECT *, sum(CASE WHEN coalesce(s > reach, true) THEN 1 ELSE 0 END) OVER (PARTITION BY talk_id ORDER BY s, e) AS run FROM r)
  SELECT talk_id, arg_min(lo, (s, lo)) AS gap_start, max(hi) AS gap_end, sum(speech)::BIGINT AS speech, min(s) AS start, max(e) AS "end" FROM n GROUP BY talk_id, run""")
def j18_repair_windows(spark: SparkSession, d: str) -> DataFrame:
    """Holes with speech, widened to the runs of twelve words that touch them."""
    words = talk_words(spark, d).groupBy("talk_id", F.floor(F.col("pos") / 12)).agg(F.min("start_ms").alias("first"), F.max("end_ms").alias("last"))
    segments = words.select("talk_id", (F.col("first") - 100).alias("s"), (F.col("last") + 150).alias("e"), "first", "last")
    return I.repair_windows(j17_find_holes(spark, d), segments, ["talk_id"], 4000, 8000)


@query("""WITH w AS (SELECT user_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + (value * 2000)::BIGINT AS e FROM events), r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
  g AS (SELECT *, sum(CASE WHEN coalesce(s > reach, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS run FROM r) SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY user_id, run""")
def j18_merged_windows(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = load(spark, d, "events").select("user_id", at.alias("s"), (at + F.round(F.col("value") * 2000).cast("long")).alias("e"))
    return I.merged(rows, ["user_id"], "s", "e", F.count("*").alias("n"))


@query("""WITH w AS (SELECT user_id, epoch_us(ts) // 1000 AS s FROM events), g AS (SELECT *, sum(CASE WHEN coalesce(s - p >= 1800000, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s) AS k
  FROM (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY s) AS p FROM w)) SELECT user_id, min(s) AS first_ms, max(s) AS last_ms, count(*) AS n FROM g GROUP BY user_id, k""")
def r_event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of events with pauses under half an hour, by the pause rule of timed words."""
    rows = load(spark, d, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("s"))
    by = Window.partitionBy("user_id").orderBy("s")
    found = I.island_ids(rows.withColumn("p", F.lag("s").over(by)), ["user_id"], ["s"], F.col("s") - F.col("p") >= 1_800_000)
    return found.groupBy("user_id", "island").agg(F.min("s").alias("first_ms"), F.max("s").alias("last_ms"), F.count("*").alias("n")).drop("island")


@query(f"""WITH {TALK_WORDS}, c AS (SELECT conv_id AS talk_id, turn, (turn * 4000)::BIGINT AS lo, (turn * 4000 + 3000)::BIGINT AS hi FROM conversations)
  SELECT w.talk_id, c.turn, w.pos, w.w, w.start_ms - c.lo AS at_ms FROM talk_words w JOIN c ON c.talk_id = w.talk_id AND w.start_ms + 150 >= c.lo AND w.start_ms + 150 <= c.hi""")
def p12_clip_words(spark: SparkSession, d: str) -> DataFrame:
    """Words whose midpoint lies in a clip, ends included."""
    clips = load(spark, d, "conversations").select(F.col("conv_id").alias("talk_id"), "turn", (F.col("turn") * 4000).alias("lo"), (F.col("turn") * 4000 + 3000).alias("hi"))
    words = talk_words(spark, d).withColumn("mid", F.col("start_ms") + 150)
    inside = I.containing_join(words, clips, ["talk_id"], "mid", ("lo", "hi"), 4000, closed=True)
    return inside.select("talk_id", "turn", "pos", "w", (F.col("start_ms") - F.col("lo")).alias("at_ms"))


@query(f"""WITH {FRAMES} SELECT stream, round(CASE WHEN count(*) >= 3 AND stddev_pop(db) > 0 AND stddev_pop(v) > 0 THEN corr(db, v) END, 6) AS r FROM frames GROUP BY stream""")
def a12_energy_correlation(spark: SparkSession, d: str) -> DataFrame:
    enough = (F.count("*") >= 3) & (F.stddev_pop("db") > 0) & (F.stddev_pop("v") > 0)
    return frames(spark, d).groupBy("stream").agg(F.round(F.when(enough, F.corr("db", "v")), 6).alias("r"))
