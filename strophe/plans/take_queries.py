"""Queries over takes, clips and arcs (orders and parts stand in)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions.text import slug
from strophe.operators import takes as K
from strophe.operators import timeline as TL
from strophe.tables import FRAMES, frames, load, sections

from .registry import query
from .select_queries import _CLIPS, clips
from .timeline_queries import _PLACED


@query("""SELECT o_custkey, coalesce(max(req), arg_max(take, (score, -take))) AS take, CASE WHEN max(req) IS NOT NULL THEN 'requested' WHEN count(*) = 1 THEN 'only take' ELSE 'best score' END AS why
  FROM (SELECT o_custkey, o_orderkey AS take, floor(o_totalprice / 10000) AS score, CASE WHEN o_orderkey % 40 = 0 THEN o_orderkey END AS req FROM orders) GROUP BY o_custkey""")
def c1_choose_take(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("take"), F.floor(F.col("o_totalprice") / 10000).alias("score"), F.when(F.col("o_orderkey") % 40 == 0, F.col("o_orderkey")).alias("req"))
    return K.chosen_takes(rows, "o_custkey", "take", "score", "req")


@query("SELECT o_custkey, max(o_orderkey) + 1 AS next FROM orders GROUP BY o_custkey")
def c11_next_take(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return K.next_numbers(rows.filter("o_orderstatus <> 'F'"), rows.filter("o_orderstatus = 'F'"), "o_custkey", "o_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'drop' ELSE 'drop x 1' END AS role, CASE WHEN p_size % 3 > 0 THEN p_size END AS bars,
  greatest(1, least(greatest(1, ceil(8 / (p_size * 2.0) - 1e-9)), floor(30 / (p_size * 2.0))))::INT AS loops, greatest(1, ceil(greatest(p_retailprice / 100 / 0.5, p_size / 0.5 + 2) / 4 - 1e-9))::INT AS bed FROM part""")
def f25_arc_entries(spark: SparkSession, d: str) -> DataFrame:
    entry = K.arc_entry(F.when(F.col("p_size") % 3 > 0, F.concat(F.lit(" drop "), F.col("p_size"))).otherwise(F.lit("drop x 1")))
    return load(spark, d, "part").select("p_partkey", entry["role"].alias("role"), entry["bars"].alias("bars"), K.quote_loops(F.col("p_size"), 120.0).alias("loops"), K.bed_bars(F.col("p_retailprice") / 100, F.col("p_size"), 120.0, 2.0).alias("bed"))


@query(f"WITH {_PLACED} SELECT song, n, round_even(start_bar * 88200.0, 0)::BIGINT AS first_sample, round_even((start_bar + bars) * 88200.0, 0)::BIGINT AS end_sample FROM placed")
def l14_section_spans(spark: SparkSession, d: str) -> DataFrame:
    return K.sample_spans(TL.placed(sections(spark, d)), 120.0, 44_100).select("song", "n", "first_sample", "end_sample")


@query(f"WITH {_CLIPS} SELECT sel // 4 AS song, start, stop, arg_min(clip, sel * 100 + pos) AS id, string_agg(DISTINCT (sel % 4)::VARCHAR, ',' ORDER BY (sel % 4)::VARCHAR) AS lengths FROM clips GROUP BY 1, 2, 3")
def j15_earlier_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Four neighbouring selections as the lengths of one song."""
    rows = clips(spark, d).select(F.floor(F.col("sel") / 4).alias("song"), (F.col("sel") % 4).cast("string").alias("length"), "clip", "start", F.col("end").alias("stop"), (F.col("sel") * 100 + F.col("pos")).alias("o"))
    first = rows.groupBy("song", "start", "stop").agg(F.min_by("clip", "o").alias("id"))
    return first.join(K.earlier_quotes(rows, "song", "length", "clip", "start", "stop").drop("id"), ["song", "start", "stop"])


@query(f"""WITH {FRAMES}, s AS (SELECT stream, unnest(range(0, 12)) AS n FROM (SELECT DISTINCT stream FROM frames))
  SELECT s.stream, s.n, round(coalesce(CASE WHEN sqrt(avg(v * v)) > 0 THEN 20 * log10(sqrt(avg(v * v))) ELSE -120 END, -120), 6) AS level_db FROM s LEFT JOIN frames f ON f.stream = s.stream AND f.i >= s.n * 7 AND f.i < s.n * 7 + 9 GROUP BY s.stream, s.n""")
def a9_section_levels(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    spans = f.select("stream").distinct().select("stream", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("n")).select("stream", "n", (F.col("n") * 7).alias("a"), (F.col("n") * 7 + 9).alias("b"))
    return K.section_levels(f, spans, "stream", "i", "v", 8).withColumn("level_db", F.round("level_db", 6))


@query("""SELECT event_id, CASE WHEN event_id % 10 > 0 AND -round(value, 1) - 1 > -70 THEN round(-round(value, 1) - 1, 1) END AS integrated, CASE WHEN event_id % 10 > 0 AND -round(value, 1) - 1 > -70 THEN (event_id % 9 + 0.5)::DOUBLE END AS range, CASE WHEN event_id % 10 > 0 AND event_id % 4 > 0 THEN (event_id % 5)::DOUBLE END AS peak FROM events""")
def s12_loudness_summaries(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    text = F.format_string("I: -1.0 LUFS\nSummary:\n I: %.1f LUFS\n LRA: %.1f LU\n Peak: %s dBFS\n", -F.round("value", 1) - 1, e % 9 + F.lit(0.5), F.when(e % 4 > 0, F.format_string("%.1f", (e % 5).cast("double"))).otherwise("-inf"))
    log = F.when(e % 10 > 0, text).otherwise("I: -1.0 LUFS")
    return load(spark, d, "events").select("event_id", K.loudness_summary(log).alias("s")).select("event_id", "s.*")


@query("""SELECT vec_id, CASE WHEN a = b AND ma = mb THEN 'same' WHEN (a + CASE WHEN ma = 'minor' THEN 3 ELSE 0 END) % 12 = (b + CASE WHEN mb = 'minor' THEN 3 ELSE 0 END) % 12 THEN 'relative' ELSE 'other' END AS relation
  FROM (SELECT vec_id, vec_id % 12 AS a, vec_id * 7 % 12 AS b, CASE WHEN vec_id % 2 = 0 THEN 'minor' ELSE 'major' END AS ma, CASE WHEN vec_id % 3 = 0 THEN 'minor' ELSE 'major' END AS mb FROM embeddings)""")
def f17_key_relation(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    mode = lambda k: F.when(v % k == 0, "minor").otherwise("major")
    return load(spark, d, "embeddings").select("vec_id", K.key_relation(v % 12, mode(2), v * 7 % 12, mode(3)).alias("relation"))


@query("""SELECT event_id, CASE WHEN p - w <= 44100 THEN p ELSE least(p, round_even(ceil((w + 22050.0) / 22050 - 1e-9) * 22050, 0)::BIGINT) END AS back, array_to_string(list_transform(range(0, n + 1), lambda i: round_even(i * p / n::DOUBLE, 0)::BIGINT), ' ') AS edges
  FROM (SELECT *, greatest(1, round_even(p / 100000.0, 0)::INT) AS n FROM (SELECT event_id, (value * 1000)::BIGINT AS w, (value * 1000)::BIGINT + event_id * 997 % 200000 AS p FROM events))""")
def f27_return_points(spark: SparkSession, d: str) -> DataFrame:
    w = F.round(F.col("value") * 1000).cast("long")
    rows = load(spark, d, "events").select("event_id", w.alias("w"), (w + F.col("event_id") * 997 % 200_000).alias("p"))
    return rows.select("event_id", K.return_point(F.col("w"), F.col("p"), 120.0, 44_100).alias("back"), F.array_join(K.window_bounds(F.col("p"), 100_000.0), " ").alias("edges"))


@query(r"""SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') || '-' || regexp_replace(lower(event_type), '[^a-z0-9]+', '-', 'g') AS run_id FROM events""")
def f23_run_ids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit("-"), slug(F.col("event_type"))).alias("run_id"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 2 = 0 ELSE o_orderstatus = 'F' END AS fits FROM orders")
def j21_take_fits(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    stored = F.when(c % 3 == 0, F.array(c % 2))
    return load(spark, d, "orders").select("o_orderkey", K.take_fits(stored, F.array(F.lit(0).cast("long")), F.col("o_orderstatus"), F.lit("F")).alias("fits"))
