"""Where the tables are, and the sequence tables that stand in for recorded talks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def talk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(talk_id, pos, w, start_ms, end_ms, conf): the words of each conversation with made-up timings.

    A word lasts 0.3 s; 0.05 s follow it, or 0.6 s after a sentence mark.  Whole milliseconds keep sums exact.
    """
    turns = load(spark, sf_dir, "conversations").filter("text is not null")
    words = turns.select("conv_id", "turn", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("i", "w")).filter("w <> ''")
    order = Window.partitionBy("conv_id").orderBy("turn", "i")
    step = F.when(F.col("w").rlike(r"[.?!]$"), 900).otherwise(350)
    before = F.coalesce(F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    timed = words.withColumn("start_ms", before + 500).withColumn("pos", F.row_number().over(order) - 1)
    return timed.select(F.col("conv_id").alias("talk_id"), "pos", "w", "start_ms", (F.col("start_ms") + 300).alias("end_ms"), F.lit(0.9).alias("conf"))


#: The same rows in DuckDB SQL.
TALK_WORDS = r"""talk_words AS (
  SELECT conv_id AS talk_id, row_number() OVER o - 1 AS pos, w, start_ms, start_ms + 300 AS end_ms, 0.9::DOUBLE AS conf FROM (
    SELECT conv_id, turn, i, w, (500 + coalesce(sum(CASE WHEN regexp_matches(w, '[.?!]$') THEN 900 ELSE 350 END)
      OVER (PARTITION BY conv_id ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_ms
    FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS ws FROM conversations WHERE text IS NOT NULL)) WHERE w <> '')
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn, i))"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(song, n, role, bars, energy, shape, silent, rest, clip): one section per order line.

    Line numbers repeat within an order, so n counts the lines in an order that is the same in both engines.
    """
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    q = F.col("l_quantity").cast("int")
    role = F.element_at(F.array(*map(F.lit, ("intro", "build", "drop", "breakdown", "speech_bed", "outro"))), (F.pmod("l_partkey", F.lit(6)) + 1).cast("int"))
    shape = F.element_at(F.array(*map(F.lit, ("flat", "rise", "fall"))), (F.pmod("l_suppkey", F.lit(3)) + 1).cast("int"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("n"), "l_partkey", "l_suppkey", q.alias("q"), role.alias("role"), shape.alias("shape"))
    return lines.select(
        F.col("l_orderkey").alias("song"), "n", "role", (F.pmod("q", F.lit(16)) + 1).cast("int").alias("bars"), (F.col("q") / 50.0).alias("energy"), "shape",
        ((F.col("role") != "speech_bed") & (F.pmod("l_suppkey", F.lit(5)) == 0)).alias("silent"), ((F.col("role") == "speech_bed") & (F.pmod("l_suppkey", F.lit(2)) == 0)).alias("rest"),
        F.when(F.col("role") == "speech_bed", F.concat(F.lit("c"), F.col("l_partkey"))).alias("clip"),
    )


SECTIONS = """sections AS (
  SELECT l_orderkey AS song, n::INT AS n, role, (q % 16 + 1)::INT AS bars, q / 50.0::DOUBLE AS energy, ['flat', 'rise', 'fall'][l_suppkey % 3 + 1] AS shape,
    role <> 'speech_bed' AND l_suppkey % 5 = 0 AS silent, role = 'speech_bed' AND l_suppkey % 2 = 0 AS rest, CASE WHEN role = 'speech_bed' THEN 'c' || l_partkey END AS clip
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n, l_quantity::INT AS q, ['intro', 'build', 'drop', 'breakdown', 'speech_bed', 'outro'][l_partkey % 6 + 1] AS role FROM lineitem))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, i, v, midi, db): events of a user as frames; some are unvoiced (null midi)."""
    events = load(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    midi = F.when(F.pmod("event_id", F.lit(7)) != 0, F.round(48 + F.pmod(F.col("value"), F.lit(30.0)), 3))
    return events.select(F.col("user_id").alias("stream"), i.alias("i"), F.col("value").alias("v"), midi.alias("midi"), F.round(-60 + F.pmod(F.col("value"), F.lit(60.0)), 3).alias("db"))


FRAMES = """frames AS (
  SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS v,
    CASE WHEN event_id % 7 <> 0 THEN round(48 + fmod(value, 30.0), 3) END AS midi, round(-60 + fmod(value, 60.0), 3) AS db FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, i, v): orders as four streams of samples, loud and quiet by turns; the order key gives the place, without a sort."""
    key = F.col("o_orderkey")
    level = F.when(F.pmod(F.floor(key / 2400), F.lit(3)) == 0, 0.9).otherwise(0.2)
    v = (F.pmod(F.col("o_totalprice"), F.lit(2000.0)) - 1000) / 1000 * level
    return load(spark, sf_dir, "orders").select(F.pmod(key, F.lit(4)).alias("stream"), F.floor(key / 4).alias("i"), F.round(v, 6).alias("v"))


SAMPLES = """samples AS (
  SELECT o_orderkey % 4 AS stream, o_orderkey // 4 AS i, round((fmod(o_totalprice, 2000.0) - 1000) / 1000 * CASE WHEN o_orderkey // 2400 % 3 = 0 THEN 0.9 ELSE 0.2 END, 6) AS v FROM orders)"""
