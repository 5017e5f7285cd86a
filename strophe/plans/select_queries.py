"""Queries over selections (orders as selections, their lines as candidate clips)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.functions.text import ends_sentence
from strophe.operators import select as C
from strophe.operators.sentences import timed_sentences
from strophe.tables import SECTIONS, load, sections, talk_words

from .registry import query


def clips(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    lines = load(spark, d, "lineitem").select("l_orderkey", n.alias("pos"), "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    start = (F.col("l_partkey") % 30).cast("int")
    return lines.select(
        F.col("l_orderkey").alias("sel"), "pos", F.concat(F.lit("c"), F.col("l_partkey") % 9).alias("clip"), start.alias("start"), (start + (F.col("l_quantity") % 7).cast("int") - 1).alias("end"),
        (F.col("l_discount") * 11).alias("score"), F.col("l_quantity").alias("seconds"), (F.col("l_suppkey") % 6 == 0).alias("required"),
    )


_CLIPS = """clips AS (SELECT l_orderkey AS sel, pos::INT AS pos, 'c' || (l_partkey % 9) AS clip, (l_partkey % 30)::INT AS start, (l_partkey % 30 + l_quantity::INT % 7 - 1)::INT AS stop, l_discount * 11 AS score, l_quantity AS seconds, l_suppkey % 6 = 0 AS required
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos FROM lineitem))"""


@query(f"""WITH {_CLIPS}, j AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY sel, clip ORDER BY pos) > 1 THEN 'duplicate' WHEN stop < start THEN 'range' WHEN NOT required AND seconds NOT BETWEEN 3 AND 40 THEN 'duration' END AS kind FROM clips),
  u AS (SELECT *, max(stop) OVER (PARTITION BY sel ORDER BY start, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM j WHERE kind IS NULL)
  SELECT sel, clip, kind FROM j WHERE kind IS NOT NULL UNION ALL SELECT sel, clip, 'overlap' FROM u WHERE start <= reach UNION ALL SELECT sel, clip, 'score' FROM u WHERE score < 0 OR score > 1
  UNION ALL SELECT sel, NULL, 'budget' FROM u GROUP BY sel HAVING sum(seconds) > 90 UNION ALL SELECT sel, NULL, 'count' FROM j GROUP BY sel HAVING count(*) NOT BETWEEN 2 AND 5""")
def p1_selection_problems(spark: SparkSession, d: str) -> DataFrame:
    return C.problems(clips(spark, d), 3, 40, 90, 2, 5)


@query(f"""WITH {_CLIPS}, l AS (SELECT sel, list({{'free': NOT required, 'less': -score, 'pos': pos, 'clip': clip, 'start': start, 'stop': stop, 'seconds': seconds}} ORDER BY NOT required, -score, pos) AS xs FROM clips WHERE stop >= start GROUP BY sel),
  k AS (SELECT sel, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x[1].start <= y.stop AND y.start <= x[1].stop)) > 0 THEN acc ELSE list_concat(acc, x) END) AS ks FROM l),
  r AS (SELECT sel, unnest(ks) AS k, generate_subscripts(ks, 1)::INT AS rank FROM k), s AS (SELECT *, sum(k.seconds) OVER (PARTITION BY sel ORDER BY rank) AS t FROM r)
  SELECT sel, k.clip AS clip, rank FROM s WHERE rank <= 4 AND t <= 90 OR NOT k.free""")
def g1_schedule_clips(spark: SparkSession, d: str) -> DataFrame:
    return C.scheduled(clips(spark, d), 4, 90.0)


_OPTS = "list_sort(list_distinct(list_filter(list_transform([0.5, 1.0, 1.5, 2.0], lambda f: greatest(1, round_even(bars * f::DOUBLE, 0)::INT)), lambda b: b <= 32)))"


@query(f"WITH {SECTIONS}, o AS (SELECT song, n, bars, energy, unnest({_OPTS}) AS b FROM sections) SELECT song, n, b::INT AS option, round(abs(log2(b / bars)) * pow(2.0, 2 * CASE WHEN log2(b / bars) < 0 THEN energy ELSE 1 - energy END), 6) AS cost FROM o")
def d9_bar_options(spark: SparkSession, d: str) -> DataFrame:
    rows = sections(spark, d).withColumn("option", F.explode(C.bar_options(F.col("bars"))))
    return rows.select("song", "n", "option", F.round(C.fit_cost(F.col("option"), F.col("bars"), F.col("energy")), 6).alias("cost"))


@query()
def d8_fit_parts(spark: SparkSession, d: str) -> DataFrame:
    return C.fitted(sections(spark, d).filter("role <> 'speech_bed'"), "song", 24, 32)


@query()
def d1_plan_parts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as passages, in parts of at most 5 s."""
    words = timed_sentences(talk_words(spark, d), "talk_id", 1500)
    by = Window.partitionBy("talk_id").orderBy("pos")
    cost = C.boundary_cost(F.lag("w").over(by), (F.col("start_ms") - F.lag("end_ms").over(by)) / 1000.0, F.coalesce(ends_sentence(F.lag("w").over(by), F.col("w")), F.lit(False)))
    rows = words.select(F.concat_ws(":", "talk_id", "sentence").alias("passage"), "pos", (F.col("start_ms") / 1000.0).alias("s"), (F.col("end_ms") / 1000.0).alias("e"), F.coalesce(cost, F.lit(0.0)).alias("cost"))
    return C.planned_parts(rows, "passage", 5.0)


@query(f"""WITH {_CLIPS}, d1 AS (SELECT * FROM clips QUALIFY row_number() OVER (PARTITION BY sel, clip ORDER BY pos) = 1), er AS (SELECT sel, start, stop, 'c' || pos AS id FROM d1 WHERE pos % 2 = 0 QUALIFY row_number() OVER (PARTITION BY sel, start, stop ORDER BY pos) = 1),
  tk AS (SELECT DISTINCT sel, id AS clip FROM er), m AS (SELECT d1.sel, d1.pos, d1.clip, coalesce(er.id, CASE WHEN tk.clip IS NULL THEN d1.clip END) AS nid FROM d1 LEFT JOIN er ON er.sel = d1.sel AND er.start = d1.start AND er.stop = d1.stop LEFT JOIN tk ON tk.sel = d1.sel AND tk.clip = d1.clip),
  us AS (SELECT sel, nid FROM m WHERE nid IS NOT NULL UNION SELECT sel, clip FROM tk), ne AS (SELECT sel, pos, clip, row_number() OVER (PARTITION BY sel ORDER BY pos) AS r FROM m WHERE nid IS NULL),
  nu AS (SELECT sel, 'c' || k AS nid, k FROM (SELECT sel, unnest(range(1, 40)) AS k FROM (SELECT DISTINCT sel FROM ne))), fr AS (SELECT sel, nid, row_number() OVER (PARTITION BY sel ORDER BY k) AS r FROM nu WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.sel = nu.sel AND us.nid = nu.nid))
  SELECT sel, pos, clip, nid AS new_id FROM m WHERE nid IS NOT NULL UNION ALL SELECT ne.sel, pos, clip, fr.nid FROM ne JOIN fr USING (sel, r)""")
def j13_align_ids(spark: SparkSession, d: str) -> DataFrame:
    once = clips(spark, d).withColumn("__r", F.row_number().over(Window.partitionBy("sel", "clip").orderBy("pos"))).filter("__r = 1").drop("__r")
    first = Window.partitionBy("sel", "start", "end").orderBy("pos")
    earlier = once.filter("pos % 2 = 0").withColumn("__r", F.row_number().over(first)).filter("__r = 1").select("sel", "start", "end", F.concat(F.lit("c"), F.col("pos")).alias("id"))
    return C.aligned_ids(once, earlier)
