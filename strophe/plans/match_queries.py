"""Queries that align, search and read pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.functions import text as T
from strophe.operators import align as A
from strophe.operators import match as M
from strophe.operators.sentences import timed_sentences
from strophe.sources import pages as P
from strophe.sources import quotes as Q
from strophe.tables import TALK_WORDS, load, talk_words

from .registry import query


def _official(spark: SparkSession, d: str) -> DataFrame:
    """The words as written: some differ from what was heard, some lines were never said."""
    words = talk_words(spark, d)
    word = F.when(F.col("pos") % 13 == 5, F.concat(F.col("w"), F.lit("s"))).otherwise(F.col("w"))
    return words.select("talk_id", "pos", word.alias("word"), F.floor(F.col("pos") / 12).cast("int").alias("line"), T.match_tokens(word).alias("tokens"))


def _heard(spark: SparkSession, d: str) -> DataFrame:
    words = talk_words(spark, d).filter("pos % 17 <> 3")
    return words.select("talk_id", "pos", "w", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), T.match_tokens(F.col("w")).alias("tokens"))


@query()
def j5_align_official(spark: SparkSession, d: str) -> DataFrame:
    return A.align(_official(spark, d), _heard(spark, d))


@query()
def a23_alignment_report(spark: SparkSession, d: str) -> DataFrame:
    return A.align(_official(spark, d), _heard(spark, d), figures=True)


@query(f"""WITH {TALK_WORDS}, l AS (SELECT talk_id AS talk, pos AS o, pos + CASE WHEN pos % 10 > 7 THEN 1 ELSE 0 END AS a FROM talk_words),
  r AS (SELECT *, sum(CASE WHEN coalesce(o - po <> 1 OR a - pa <> 1, true) THEN 1 ELSE 0 END) OVER (PARTITION BY talk ORDER BY o, a) AS run FROM (SELECT *, lag(o) OVER w AS po, lag(a) OVER w AS pa FROM l WINDOW w AS (PARTITION BY talk ORDER BY o, a)))
  SELECT talk, o, a FROM (SELECT *, count(*) OVER (PARTITION BY talk, run) AS n FROM r) WHERE n >= 3""")
def j3_solid_links(spark: SparkSession, d: str) -> DataFrame:
    links = talk_words(spark, d).select(F.col("talk_id").alias("talk"), F.col("pos").cast("long").alias("o"), (F.col("pos") + F.when(F.col("pos") % 10 > 7, 1).otherwise(0)).cast("long").alias("a"))
    return A.solid_runs(links)


def _matches(spark: SparkSession, d: str) -> DataFrame:
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.split(T.norm(F.col("text")), " ").alias("tokens"))
    quotes = load(spark, d, "benchmark").select(F.col("item_id").alias("quote"), F.split(T.norm(F.col("text")), " ").alias("q"))
    return M.found_quotes(texts, quotes)


@query()
def j7_find_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as quotes in whole documents; a test holds exact copies against a plain search."""
    return _matches(spark, d).withColumn("score", F.round("score", 6))


@query()
def j8_matched_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Openings of every turn of each talk whose id 20 divides, as quotes in whole sentences of that talk; every third one asks for a second time it is said."""
    words = timed_sentences(talk_words(spark, d).filter("talk_id % 20 = 0"), "talk_id", 1500).select("talk_id", "pos", "w", "sentence")
    tokens = words.select("talk_id", "pos", "sentence", F.posexplode(T.match_tokens(F.col("w"))).alias("k", "token"))
    place = Window.partitionBy("talk_id").orderBy("pos", "k")
    tokens = tokens.withColumn("i", F.row_number().over(place) - 1)
    sentences = tokens.groupBy(F.col("talk_id").alias("doc"), "sentence").agg(F.min("i").alias("word_start"), (F.max("i") + 1).alias("word_end"))
    edges = sentences.groupBy("doc").agg(F.collect_list("word_start").alias("starts"), F.collect_list("word_end").alias("ends"))
    texts = tokens.groupBy(F.col("talk_id").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]).alias("tokens")).join(edges, "doc")
    turns = load(spark, d, "conversations").filter("text IS NOT NULL AND conv_id % 20 = 0")
    asked = turns.select(F.col("conv_id").alias("doc"), F.struct("conv_id", "turn").alias("quote"), F.slice(F.split(T.norm(F.col("text")), " "), 1, 9).alias("q"), F.when(F.col("turn") % 3 == 2, 2).alias("occurrence"))
    out = M.matched_quotes(asked, M.found_quotes(texts, asked), sentences)
    return out.select("doc", F.col("quote.turn").alias("quote"), "first_sentence", "last_sentence", F.round("score", 6).alias("score"), "refusal", F.col("other.turn").alias("other"))


@query()
def x1_page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return P.talk_texts(load(spark, d, "pages")).select("page_id", F.posexplode("blocks").alias("i", "block"))


@query()
def x6_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return P.talk_texts(load(spark, d, "pages")).select("page_id", P.transcript(F.col("blocks")).alias("transcript"))


@query(r"""WITH p AS (SELECT doc_id, CASE WHEN regexp_matches(text, '\S[ \t]*\n[ \t]*\n\s*\S') THEN string_split_regex(text, '\n\s*\n') ELSE string_split_regex(text, '\r?\n') END AS ps FROM documents),
  q AS (SELECT doc_id, list_filter(list_transform(ps, lambda t: regexp_replace(trim(regexp_replace(regexp_replace(t, '^\s*(?:[-*•]|\d+[.)])\s+', ''), '\s+', ' ', 'g')), '^["''“”‘’ ]+|["''“”‘’ ]+$', '', 'g')), lambda t: t <> '') AS qs FROM p)
  SELECT doc_id, unnest(generate_series(1, len(qs)))::INT AS quote_no, unnest(qs) AS quote FROM q""")
def s15_parse_quotes(spark: SparkSession, d: str) -> DataFrame:
    return Q.parsed_quotes(load(spark, d, "documents").select("doc_id", "text"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, CASE WHEN starts_with(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), 's') THEN 'one' ELSE 'any' END AS handler FROM pages""")
def s6_find_handler(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(1, "s", "one"), (2, "", "any")], "n int, prefix string, handler string")
    found = P.matched_handlers(load(spark, d, "pages"), rules)
    return found.select("page_id", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"), "handler")
