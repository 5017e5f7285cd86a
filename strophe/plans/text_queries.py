"""Queries over words, sentences, quotes and web texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.functions import text as T
from strophe.operators import sentences as S
from strophe.tables import TALK_WORDS, load, talk_words

from .registry import query

_MARKS = "translate(replace(w, '…', '...'), '‘’‚‛′“”„‟″‐‑‒–—―−', '''''''''''\"\"\"\"\"-------')"
_TOKENS = rf"""list_filter(list_transform(string_split_regex(regexp_replace({_MARKS}, '(\p{{L}}[.,;:!?"'')\]])\d{{1,3}}$', '\1'), '[-/]+'),
  lambda p: regexp_replace(replace(lower(strip_accents(replace(p, '''', ''))), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g')), lambda t: t <> '')"""
_CLOSE, _OPEN = r"""["''”’)\]}»]+$""", r"""^["''“‘(\[{«]+"""
_ABBR = ", ".join(f"'{a}'" for a in T.ABBREVIATIONS)


def _ends(w: str, nxt: str) -> str:
    """DuckDB: does a sentence end after ``w``?"""
    core = f"regexp_replace({w}, '{_CLOSE}', '')"
    first = rf"regexp_extract(regexp_replace({nxt}, '{_OPEN}', ''), '\p{{L}}', 0)"
    stem = f"regexp_replace(substr({core}, 1, length({core}) - 1), '{_OPEN}', '')"
    return rf"""CASE WHEN regexp_matches({core}, '[?!]$') THEN true WHEN regexp_matches({core}, '(\.\.\.|…)$') THEN {nxt} IS NULL OR regexp_matches({first}, '\p{{Lu}}')
      WHEN NOT regexp_matches({core}, '\.$') THEN false WHEN regexp_matches({stem}, '^\p{{L}}$') THEN false WHEN lower({stem}) IN ({_ABBR}) THEN false
      ELSE {nxt} IS NULL OR NOT regexp_matches({first}, '\p{{Ll}}') END"""


@query(f"WITH {TALK_WORDS} SELECT talk_id, pos, array_to_string({_TOKENS}, '|') AS tokens FROM talk_words")
def t1_match_tokens(spark: SparkSession, d: str) -> DataFrame:
    return talk_words(spark, d).select("talk_id", "pos", F.array_join(T.match_tokens(F.col("w")), "|").alias("tokens"))


@query(f"WITH {TALK_WORDS}, t AS (SELECT talk_id, pos, {_TOKENS} AS ts FROM talk_words), u AS (SELECT talk_id, pos, unnest(ts) AS token, generate_subscripts(ts, 1) AS k FROM t) SELECT talk_id, row_number() OVER (PARTITION BY talk_id ORDER BY pos, k) - 1 AS i, pos AS word, token FROM u")
def t2_tokenize(spark: SparkSession, d: str) -> DataFrame:
    tokens = talk_words(spark, d).select("talk_id", "pos", F.posexplode(T.match_tokens(F.col("w"))).alias("k", "token"))
    i = F.row_number().over(Window.partitionBy("talk_id").orderBy("pos", "k")) - 1
    return tokens.select("talk_id", i.alias("i"), F.col("pos").alias("word"), "token")


@query(rf"WITH {TALK_WORDS}, n AS (SELECT *, lead(w) OVER (PARTITION BY talk_id ORDER BY pos) AS nxt FROM talk_words) SELECT talk_id, pos, regexp_matches(w, '[\p{{L}}\p{{N}}]') AS has_word, regexp_extract(regexp_replace(w, '{_OPEN}', ''), '\p{{L}}', 0) AS first_letter, {_ends('w', 'nxt')} AS ends FROM n")
def t4_sentence_ends(spark: SparkSession, d: str) -> DataFrame:
    words = talk_words(spark, d).withColumn("next", F.lead("w").over(Window.partitionBy("talk_id").orderBy("pos")))
    return words.select("talk_id", "pos", T.has_word_chars(F.col("w")).alias("has_word"), T.first_letter(F.col("w")).alias("first_letter"), T.ends_sentence(F.col("w"), F.col("next")).alias("ends"))


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(rf"SELECT doc_id, len(ls) >= 5 AND len(list_filter(ls, lambda x: NOT regexp_matches(regexp_replace(x, '{_CLOSE}', ''), '[.!?:;]$'))) >= 0.6 * len(ls) AS wrapped FROM (SELECT doc_id, {_LINES} AS ls FROM documents)")
def t6_hard_wrapped(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.looks_hard_wrapped(F.col("text")).alias("wrapped"))


_OFFICIAL = rf"""ln AS (SELECT doc_id, len(cl) >= 5 AND len(list_filter(cl, lambda x: NOT regexp_matches(regexp_replace(x, '{_CLOSE}', ''), '[.!?:;]$'))) >= 0.6 * len(cl) AS wrapped,
    unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, {_LINES} AS cl FROM documents)),
  ts AS (SELECT *, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS ts FROM ln),
  bl AS (SELECT *, sum((len(ts) = 0)::INT) OVER o AS blanks, CASE WHEN wrapped THEN lead(ts) OVER o END AS after FROM ts WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
  tk AS (SELECT doc_id, wrapped, line, blanks, unnest(ts) AS tok, generate_subscripts(ts, 1) AS i, ts, after FROM bl),
  nx AS (SELECT *, coalesce(ts[i + 1], after[1]) AS nxt, regexp_matches(tok, '[\p{{L}}\p{{N}}]') AS is_word FROM tk),
  en AS (SELECT *, is_word AND {_ends('tok', 'nxt')} AS ends FROM nx),
  ru AS (SELECT *, sum(is_word::INT) OVER o AS r, last_value(CASE WHEN is_word THEN ends END IGNORE NULLS) OVER o AS closed FROM en WINDOW o AS (PARTITION BY doc_id, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  ow AS (SELECT *, CASE WHEN is_word OR NOT coalesce(closed, true) THEN r ELSE r + 1 END AS owner FROM ru),
  wd AS (SELECT doc_id, line, owner, string_agg(tok, ' ' ORDER BY i) AS word, bool_or(is_word) AS is_real, bool_or(ends) AS ends, any_value(wrapped) AS wrapped, any_value(blanks) AS blanks FROM ow GROUP BY ALL),
  pr AS (SELECT *, lag(ends) OVER o AS pe, lag(line) OVER o AS pl, lag(blanks) OVER o AS pb FROM wd WHERE is_real WINDOW o AS (PARTITION BY doc_id ORDER BY line, owner)),
  official AS (SELECT doc_id, word, line, row_number() OVER o - 1 AS pos, (sum(CASE WHEN coalesce(pe OR CASE WHEN wrapped THEN blanks > pb ELSE line <> pl END, true) THEN 1 ELSE 0 END) OVER o - 1)::BIGINT AS sentence FROM pr WINDOW o AS (PARTITION BY doc_id ORDER BY line, owner))"""


@query(f"WITH {_OFFICIAL} SELECT doc_id, pos, word, line, sentence FROM official")
def t7_parse_official(spark: SparkSession, d: str) -> DataFrame:
    words = S.official_words(load(spark, d, "documents"))
    return words.select("doc_id", F.col("pos").cast("long").alias("pos"), "word", F.col("line").cast("long").alias("line"), F.col("sentence").cast("long").alias("sentence"))


_TIMED = f"""{TALK_WORDS}, pv AS (SELECT *, lag(w) OVER o AS pw, lag(end_ms) OVER o AS pend FROM talk_words WINDOW o AS (PARTITION BY talk_id ORDER BY pos)),
  st AS (SELECT *, (sum(CASE WHEN coalesce({_ends('pw', 'w')} OR start_ms - pend >= 1500, true) OR pw IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY talk_id ORDER BY pos) - 1)::BIGINT AS sentence FROM pv)"""


@query(f"WITH {_TIMED} SELECT talk_id, pos, sentence FROM st")
def t8_split_timed(spark: SparkSession, d: str) -> DataFrame:
    return S.timed_sentences(talk_words(spark, d), "talk_id", 1500).select("talk_id", "pos", F.col("sentence").cast("long").alias("sentence"))


@query(f"WITH {_TIMED} SELECT talk_id, sentence + 1 AS id, string_agg(w, ' ' ORDER BY pos) AS text, arg_min(start_ms, pos) AS start_ms, max(end_ms) AS end_ms, min(pos) AS word_start, max(pos) + 1 AS word_end, round(avg(conf), 3) AS avg_conf FROM st GROUP BY talk_id, sentence")
def t11_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: words to timed sentences."""
    rows = S.sentence_rows(S.timed_sentences(talk_words(spark, d), "talk_id", 1500), "talk_id")
    return rows.select("talk_id", F.col("id").cast("long").alias("id"), "text", "start_ms", "end_ms", F.col("word_start").cast("long").alias("word_start"), F.col("word_end").cast("long").alias("word_end"), "avg_conf")


_SPLIT = f"""WITH RECURSIVE {_TIMED}, s0 AS (SELECT talk_id, sentence, list({{'pos': pos, 's': start_ms, 'e': end_ms}} ORDER BY pos) AS ws FROM st GROUP BY ALL),
  cut AS (SELECT talk_id, ws FROM s0 UNION ALL
    SELECT talk_id, unnest([ws[:k], ws[k + 1:]]) FROM (SELECT talk_id, ws, list_max(list_transform(range(1, len(ws)), lambda i: {{'g': ws[i + 1].s - ws[i].e, 'i': i}})).i AS k FROM cut WHERE len(ws) > 1 AND ws[len(ws)].e - ws[1].s > 12000))
  SELECT talk_id, ws[1].pos AS word_start, ws[len(ws)].pos + 1 AS word_end FROM cut WHERE NOT (len(ws) > 1 AND ws[len(ws)].e - ws[1].s > 12000)"""


@query(_SPLIT)
def t9_split_long(spark: SparkSession, d: str) -> DataFrame:
    """At 12 s instead of 30 s, so that there is something to split."""
    parts = S.split_long(S.timed_sentences(talk_words(spark, d), "talk_id", 1500), "talk_id", 12_000)
    return parts.groupBy("talk_id", "sentence").agg(F.min("pos").cast("long").alias("word_start"), (F.max("pos") + 1).cast("long").alias("word_end")).drop("sentence")


_DASHED = "SELECT talk_id, pos, CASE WHEN pos % 11 = 3 OR pos = 0 AND talk_id % 2 = 0 THEN '-' ELSE w END AS w, start_ms, end_ms FROM talk_words"


@query(rf"""WITH {TALK_WORDS}, dw AS ({_DASHED}), r AS (SELECT *, regexp_matches(w, '[\p{{L}}\p{{N}}]') AS re, greatest(sum(regexp_matches(w, '[\p{{L}}\p{{N}}]')::INT) OVER (PARTITION BY talk_id ORDER BY pos), 1) AS run FROM dw)
  SELECT talk_id, (run - 1)::BIGINT AS pos, string_agg(w, '' ORDER BY pos) AS w, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r GROUP BY talk_id, run HAVING bool_or(re)""")
def t10_joined_marks(spark: SparkSession, d: str) -> DataFrame:
    words = talk_words(spark, d)
    dash = (F.col("pos") % 11 == 3) | (F.col("pos") == 0) & (F.col("talk_id") % 2 == 0)
    return S.joined_marks(words.withColumn("w", F.when(dash, "-").otherwise(F.col("w"))), "talk_id").withColumn("pos", F.col("pos").cast("long"))


@query("""WITH e AS (SELECT user_id, event_id, value / 10 AS s, value / 10 + event_id % 5 - 1 AS e FROM events),
  r AS (SELECT *, coalesce(max(greatest(round(s, 3), round(e, 3))) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS reach FROM e)
  SELECT user_id, event_id, greatest(round(s, 3), reach) AS s, greatest(round(e, 3), greatest(round(s, 3), reach)) AS e FROM r""")
def t12_clean_times(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").select("user_id", "event_id", (F.col("value") / 10).alias("s"), (F.col("value") / 10 + F.col("event_id") % 5 - 1).alias("e"))
    return S.clean_times(events, "user_id", "s", "e", "event_id")


_WORD_LIST = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
_NORM = rf"""array_to_string(flatten(list_transform({_WORD_LIST}, lambda w: {_TOKENS})), ' ')"""
_LCS = """CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE list_reduce({a}, lambda up, x: list_reduce(range(1, len({b}) + 1), lambda acc, j: list_append(acc,
   greatest(up[j], coalesce(acc[-1], 0), CASE WHEN {b}[j] = x THEN coalesce(CASE WHEN j > 1 THEN up[j - 1] END, 0) + 1 ELSE 0 END)), []::BIGINT[]), list_transform({b}, lambda z: 0::BIGINT))[-1] END"""


@query(rf"""WITH b AS (SELECT item_id, string_split(array_to_string(flatten(list_transform(list_filter(string_split_regex(text, '\s+'), lambda v: v <> ''), lambda w: {_TOKENS})), ' '), ' ') AS ws FROM benchmark),
  p AS (SELECT x.item_id, y.item_id AS other, x.ws AS a, y.ws AS b FROM b x JOIN b y ON y.item_id > x.item_id AND y.item_id <= x.item_id + 6)
  SELECT item_id, other, round(2.0 * ({_LCS.format(a='a', b='b')}) / (len(a) + len(b)), 6) AS similarity FROM p""")
def t13_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each item with the six after it, as word sequences."""
    words = load(spark, d, "benchmark").select("item_id", F.split(T.norm(F.col("text")), " ").alias("ws"))
    near = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.col("item_id") + k)).alias("other"), "item_id", F.col("ws").alias("a"))
    pairs = near.join(words.select(F.col("item_id").alias("other"), F.col("ws").alias("b")), "other")
    return pairs.select("item_id", "other", F.round(T.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(r"""SELECT doc_id, i, regexp_replace(trim(regexp_replace(regexp_replace(t, '^\s*(?:[-*•]|\d+[.)])\s+', ''), '\s+', ' ', 'g')), '^["''“”‘’ ]+|["''“”‘’ ]+$', '', 'g') AS quote
  FROM (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""")
def t16_clean_quotes(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "t"))
    return lines.select("doc_id", F.col("i").cast("long").alias("i"), T.clean_quote(F.col("t")).alias("quote"))


_CITE = r"(?:[^()\[\]]*[\x{e000}\d][^()\[\]]*|\s*[sS][eE][eE]\b[^()\[\]]*)"


def _drop(x: str) -> str:
    for _ in range(3):
        for _ in range(3):
            x = rf"regexp_replace({x}, '\({_CITE}\)|\[{_CITE}\]|\[[^()\[\]]*[.!?]\s*\]', '', 'g')"
        x = rf"regexp_replace(regexp_replace({x}, '\(([^()\[\]]*)\)', chr(57349) || '\1' || chr(57350), 'g'), '\[([^()\[\]\x{{e005}}\x{{e006}}]*)\]', '\1', 'g')"
        x = f"translate({x}, chr(57349) || chr(57350), chr(57345) || chr(57346))"
    return rf"regexp_replace(trim(regexp_replace(translate({x}, chr(57345) || chr(57346), '()'), '\s+', ' ', 'g')), '\s+([.,;:!?])', '\1', 'g')"


@query(f"SELECT doc_id, {_drop('t')} AS block FROM (SELECT doc_id, text || ' (see [a], p. 3) (said) [Cited (1982).] [kept] [j (k, 1982), 9] [x (said) 9] .' AS t FROM documents)")
def x5_clean_block(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit(" (see [a], p. 3) (said) [Cited (1982).] [kept] [j (k, 1982), 9] [x (said) 9] ."))
    return load(spark, d, "documents").select("doc_id", T.clean_block(text).alias("block"))


@query(r"""SELECT doc_id, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 32), '-+$', ''), ''), 'input') AS slug FROM documents""")
def x11_slug(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query(r"""SELECT page_id, regexp_matches(url, '(?i)^https?://') AS is_url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS url_key FROM pages""")
def s5_url_key(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", T.is_url(F.col("url")).alias("is_url"), T.url_key(F.col("url")).alias("url_key"))
