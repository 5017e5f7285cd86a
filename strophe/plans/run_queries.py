"""Queries over stored runs by rule, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.operators import runs as R
from strophe.operators import sentences as S
from strophe.operators import timeline as L
from strophe.tables import FRAMES, SECTIONS, frames, load, sections, talk_words

from .arrange_queries import _SENT
from .registry import query
from .text_queries import _TIMED
from .timeline_queries import _ENERGY, _PLACED

_AT = lambda xs: F.array(*map(F.lit, xs))


@query("""WITH p AS (SELECT event_id, event_id % 3 > 0 AS audio, event_id % 4 = 0 AS cover, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE event_id * 10 END AS a, CASE WHEN event_id % 7 > 2 THEN 128000 END AS b, CASE WHEN event_id % 6 < 4 THEN round(value, 2) END AS d, round(value, 2) + 1 AS e FROM events)
  SELECT event_id, coalesce(nullif(d, 0), nullif(e, 0))::DOUBLE AS duration_s, NOT cover AS has_video, 'aac' AS codec, 44100 AS sample_rate, coalesce(nullif(a, 0), b)::BIGINT AS bit_rate FROM p WHERE audio""")
def s11_probes(spark: SparkSession, d: str) -> DataFrame:
    """Probes written as JSON, with and without audio, cover art, zero and absent rates and lengths."""
    n, length = F.col("event_id"), F.round("value", 2)
    rate = F.when(n % 5 == 0, "N/A").when(n % 5 == 1, "0").otherwise((n * 10).cast("string"))
    video = F.struct(F.lit("video").alias("codec_type"), F.lit(None).cast("string").alias("codec_name"), F.lit(None).cast("string").alias("sample_rate"), F.lit(None).cast("string").alias("bit_rate"), F.lit(None).cast("string").alias("duration"), F.struct(F.when(n % 4 == 0, 1).otherwise(0).alias("attached_pic")).alias("disposition"))
    sound = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit("44100").alias("sample_rate"), rate.alias("bit_rate"), (length + 1).cast("string").alias("duration"), F.struct(F.lit(0).alias("attached_pic")).alias("disposition"))
    streams = F.when(n % 3 > 0, F.array(video, sound)).otherwise(F.array(video))
    fmt = F.struct(F.lit("mov").alias("format_name"), F.when(n % 6 < 4, length.cast("string")).alias("duration"), F.when(n % 7 > 2, "128000").alias("bit_rate"))
    rows = load(spark, d, "events").select("event_id", R.probed(F.to_json(F.struct(streams.alias("streams"), fmt.alias("format")))).alias("p")).filter("p is not null")
    return rows.select("event_id", "p.duration_s", "p.has_video", "p.codec", "p.sample_rate", "p.bit_rate")


_VOICES = rf"(^|[^\p{{L}}\p{{N}}_])({R.VOICES})([^\p{{L}}\p{{N}}_]|$)"


@query(rf"""WITH s AS (SELECT doc_id, list_filter(string_split(text, '. '), lambda x: true) AS st FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, len(st) > 4 AS many, len(list_filter(st, lambda x: length(x) > 80)) AS long, len(list_filter(st, lambda x: regexp_matches(x, '{_VOICES}', 'i'))) AS voiced FROM s""")
def p5_style_faults(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of each document as styles."""
    faults = R.style_faults(F.split("text", r"\. "))
    return load(spark, d, "documents").filter("text is not null").select("doc_id", faults.alias("f")).select("doc_id", "f.many", F.col("f.long").cast("long").alias("long"), F.size("f.voiced").cast("long").alias("voiced"))


@query(f"""WITH {_PLACED}, b AS (SELECT song, n, start_bar + CASE WHEN n % 7 = 0 THEN -3 ELSE 0 END AS start_bar, bars, clip, n % 3 AS off FROM placed), en AS (SELECT song, arg_max(start_bar + greatest(bars, 1), n) AS eb FROM b GROUP BY song),
  a AS (SELECT b.song, n, (start_bar * 4 + off) * 0.5::DOUBLE AS s, (start_bar * 4 + off) * 0.5::DOUBLE + p_size AS e, eb FROM b JOIN part ON clip = 'c' || p_partkey JOIN en ON en.song = b.song), l AS (SELECT *, lag(e) OVER (PARTITION BY song ORDER BY s, e, n) AS p FROM a)
  SELECT song, n, 'before' AS kind FROM l WHERE s < 0 UNION ALL SELECT song, n, 'one before' FROM l WHERE s < p - 1e-9 UNION ALL SELECT song, n, 'past' FROM l WHERE e > eb * 2 + 2 + 1e-9 UNION ALL SELECT song, NULL, 'total' FROM en JOIN (SELECT song, sum(bars) AS tb FROM placed GROUP BY song) USING (song) WHERE tb <> eb""")
def p6_placement_problems(spark: SparkSession, d: str) -> DataFrame:
    at = L.placed(sections(spark, d))
    own = at.withColumn("start_bar", F.col("start_bar") + F.when(F.col("n") % 7 == 0, -3).otherwise(0)).withColumn("offset_beats", F.col("n") % 3)
    lengths = load(spark, d, "part").select(F.concat(F.lit("c"), "p_partkey").alias("clip"), F.col("p_size").cast("double").alias("duration_s"))
    return R.placement_problems(own, lengths, at.groupBy("song").agg(F.sum("bars").alias("total_bars")), 120.0)


@query(f"""WITH {FRAMES}, t AS (SELECT *, max(db) OVER (PARTITION BY stream) AS top, max(i) OVER (PARTITION BY stream) AS e FROM frames)
  SELECT stream, coalesce(max(CASE WHEN i >= 5 AND db >= top - 50 THEN i + 1 END), least(5, max(i) + 1))::BIGINT AS settled,
    coalesce(max(CASE WHEN i >= 5 THEN db END) >= -80 AND 10 * log10(avg(CASE WHEN i > e - 2 THEN pow(10.0::DOUBLE, db / 10) END) + 1e-12) >= max(CASE WHEN i >= 5 THEN db END) - 20, false) AS abrupt FROM t GROUP BY stream""")
def w21_endings(spark: SparkSession, d: str) -> DataFrame:
    return R.endings(frames(spark, d), "stream", "i", "db", F.lit(5)).withColumn("settled", F.col("settled").cast("long"))


@query(f"""WITH {_PLACED}, s AS (SELECT song, n, start_bar, CASE WHEN n % 4 <> 3 THEN -60 + energy * 50 END AS lufs, CASE WHEN song % 3 > 0 THEN -song % 20 END AS ref FROM placed)
  SELECT song, arg_max(n, (lufs IS NOT NULL AND coalesce(lufs >= ref - 25, true), n)) AS n, arg_max(start_bar, (lufs IS NOT NULL AND coalesce(lufs >= ref - 25, true), n)) AS start FROM s GROUP BY song""")
def w21_live_starts(spark: SparkSession, d: str) -> DataFrame:
    rows = L.placed(sections(spark, d)).select("song", "n", F.col("start_bar").alias("start"), F.when(F.col("n") % 4 != 3, -60 + F.col("energy") * 50).alias("lufs"))
    return R.live_starts(rows, F.when(F.col("song") % 3 > 0, -F.col("song") % 20))


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 1 END, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END, 8)::INT AS bars, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_name END, 'long') AS label FROM supplier""")
def f26_lengths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = load(spark, d, "supplier")
    base = rows.select("s_suppkey", F.when(k % 2 == 0, F.col("s_nationkey")).cast("int").alias("bars"), F.lit(None).cast("string").alias("label"))
    over = rows.filter(k % 3 == 0).select("s_suppkey", (F.col("s_nationkey") + 1).cast("int").alias("bars"), F.col("s_name").alias("label"))
    return R.for_length(base, over, ["s_suppkey"], {"bars": 8, "label": "long"})


@query()
def p14_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines as clips, edited by commands made from the lines."""
    clip = F.concat(F.lit("c"), F.col("l_linenumber"))
    name = F.get(_AT(("drop", "keep", "move", "order")), (F.col("l_partkey") % 4).cast("int"))
    command = F.struct(name.alias("name"), F.array(F.concat(F.lit("c"), F.col("l_suppkey") % 8)).alias("clips"), (F.col("l_quantity").cast("int") % 6).alias("at"))
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(clip)).alias("ids"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", command.alias("c")))).alias("cs"))
    done = R.reviewed(F.col("ids"), F.transform("cs", lambda x: x["c"]))
    return lines.select("l_orderkey", done.alias("r")).select("l_orderkey", F.array_join("r.kept", ",").alias("kept"), F.array_join("r.dropped", ",").alias("dropped"), "r.refused")


@query("""SELECT o_orderkey, o_custkey % 3 = 0 AND len(list_filter(list_concat([o_custkey % 5], [o_orderkey % 7]), lambda x: NOT list_contains([0, 1, 2, 3], x))) = 0 AS holds FROM orders""")
def p15_reviews_that_hold(spark: SparkSession, d: str) -> DataFrame:
    made = F.when(F.col("o_custkey") % 3 == 0, "now").when(F.col("o_custkey") % 3 == 1, "then")
    holds = R.review_holds(made, F.lit("now"), F.array(F.col("o_custkey") % 5), F.array(F.col("o_orderkey") % 7), F.array(*(F.lit(k).cast("long") for k in range(4))))
    return load(spark, d, "orders").select("o_orderkey", holds.alias("holds"))


_CALLS = "c AS (SELECT l_orderkey AS run, ['a', 'b', 'c'][l_partkey % 3 + 1] AS leader, l_linenumber AS made, ['a', 'b', 'c'][l_suppkey % 3 + 1] AS length, l_quantity::INT % 2 AS targets, CASE WHEN l_suppkey % 5 = 0 THEN 'x' END AS shared FROM lineitem)"


@query(f"""WITH {_CALLS}, w AS (SELECT o_orderkey AS run, unnest(['a', 'b', 'c']) AS length, 1 AS targets FROM orders), f AS (SELECT run, length, targets, arg_min(leader, (made, leader)) AS leader FROM c WHERE shared IS NULL AND leader <> length GROUP BY ALL)
  SELECT w.run, w.length, f.leader FROM w LEFT JOIN f ON f.run = w.run AND f.length = w.length AND f.targets = w.targets""")
def k7_shared_answers(spark: SparkSession, d: str) -> DataFrame:
    names = lambda c: F.get(_AT("abc"), (F.col(c) % 3).cast("int"))
    calls = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), names("l_partkey").alias("leader"), F.col("l_linenumber").alias("made"), names("l_suppkey").alias("length"), (F.col("l_quantity").cast("int") % 2).alias("targets"), F.when(F.col("l_suppkey") % 5 == 0, "x").alias("shared"))
    wanted = load(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.explode(_AT("abc")).alias("length"), F.lit(1).alias("targets"))
    return R.shared_answers(wanted, calls, ["targets"]).select("run", "length", "leader")


@query(f"WITH {SECTIONS} SELECT song, n, (SELECT arg_min(role, b.n) FROM sections b WHERE b.song = a.song AND b.n < a.n AND b.silent) AS leader FROM sections a")
def k7_batch_leaders(spark: SparkSession, d: str) -> DataFrame:
    batch = sections(spark, d).select(F.col("song").alias("run"), F.col("n").alias("pos"), F.col("role").alias("length"), F.col("silent").alias("needs"))
    return R.batch_leaders(batch).select(F.col("run").alias("song"), F.col("pos").alias("n"), "leader")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR || ',7' WHEN p_size % 3 = 1 AND p_size % 4 > 0 THEN p_size * 1000 || ',' || 3000 END AS grid,
  CASE WHEN p_size % 5 > 0 THEN 'v' || (p_size % 5 - 1) ELSE 'now' END AS file, CASE WHEN p_size % 5 > 0 THEN 1 ELSE 0 END AS undone FROM part""")
def k12_take_versions(spark: SparkSession, d: str) -> DataFrame:
    """Grids stored or from responses, and takes one version back."""
    size = F.col("p_size")
    second = F.when(size % 4 > 0, F.lit('{"duration_ms": 3000}')).otherwise(F.lit('{"text": "x"}'))
    response = F.when(size % 3 == 1, F.concat(F.lit('{"composition_plan": {"chunks": [{"duration_ms": '), size * 1000, F.lit("}, "), second, F.lit("]}}")))
    grid = R.take_grid(F.when(size % 3 == 0, F.array(size.cast("long"), F.lit(7).cast("long"))), response)
    history = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < size % 5), lambda i: F.concat(F.lit("v"), i))
    back = R.undone(F.lit("now"), history, F.array().cast("array<string>"))
    return load(spark, d, "part").select("p_partkey", F.array_join(grid.cast("array<string>"), ",").alias("grid"), back["file"].alias("file"), F.size(back["undone"]).alias("undone"))


@query("SELECT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey % 7 <> 0 AND l_quantity % 4 = 1")
def k11_misfits(spark: SparkSession, d: str) -> DataFrame:
    """Paid takes whose grid differs from the arrangement's, or without a grid, whose request does; stubs are remade for free."""
    rows = load(spark, d, "lineitem").withColumn("grid", F.when(F.col("l_quantity") % 2 == 0, F.array(F.lit(1))))
    fits = F.when(F.col("grid").isNotNull(), F.col("grid") == F.array(F.lit(1))).otherwise(F.col("l_quantity") % 4 == 3)
    return rows.filter((F.col("l_suppkey") % 7 != 0) & ~fits).select("l_suppkey", "l_partkey")


@query(f"WITH {_ENERGY} SELECT song, n, round((e_start + e_end) / 2, 4) AS energy, round(music_bar * 2.0, 4)::DOUBLE AS from_s, round((music_bar + bars) * 2.0, 4)::DOUBLE AS to_s FROM eb WHERE NOT silent AND NOT rest")
def l8_measured_spans(spark: SparkSession, d: str) -> DataFrame:
    return R.measured_spans(sections(spark, d), 120.0)


@query("""SELECT event_id, round(1.0 - 0.4 * least(1.0, greatest(0.0, coalesce(er, 0.0) - 0.005) / 0.015) - CASE event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.15 ELSE 0.3 END - 0.3 * (1 - greatest(0.0, coalesce(co, 0.0))) - 0.5 * (event_id % 4) / 4, 3)::DOUBLE AS score
  FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN (event_id % 40) / 1024::DOUBLE END AS er, CASE WHEN event_id % 7 > 0 THEN (event_id % 16 - 4) / 16::DOUBLE END AS co FROM events)""")
def l9_take_scores(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    relation = F.get(_AT(("same", "relative", "other")), (n % 3).cast("int"))
    score = R.take_score(F.when(n % 5 > 0, (n % 40) / 1024), F.lit(0.02), relation, F.when(n % 7 > 0, (n % 16 - 4) / 16), (n % 4) / 4)
    return load(spark, d, "events").select("event_id", score.alias("score"))


@query(f"""WITH {_TIMED}, {_SENT}, l AS (SELECT talk_id, id, start_ms / 1000.0 AS s, end_ms / 1000.0 AS e, text FROM se) SELECT talk_id, string_agg(format('{{}} | {{:.1f}}-{{:.1f}} | {{:.1f}}s | {{}}', id, s::DOUBLE, e::DOUBLE, (e::DOUBLE - s::DOUBLE), text), chr(10) ORDER BY id) AS text FROM l GROUP BY talk_id""")
def l11_sentence_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = S.sentence_rows(S.timed_sentences(talk_words(spark, d), "talk_id", 1500), "talk_id")
    line = R.sentence_line(F.col("id"), F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0, F.col("text"))
    return R.listed(rows, "talk_id", "id", line)


@query(f"""WITH {SECTIONS} SELECT song, string_agg(CASE WHEN role = 'speech_bed' THEN '- speech_bed' || CASE WHEN rest THEN ' (alone)' ELSE '' END || ': ' || clip ELSE '- ' || role || ': ' || bars || ' bars' END || CASE WHEN n % 2 = 0 THEN ' [' || shape || '; calm]' ELSE '' END, chr(10) ORDER BY n) AS text FROM sections GROUP BY song""")
def l11_part_lists(spark: SparkSession, d: str) -> DataFrame:
    styles = F.when(F.col("n") % 2 == 0, F.array("shape", F.lit("calm"))).otherwise(F.array().cast("array<string>"))
    return R.listed(sections(spark, d), "song", "n", R.part_line(F.col("role"), F.col("bars"), F.array("clip"), F.col("rest"), styles))


_CHORDS = "list_transform(range(0, bars), lambda i: ['A', 'F', 'C', 'G'][((i // 2) % (bars % 4 + 1)) % 4 + 1])"


@query(f"""WITH {SECTIONS}, c AS (SELECT *, {_CHORDS} AS ch FROM sections), u AS (SELECT *, list_filter(ch, lambda x, i: i = 1 OR x <> ch[i - 1]) AS nm FROM c),
  y AS (SELECT *, nm[1:least(8, list_filter(range(1, len(nm) + 1), lambda p: len(list_filter(range(1, len(nm) + 1), lambda i: nm[i] <> nm[(i - 1) % p + 1])) = 0)[1])] AS cy FROM u),
  w AS (SELECT *, list_concat(['120 BPM', 'A minor', ' Instrumental only', 'instrumental only', role], CASE shape WHEN 'rise' THEN ['steadily building', 'rising energy throughout, from moderate to intense'] WHEN 'fall' THEN ['fading out to silence at the end'] ELSE [] END,
    [CASE WHEN len(cy) = 1 THEN 'harmony resting on ' WHEN role = 'speech_bed' THEN 'slow chord changes ' ELSE 'chord progression ' END || array_to_string(cy, ' - ')]) AS st FROM y),
  t AS (SELECT *, list_transform(st, lambda x: trim(x)) AS tr FROM w)
  SELECT song, n, array_to_string(list_filter(tr, lambda x, i: list_position(list_transform(tr, lambda z: lower(z)), lower(x)) = i), '|') AS styles FROM t""")
def l6_chunk_styles(spark: SparkSession, d: str) -> DataFrame:
    chords = F.transform(F.sequence(F.lit(0), F.col("bars") - 1), lambda i: F.get(_AT("AFCG"), (F.floor(i / 2) % (F.col("bars") % 4 + 1) % 4).cast("int")))
    rows = sections(spark, d).withColumn("chords", chords)
    styles = F.concat(_AT(("120 BPM", "A minor", " Instrumental only", "instrumental only")), F.array("role"), R.shape_words(F.col("shape")), R.chord_words(F.col("chords"), F.col("role") == "speech_bed"))
    return rows.select("song", "n", F.array_join(R.deduped(styles), "|").alias("styles"))


@query("SELECT event_id, round(s - m, 2) AS margin_db, round(greatest(-9.0, least(0.0, s - m - 6.0)), 2) AS gain_db FROM (SELECT event_id, -(event_id % 32) / 4 - 20::DOUBLE AS s, -(event_id % 56) / 8 - 20::DOUBLE AS m FROM events)")
def l15_passage_gains(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    rows = load(spark, d, "events").select("event_id", (-(n % 32) / 4 - 20).alias("speech_db"), (-(n % 56) / 8 - 20).alias("music_db"))
    return R.passage_gains(rows, 6.0, -9.0).select("event_id", "margin_db", "gain_db")


_STAGES = [("ingest", 0, "run"), ("transcribe", 1, "run"), ("select", 2, "song"), ("arrange", 3, "song"), ("mix", 4, "song")]


@query(f"""WITH st(stage, pos, scope) AS (VALUES {", ".join(map(str, _STAGES))}), le AS (SELECT DISTINCT o_custkey AS run, o_orderstatus AS length FROM orders),
  re AS (SELECT o_custkey AS run, CASE WHEN o_orderkey % 5 < 2 THEN '-' ELSE o_orderstatus END AS length, ['ingest', 'transcribe', 'select', 'arrange', 'mix'][o_orderkey % 5 + 1] AS stage, 'complete' AS status, max(o_totalprice) AS took FROM orders GROUP BY ALL),
  al AS (SELECT DISTINCT run, '-' AS length, stage, pos FROM le, st WHERE scope = 'run' UNION ALL SELECT run, length, stage, pos FROM le, st WHERE scope = 'song')
  SELECT al.run, al.length, al.stage, pos::BIGINT AS pos, coalesce(status, 'not run') AS state, took FROM al LEFT JOIN re ON re.run = al.run AND re.length = al.length AND re.stage = al.stage""")
def l19_stage_table(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").withColumnsRenamed({"o_custkey": "run"})
    k = (F.col("o_orderkey") % 5).cast("int")
    records = orders.groupBy("run", F.when(k < 2, "-").otherwise(F.col("o_orderstatus")).alias("length"), F.get(_AT([s for s, _, _ in _STAGES]), k).alias("stage")).agg(F.max("o_totalprice").alias("took")).withColumn("status", F.lit("complete"))
    stages = spark.createDataFrame(_STAGES, "stage string, pos long, scope string")
    return R.stage_table(stages, orders.select("run", F.col("o_orderstatus").alias("length")).distinct(), records)


@query("SELECT o_orderkey, unnest(['call', 'retry, only if the answer fails validation']) AS description, round(o_totalprice / 1000, 6) AS usd FROM orders")
def y9_retry_estimates(spark: SparkSession, d: str) -> DataFrame:
    return R.retry_estimates(load(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 1000, 6).alias("usd")))


@query(f"WITH {SECTIONS}, m AS (SELECT song, role, min(n) AS n, bool_or(silent) AS a, bool_or(bars > 12) AS b FROM sections GROUP BY ALL) SELECT song, string_agg(role, ',' ORDER BY n) AS lengths FROM m WHERE a OR b GROUP BY song")
def a21_made_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths that have stages or a folder, in the order they were first made."""
    made = sections(spark, d).groupBy("song", "role").agg(F.min("n").alias("n"), F.bool_or("silent").alias("stages"), F.bool_or(F.col("bars") > 12).alias("folder"))
    return R.listed(made.filter("stages or folder"), "song", "n", F.col("role"), ",").withColumnRenamed("text", "lengths")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS pos, w FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations WHERE text IS NOT NULL)")
def a22_words_of_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments with nested words as one list of words."""
    words = load(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    return words.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i")) - 1).alias("pos"), "w")


@query("SELECT sel, pos, p_name FROM (SELECT l_orderkey AS sel, l_linenumber AS pos, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE p_size % 2 = 0")
def p11_kept_clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips in playback order, those of the order that are kept."""
    order = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("sel"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("p_partkey"))
    return order.join(load(spark, d, "part").filter("p_size % 2 = 0").select("p_partkey", "p_name"), "p_partkey").select("sel", "pos", "p_name")


@query(f"""WITH {SECTIONS}, a AS (SELECT song AS preset, role, CASE WHEN n % 3 = 0 THEN bars * 5 END AS bars FROM sections), r AS (SELECT DISTINCT song AS preset, role, CASE WHEN song % 5 = 0 THEN 4 END AS bars, song % 7 = 0 AS silent FROM sections WHERE (song + length(role)) % 4 > 0)
  SELECT preset, 'no speech' AS kind, NULL AS role FROM a GROUP BY preset HAVING NOT bool_or(role = 'speech_bed') UNION ALL SELECT DISTINCT preset, 'unknown', role FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.preset = a.preset AND r.role = a.role)
  UNION ALL SELECT DISTINCT preset, 'bars', role FROM a WHERE bars IS NOT NULL AND (role = 'speech_bed' OR bars NOT BETWEEN 1 AND 64)
  UNION ALL SELECT preset, 'speech bars', role FROM r WHERE role = 'speech_bed' AND bars IS NOT NULL UNION ALL SELECT preset, 'silent speech', role FROM r WHERE role = 'speech_bed' AND silent""")
def p10_preset_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = sections(spark, d).withColumnRenamed("song", "preset")
    arcs = rows.select("preset", F.col("n").alias("pos"), "role", F.when(F.col("n") % 3 == 0, F.col("bars") * 5).alias("bars"))
    roles = rows.filter((F.col("preset") + F.length("role")) % 4 > 0).select("preset", "role").distinct()
    return R.preset_problems(arcs, roles.withColumn("bars", F.when(F.col("preset") % 5 == 0, 4)).withColumn("silent", F.col("preset") % 7 == 0))


@query("""WITH t AS (SELECT l_orderkey AS song, l_linenumber AS take, l_suppkey % 2 = 1 AS archived, CASE WHEN l_partkey % 5 > 0 THEN 'paid' ELSE 'stub' END AS backend, CASE WHEN l_quantity % 4 > 0 THEN 'id' || l_partkey END AS song_id FROM lineitem),
  f AS (SELECT song, take, backend, song_id FROM (SELECT *, row_number() OVER (PARTITION BY song, take ORDER BY archived, song_id NULLS FIRST, backend) AS k FROM t) WHERE k = 1),
  w AS (SELECT o_orderkey AS song, coalesce(CASE WHEN o_custkey % 3 = 0 THEN 2 END, CASE WHEN o_custkey % 4 > 0 THEN 1 END) AS take FROM orders)
  SELECT w.song, w.take::INT AS take, song_id FROM w JOIN f ON f.song = w.song AND f.take = w.take WHERE backend = 'paid' AND song_id IS NOT NULL""")
def j24_anchor_takes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    wanted = load(spark, d, "orders").select(F.col("o_orderkey").alias("song"), F.when(c % 3 == 0, 2).alias("made_with"), F.when(c % 4 > 0, 1).alias("chosen"))
    takes = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("song"), F.col("l_linenumber").cast("int").alias("take"), (F.col("l_suppkey") % 2 == 1).alias("archived"), F.when(F.col("l_partkey") % 5 > 0, "paid").otherwise("stub").alias("backend"), F.when(F.col("l_quantity") % 4 > 0, F.concat(F.lit("id"), "l_partkey")).alias("song_id"))
    return R.anchor_takes(wanted, takes, "paid")
