"""Queries over arcs, arrangements, edits and versions, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.operators import building as B
from strophe.operators import theory as H
from strophe.operators import timeline as L
from strophe.operators import versions as V
from strophe.storage import written
from strophe.tables import SECTIONS, TALK_WORDS, load, sections, talk_words

from .registry import query
from .select_queries import _CLIPS, clips
from .timeline_queries import _MS, _PLACED

_SQL_LISTS = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""WITH {SECTIONS}, sp AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY n) - 1 AS slot, count(*) OVER (PARTITION BY song) AS slots FROM sections WHERE role = 'speech_bed'),
  g AS (SELECT song, slots, least(slots, song % 3 + 1) AS gs, unnest(range(least(slots, song % 3 + 1))) AS g FROM (SELECT DISTINCT song, slots FROM sp)),
  a AS (SELECT song, CASE WHEN g = gs - 1 AND gs > 1 AND gs < slots THEN slots - 1 ELSE g END AS slot, 'g' || g AS clips FROM g)
  SELECT song, n, role, bars, NULL::VARCHAR AS clips FROM sections WHERE role <> 'speech_bed' UNION ALL SELECT sp.song, n, role, NULL, a.clips FROM sp JOIN a ON a.song = sp.song AND a.slot = sp.slot""")
def d7_arc_parts(spark: SparkSession, d: str) -> DataFrame:
    """Each song's sections as an arc, one to three groups of clips for its speech slots."""
    arc = sections(spark, d)
    slots = arc.filter("role = 'speech_bed'").groupBy("song").agg(F.count("*").alias("slots"))
    groups = slots.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.least("slots", F.col("song") % 3 + 1) - 1))).select("song", "g", F.array(F.concat(F.lit("g"), "g")).alias("clips"))
    parts = B.arc_parts(arc.select("song", F.col("n").alias("pos"), "role", "bars"), groups, ["song"])
    return parts.select("song", F.col("pos").alias("n"), "role", "bars", F.array_join("clips", ",").alias("clips"))


@query("""SELECT p_partkey, array_to_string(list_transform(range(bars), lambda i: CASE WHEN i < lead THEN own[1] ELSE own[(i - lead) % len(own) + 1] END), ' ') AS chords
  FROM (SELECT *, least(bars, offs // 4) AS lead, ['Am', 'F', 'C', 'G'][1:k] AS own FROM (SELECT p_partkey, p_size % 12 + 1 AS bars, p_size % 30 AS offs, p_partkey % 4 + 1 AS k FROM part))""")
def l2_bed_chords(spark: SparkSession, d: str) -> DataFrame:
    own = F.slice(F.array(*map(F.lit, ("Am", "F", "C", "G"))), F.lit(1), (F.col("p_partkey") % 4 + 1).cast("int"))
    bars = (F.col("p_size") % 12 + 1).cast("int")
    return load(spark, d, "part").select("p_partkey", F.array_join(B.bed_chords(own, bars, (F.col("p_size") % 30).cast("double")), " ").alias("chords"))


_NAMES = {"major": ["C", "Dm", "Em", "F", "G", "Am", "Bdim"], "minor": ["Am", "Bdim", "C", "Dm", "Em", "F", "G"]}
_HOME = {"major": 0, "minor": 9}
_TRIADS = {m: [pcs for _, pcs in H.triads(m, _HOME[m])] for m in _NAMES}
_VOCABULARY = ", ".join(f"('{m}', '{r}', {rows})" for m, roles in B.PROGRESSIONS.items() for r, rows in roles.items())
_WEIGHTS = "list_transform(range(12), lambda pc: ((song * 7 + n * 5 + pc * pc) % 6)::DOUBLE)"


@query(f"""WITH {SECTIONS}, v(mode, role, options) AS (VALUES {_VOCABULARY}), s AS (SELECT *, CASE song % 2 WHEN 0 THEN 'minor' ELSE 'major' END AS mode, {_WEIGHTS} AS ws FROM sections),
  o AS (SELECT s.*, options, CASE s.mode WHEN 'major' THEN {_TRIADS["major"]} ELSE {_TRIADS["minor"]} END AS tr, CASE s.mode WHEN 'major' THEN {_SQL_LISTS(_NAMES["major"])} ELSE {_SQL_LISTS(_NAMES["minor"])} END AS nm FROM s JOIN v ON v.mode = s.mode AND v.role = s.role),
  f AS (SELECT *, list_transform(options, lambda o: CASE WHEN list_sum(ws) <= 0 THEN 0.0 ELSE round(list_sum(list_transform(o, lambda d: list_sum(list_transform(tr[d], lambda pc: ws[pc + 1])) / list_sum(ws))) / len(o), 9) END) AS fits FROM o),
  l AS (SELECT song, role, list({{'n': n, 'fits': fits, 'last': -1, 'picks': []::INT[]}} ORDER BY n) AS xs FROM f GROUP BY song, role),
  p AS (SELECT song, role, list_transform(xs, lambda x: x.n) AS ns, list_reduce(xs, lambda acc, x: list_transform([list_transform(x.fits, lambda v, i: round(v - CASE WHEN i - 1 = acc.last THEN 0.5 ELSE 0 END, 9))], lambda sc: {{'n': x.n, 'fits': x.fits, 'last': list_position(sc, list_max(sc)) - 1, 'picks': list_append(acc.picks, (list_position(sc, list_max(sc)) - 1)::INT)}})[1], {{'n': 0, 'fits': []::DOUBLE[], 'last': -1, 'picks': []::INT[]}}).picks AS picks FROM l),
  q AS (SELECT song, unnest(ns) AS n, unnest(picks) AS pick FROM p), c AS (SELECT f.*, options[pick + 1] AS dg, CASE WHEN role IN ('intro', 'outro') THEN 2 ELSE 1 END AS per FROM f JOIN q USING (song, n))
  SELECT song, n, array_to_string(dg, ' ') AS degrees, array_to_string(list_transform(range(bars), lambda i: CASE WHEN role = 'outro' AND bars >= 2 AND i = bars - 1 THEN nm[1] ELSE nm[dg[(i // per) % len(dg) + 1]] END), ' ') AS chords FROM c""")
def f8_section_chords(spark: SparkSession, d: str) -> DataFrame:
    """Progressions in C major or A minor that fit a made-up melody around each section and differ from the role's last."""
    minor = F.col("song") % 2 == 0
    lists = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    names = lambda m: F.array(*map(F.lit, _NAMES[m]))
    weights = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda pc: ((F.col("song") * 7 + F.col("n") * 5 + pc * pc) % 6).cast("double"))
    rows = sections(spark, d).select("song", "n", "role", "bars", F.when(minor, "minor").otherwise("major").alias("mode"), F.when(minor, lists(_TRIADS["minor"])).otherwise(lists(_TRIADS["major"])).alias("triads"), F.when(minor, names("minor")).otherwise(names("major")).alias("names"), weights.alias("weights"))
    return B.section_chords(rows).select("song", "n", F.array_join(F.col("degrees").cast("array<string>"), " ").alias("degrees"), F.array_join("chords", " ").alias("chords"))


@query(f"""WITH {_PLACED}, s AS (SELECT *, clip IS NULL AS music, NOT rest AND NOT silent AS sounding, 'c' || (song % 100 + 1) AS main, CASE song % 3 WHEN 0 THEN 'held_chord' WHEN 1 THEN 'stop' ELSE 'fade' END AS ending FROM placed),
  h AS (SELECT *, row_number() OVER (PARTITION BY song, role ORDER BY n) AS k, count(*) OVER (PARTITION BY song, role) AS c, last_value(clip IGNORE NULLS) OVER b AS heard, count(clip) OVER b AS p FROM s WINDOW b AS (PARTITION BY song ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT *, CASE WHEN music AND NOT silent AND row_number() OVER (PARTITION BY song, p, music, silent ORDER BY n) = 1 THEN coalesce(heard, main) END AS answer, max(CASE WHEN sounding THEN n END) OVER (PARTITION BY song) AS l FROM h),
  g AS (SELECT *, max(CASE WHEN sounding AND music AND n < l THEN n END) OVER (PARTITION BY song) AS bf, bool_or(n = l AND NOT music) OVER (PARTITION BY song) AS spoken FROM f)
  SELECT song, n, role, bars, start_bar, round(start_bar * 2.0, 4)::DOUBLE AS start_s, round(bars * 2.0, 4)::DOUBLE AS seconds, CASE WHEN music AND c > 1 THEN CASE WHEN k = 1 THEN 'first' WHEN k = c THEN 'last' END END AS occurrence,
    CASE WHEN music AND role IN ('drop', 'outro') THEN heard END AS replay, CASE WHEN answer IN (SELECT 'c' || p_partkey FROM part WHERE p_size % 2 = 0) THEN answer END AS answers,
    CASE WHEN n = l AND ending = 'fade' THEN 'fall' WHEN ending <> 'fade' AND shape = 'fall' AND (n = l OR spoken AND n = bf) THEN 'flat' ELSE shape END AS shape, coalesce(n = l AND ending <> 'fade', false) AS home FROM g""")
def l1_arranged_sections(spark: SparkSession, d: str) -> DataFrame:
    ending = F.when(F.col("song") % 3 == 0, "held_chord").when(F.col("song") % 3 == 1, "stop").otherwise("fade")
    rows = sections(spark, d).withColumn("main", F.concat(F.lit("c"), F.col("song") % 100 + 1)).withColumn("ending", ending)
    noted = load(spark, d, "part").filter("p_size % 2 = 0").select(F.concat(F.lit("c"), "p_partkey").alias("clip"))
    return B.arranged(rows, noted, 120.0, ("drop", "outro"))


_PIECES = f"""{_MS}, ch AS (SELECT song, start_ms AS a, end_ms AS b FROM ms WHERE end_ms > start_ms), rg AS (SELECT song, min(start_ms) AS f, max(end_ms) AS t FROM ms WHERE n BETWEEN 2 AND 3 GROUP BY song),
  tc AS (SELECT ch.song, CASE WHEN t - f < 3000 THEN a ELSE greatest(a, f) END AS a, CASE WHEN t - f < 3000 THEN b ELSE least(b, t) END AS b FROM ch JOIN rg ON rg.song = ch.song AND a < t AND b > f),
  li AS (SELECT song, list([a, b] ORDER BY a, b) AS xs FROM tc WHERE b > a GROUP BY song),
  me AS (SELECT song, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN x[1][2] - x[1][1] < 3000 OR acc[-1][2] - acc[-1][1] < 3000 THEN list_append(acc[1:len(acc) - 1], [acc[-1][1], x[1][2]]) ELSE list_append(acc, x[1]) END) AS ps FROM li),
  pc AS (SELECT song, piece, x[1] AS a, x[2] AS b FROM (SELECT song, generate_subscripts(ps, 1) - 1 AS piece, unnest(ps) AS x FROM me)),
  mn AS (SELECT pc.song, piece, a, b, arg_max(n, (least(b, end_ms) - greatest(a, start_ms), -n)) AS main_n FROM pc JOIN ms ON ms.song = pc.song AND NOT silent AND NOT rest AND start_ms < b AND end_ms > a AND end_ms > start_ms GROUP BY ALL),
  ed AS (SELECT mn.song, min(a) AS a, max(b) AS b, any_value(total) AS total FROM mn JOIN (SELECT song, max(end_ms) AS total FROM ms GROUP BY song) t ON t.song = mn.song GROUP BY mn.song),
  kp AS (SELECT song, 0::BIGINT AS a, a AS b FROM ed UNION ALL SELECT song, b, total FROM ed), ks AS (SELECT song, a, b, greatest(1, ceil((b - a) / 120000))::INT AS parts FROM kp WHERE b - a >= 50),
  pl AS (SELECT song, a + round_even(i * (b - a)::DOUBLE / parts, 0)::BIGINT AS start_ms, a + round_even((i + 1) * (b - a)::DOUBLE / parts, 0)::BIGINT AS end_ms, NULL::INT AS main_n FROM (SELECT *, unnest(range(parts)) AS i FROM ks) UNION ALL SELECT song, a, b, main_n::INT FROM mn)"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return B.section_edits(L.bounds_ms(sections(spark, d), 120.0), F.col("n").between(2, 3))


@query(f"WITH {_PIECES} SELECT song, start_ms, end_ms, main_n FROM pl")
def l7_inpaint_plan(spark: SparkSession, d: str) -> DataFrame:
    """Sections 2 and 3 of each song made again, the rest kept."""
    return _plan(spark, d)


@query(f"""WITH {_PIECES} SELECT song, count(*) AS chunks, count(*) > 30 AS too_many, count(*) FILTER (main_n IS NULL AND end_ms - start_ms NOT BETWEEN 50 AND 120000) AS bad_kept,
  count(*) FILTER (main_n IS NOT NULL AND end_ms - start_ms NOT BETWEEN 3000 AND 120000) AS bad_made FROM pl GROUP BY song""")
def p9_inpaint_problems(spark: SparkSession, d: str) -> DataFrame:
    return B.inpaint_problems(_plan(spark, d))


_QUOTES = "quotes AS (SELECT l_orderkey AS sel, 'c' || (l_partkey % 12) AS quote, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos, (l_partkey % 30)::INT AS start, (l_partkey % 30 + l_quantity::INT % 7 - l_suppkey % 2)::INT AS stop, CASE WHEN l_partkey % 2 = 0 THEN 'hook' END AS role FROM lineitem)"


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    start = (F.col("l_partkey") % 30).cast("int")
    end = (start + F.col("l_quantity").cast("int") % 7 - F.col("l_suppkey") % 2).cast("int")
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("sel"), F.concat(F.lit("c"), F.col("l_partkey") % 12).alias("quote"), pos.alias("pos"), start.alias("start"), end.alias("end"), F.when(F.col("l_partkey") % 2 == 0, "hook").alias("role"))


@query(f"""WITH {_CLIPS}, {_QUOTES}, f AS (SELECT sel, start, stop, arg_min(quote, pos) AS quote FROM quotes GROUP BY ALL) SELECT c.sel, c.pos, c.clip, f.quote FROM clips c LEFT JOIN f ON f.sel = c.sel AND f.start = c.start AND f.stop = c.stop""")
def j11_required_for(spark: SparkSession, d: str) -> DataFrame:
    return V.required_for(clips(spark, d), _quotes(spark, d), ["sel"]).select("sel", "pos", "clip", "quote")


@query(f"""WITH {_CLIPS}, {_QUOTES} SELECT sel, clip, start, stop AS "end", score, 'drop' AS role, false AS added FROM clips UNION ALL
  SELECT sel, CASE WHEN EXISTS (SELECT 1 FROM clips c WHERE c.sel = q.sel AND c.clip = q.quote) THEN quote || 'r' ELSE quote END, start, stop, 1.0::DOUBLE, coalesce(role, 'build'), true FROM quotes q WHERE NOT EXISTS (SELECT 1 FROM clips c WHERE c.sel = q.sel AND c.start = q.start AND c.stop = q.stop)""")
def g3_required_clips(spark: SparkSession, d: str) -> DataFrame:
    return V.with_required(clips(spark, d).withColumn("role", F.lit("drop")), _quotes(spark, d), ["sel"])


@query(f"""WITH {_CLIPS}, qs AS (SELECT sel, 'q' || pos AS quote, pos, (start + pos % 2)::INT AS start, (stop + pos % 2)::INT AS stop, seconds FROM clips WHERE required AND stop >= start),
  kn AS (SELECT c.* EXCLUDE required, EXISTS (SELECT 1 FROM qs WHERE qs.sel = c.sel AND qs.start = c.start AND qs.stop = c.stop) AS q FROM clips c),
  j AS (SELECT *, row_number() OVER (PARTITION BY sel, clip ORDER BY pos) > 1 OR stop < start OR (NOT q AND seconds NOT BETWEEN 3 AND 40) AS bad FROM kn),
  g AS (SELECT sel, pos, clip, start, stop, greatest(0.0, least(1.0, score))::DOUBLE AS score, seconds, q, false AS added FROM j WHERE NOT EXISTS (SELECT 1 FROM j b WHERE b.bad AND b.sel = j.sel AND b.clip = j.clip)),
  al AS (SELECT * FROM g UNION ALL SELECT sel, pos + 1000000, quote, start, stop, 1.0, seconds, true, true FROM qs WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.sel = qs.sel AND g.start = qs.start AND g.stop = qs.stop)),
  l AS (SELECT sel, list({{'clip': clip, 'start': start, 'stop': stop, 'seconds': seconds, 'q': q}} ORDER BY NOT q, -score, pos) AS xs FROM al GROUP BY sel),
  k AS (SELECT sel, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x[1].start <= y.stop AND y.start <= x[1].stop)) > 0 THEN acc ELSE list_concat(acc, x) END) AS ks FROM l),
  r AS (SELECT sel, unnest(ks) AS k, generate_subscripts(ks, 1) AS rank FROM k), s AS (SELECT *, sum(k.seconds) OVER (PARTITION BY sel ORDER BY rank) AS t FROM r),
  kp AS (SELECT al.* FROM al JOIN s ON s.sel = al.sel AND s.k.clip = al.clip WHERE rank <= 4 AND t <= 90 OR k.q), od AS (SELECT sel, clip, min(pos * 7 % 10) AS spot FROM clips WHERE pos % 4 > 0 GROUP BY ALL),
  o AS (SELECT kp.*, od.spot, (SELECT min(d.spot) FROM kp b JOIN od d ON d.sel = b.sel AND d.clip = b.clip WHERE b.sel = kp.sel AND b.start > kp.start) AS later FROM kp LEFT JOIN od ON od.sel = kp.sel AND od.clip = kp.clip)
  SELECT sel, clip, start, stop AS "end", score, added, row_number() OVER (PARTITION BY sel ORDER BY start)::INT AS time_pos,
    row_number() OVER (PARTITION BY sel ORDER BY CASE WHEN spot IS NOT NULL THEN spot WHEN added THEN coalesce(later, 1000000) ELSE 1000001 END, spot IS NOT NULL, CASE WHEN spot IS NULL AND NOT added THEN -score ELSE 0 END, start)::INT AS play_pos FROM o""")
def g1_finalized_selections(spark: SparkSession, d: str) -> DataFrame:
    """Selections with required passages, some of them missing, and a suggested order that leaves some clips out."""
    rows = written(clips(spark, d), "selection-clips")
    quotes = rows.filter(F.col("required") & (F.col("end") >= F.col("start"))).select("sel", F.concat(F.lit("q"), "pos").alias("quote"), "pos", (F.col("start") + F.col("pos") % 2).alias("start"), (F.col("end") + F.col("pos") % 2).alias("end"), "seconds", F.lit(None).cast("string").alias("role"))
    order = rows.filter("pos % 4 > 0").select("sel", (F.col("pos") * 7 % 10).alias("at"), "clip")
    return V.finalized(rows.drop("required").withColumn("role", F.lit("drop")), quotes, order, 3, 40, 4, 90.0)


_ANSWER = """an AS (SELECT DISTINCT l_orderkey AS sel FROM lineitem), ak AS (SELECT sel, unnest(['short', 'full', 'long']) AS length FROM an), od AS (SELECT l_orderkey AS sel, ['short', 'full', 'long'][l_suppkey % 3 + 1] AS length, (l_quantity::INT % 2)::INT AS v, 'c' || (l_partkey % 11) AS clip FROM lineitem),
  vs AS (SELECT DISTINCT sel, length, v FROM od), gv AS (SELECT sel, length, count(*) AS c, min(v) AS v FROM vs GROUP BY ALL), nm AS (SELECT od.* FROM od JOIN gv USING (sel, length, v))"""


@query(f"""WITH {_CLIPS}, {_ANSWER} SELECT sel, NULL AS length, 'twice' AS kind, clip FROM clips GROUP BY sel, clip HAVING count(*) > 1 UNION ALL SELECT sel, length, 'missing', NULL FROM ak WHERE NOT EXISTS (SELECT 1 FROM gv WHERE gv.sel = ak.sel AND gv.length = ak.length)
  UNION ALL SELECT sel, length, 'repeated', NULL FROM gv WHERE c > 1 UNION ALL SELECT DISTINCT sel, length, 'unknown', clip FROM nm WHERE NOT EXISTS (SELECT 1 FROM clips c WHERE c.sel = nm.sel AND c.clip = nm.clip)
  UNION ALL SELECT sel, length, 'order', NULL FROM nm GROUP BY sel, length HAVING count(*) > count(DISTINCT clip)""")
def p3_version_problems(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem")
    length = F.get(F.array(*map(F.lit, ("short", "full", "long"))), (F.col("l_suppkey") % 3).cast("int"))
    order = lines.select(F.col("l_orderkey").alias("sel"), length.alias("length"), (F.col("l_quantity").cast("int") % 2).alias("v"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("c"), F.col("l_partkey") % 11).alias("clip"))
    asked = lines.select(F.col("l_orderkey").alias("sel")).distinct().withColumn("length", F.explode(F.array(*map(F.lit, ("short", "full", "long")))))
    return V.version_problems(clips(spark, d), asked, order.select("sel", "length", "v").distinct(), order, "sel")


@query(f"""WITH {TALK_WORDS}, m AS (SELECT *, (start_ms + end_ms) / 2 AS m, lag((start_ms + end_ms) / 2) OVER o AS m0, lead((start_ms + end_ms) / 2) OVER o AS m1 FROM talk_words WINDOW o AS (PARTITION BY talk_id ORDER BY pos)),
  sp AS (SELECT conv_id AS talk_id, turn // 3 AS quote, turn % 3 AS part, turn * 4 AS ws, turn * 4 + 3 + turn % 2 AS we FROM conversations), t AS (SELECT talk_id, max(end_ms) + 700 AS total FROM talk_words GROUP BY talk_id),
  e AS (SELECT sp.talk_id, quote, part, arg_min(start_ms, pos) AS s, max(end_ms) AS e, coalesce(first(m0 ORDER BY pos), 0) AS before, arg_min(m, pos) AS first, arg_max(m, pos) AS last, last(m1 ORDER BY pos) AS after FROM sp JOIN m ON m.talk_id = sp.talk_id AND pos >= ws AND pos < we GROUP BY ALL),
  l AS (SELECT e.talk_id, quote, part, least(s + 80, first, greatest(s - 400, before)) AS start_lo, least(s + 80, first) AS start_hi, greatest(e - 80, last) AS end_lo, greatest(e - 80, last, least(e + 600, coalesce(after, total))) AS end_hi FROM e JOIN t ON t.talk_id = e.talk_id),
  c AS (SELECT *, floor((end_lo + end_hi) / 2) AS end_cut FROM l)
  SELECT talk_id, quote, part, least(start_hi, greatest(start_lo, coalesce(lag(end_cut) OVER (PARTITION BY talk_id, quote ORDER BY part), 0)))::DOUBLE AS start_lo, start_hi::DOUBLE AS start_hi, end_lo::DOUBLE AS end_lo, end_hi::DOUBLE AS end_hi, end_cut::DOUBLE AS end_cut FROM c""")
def c7_cut_limits(spark: SparkSession, d: str) -> DataFrame:
    """Limits of the cuts around the parts of quotes, with the middle as the cut at the end."""
    t = F.col("turn")
    spans = load(spark, d, "conversations").select(F.col("conv_id").alias("talk_id"), F.floor(t / 3).alias("quote"), (t % 3).alias("part"), (t * 4).alias("ws"), (t * 4 + 3 + t % 2).alias("we"))
    words = talk_words(spark, d)
    limits = V.cut_limits(spans, words, "talk_id", words.groupBy("talk_id").agg((F.max("end_ms") + 700).alias("total_ms")), 400, 600, 80)
    return V.after_previous(limits.withColumn("end_cut", F.floor((F.col("end_lo") + F.col("end_hi")) / 2).cast("double")), "talk_id")
