"""What the plans of queries that open rows shuffle and broadcast, and their results on odd inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strophe.operators import align as A
from strophe.operators import building as B
from strophe.operators import cuts as C
from strophe.operators import match as M
from strophe.operators import mixing as X
from strophe.operators import select as C2
from strophe.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stem_broadcasts_no_samples(spark):
    plan = plan_of(QUERIES["z5_stems"](spark, SMALL))
    assert "SortMergeJoin [clip" in plan and "BroadcastHashJoin [clip" not in plan


def test_stem_over_pieces_and_blocks(spark, monkeypatch):
    """Clips of several pieces over several blocks, with gaps in them; an end past the grid is cut."""
    monkeypatch.setattr(C, "PIECE", 3)
    samples = {"a": {i: float(i) for i in range(10) if i != 4}, "b": {0: -1.0, 7: -2.0}}
    placed = [(1, "a", 0), (1, "b", 2), (1, "a", 8), (2, "b", 5)]
    frames = {1: 13, 2: 6}
    clips = spark.createDataFrame([(c, i, x) for c, s in samples.items() for i, x in s.items()], "clip string, i int, x double")
    got = C.stem(spark.createDataFrame(placed, "song long, clip string, start long"), clips, spark.createDataFrame([*frames.items()], "song long, frames long"), "song", "clip", "i", "x", block=4)
    want = {}
    for song, clip, start in sorted(placed, key=lambda p: (p[2], p[1])):
        want.update({(song, start + i): x for i, x in samples[clip].items() if start + i < frames[song]})
    assert sorted(map(tuple, got.collect())) == sorted((s, i, x) for (s, i), x in want.items())


EXCHANGES = {"z9_energy_curve": 2, "l10_timeline_strip": 1, "w17_late_entries": 1, "w19_passage_curve": 2, "c8_cut_quotes": 8}


@pytest.mark.parametrize("name", EXCHANGES)
def test_opened_rows_are_not_dealt_again(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", plan)) <= EXCHANGES[name]


def test_paged_cuts_equal_those_by_buckets(spark, monkeypatch):
    """Streams with gaps and without samples, searches over page edges, before the first sample, past the last, and empty ones."""
    monkeypatch.setattr(C, "PAGE_BUCKETS", 1)
    heard = [(s, i, float((i * i * 7 + s) % 5) / 3) for s in (0, 1) for i in range(100) if (i + s) % 11 and not 40 <= i < 60]
    levels = spark.createDataFrame(heard, "stream long, i long, level double")
    rows = []
    for quote in range(12):
        for part in range(6):
            at = (quote * 13 + part * 17) % 115 - 6
            rows.append((quote, part, quote % 3, at, at - quote % 5, at + part % 4, at + 4, at + 2 + part % 2, at + quote))
    parts = spark.createDataFrame(rows, "quote long, part int, stream long, start_at long, start_lo long, start_hi long, end_at long, end_lo long, end_hi long")
    cut = lambda **how: sorted(map(tuple, C.cut_quotes(parts, levels, "quote", "stream", "i", 2, bucket=16, **how).collect()))
    want = cut()
    assert len(want) > 20 and cut(longest=12) == want
    with pytest.raises(Exception, match="longer than a page"):
        C.cut_quotes(parts.withColumn("end_hi", parts.end_hi + 100), levels, "quote", "stream", "i", 2, bucket=16, longest=12).collect()


def test_looped_notes_are_counted_before_they_are_laid(spark):
    """Notes of one start cut to the same length meet; the plan groups no laid rows (they held gigabytes and were spilled)."""
    notes = spark.createDataFrame([(0, s, b) for s in (0.0, 2.5, 3.0) for b in (1.0, 1.0, 2.0, 4.0, None)], "phrase int, start double, beats double")
    spans = spark.createDataFrame([(1, n, 0, float(n), n + size) for n, size in enumerate((0.0, 0.5, 4.0, 6.0, 9.5))], "song long, n int, phrase int, from_beat double, to_beat double")
    want = X.looped_notes(notes, spans, 4).groupBy("song", "n", "at", "beats").count()
    got = X.looped_counts(notes, spans, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert not re.search(r"HashAggregate\(keys=\[song", plan_of(QUERIES["l13_looped_notes"](spark, SMALL)))
    with pytest.raises(Exception, match="outside the loop"):
        X.looped_counts(notes.withColumn("start", notes.start + 2), spans, 4).collect()


def test_quotes_of_a_text_are_searched_in_it_alone(spark, monkeypatch):
    """As the search of all quotes in all texts, kept to a quote's own; no quote comes to the driver, and blocks may be small."""
    texts = [(n, [str((i * i + n) % 7) for i in range(n * 9)] or None) for n in range(6)]
    docs = spark.createDataFrame(texts, "doc long, tokens array<string>")
    rows = [(n, (n + k // 5) % 7, k, (["0", "1", "x"] if k == 3 else (t or ["1"])[k * 2 : k * 2 + k % 4 * 3]), k % 3 or None) for n, t in texts for k in range(6)]
    quotes = spark.createDataFrame(rows, "own long, doc long, k int, q array<string>, occurrence int").selectExpr("doc", "struct(own, k) AS quote", "q", "occurrence")
    want = M.found_quotes(docs, quotes.drop("doc")).join(quotes.select("doc", "quote"), ["doc", "quote"], "left_semi").collect()
    monkeypatch.setattr(M, "MOST_QUOTE_BYTES", 0)
    monkeypatch.setattr(M, "CELLS", 12)
    got = M.found_quotes(docs, quotes).collect()
    assert len(want) > 5 and sorted(map(str, got)) == sorted(map(str, want))


def test_alignment_without_skipped_lines_links_once(monkeypatch):
    """Few pairs are compared directly, with what counts of letters find; official words of a talk whose lines were all said are linked once."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))
    for _ in range(200):
        xs, ys = (sorted({word() for _ in range(rng.randint(1, 6))}) for _ in range(2))
        few, gap = A.alike(xs, ys, 0.6), A.gap_pairs(xs[:1], ys[:1])
        with monkeypatch.context() as m:
            m.setattr(A, "FEW_PAIRS", 0)
            assert A.alike(xs, ys, 0.6) == few
            assert gap == [((0, 1), (0, 1))] * (A.indel(xs[0], ys[0]) >= A.FUZZY)
    calls, links = [], A.links
    monkeypatch.setattr(A, "links", lambda *x: calls.append(1) or links(*x))
    words = [f"w{i}" for i in range(24)]
    args = [(w, i) for i, w in enumerate(words)]
    said = [(w, i * 1.0, i + 0.5) for w, i in args]
    out, told = A.aligned(words, [i // 12 for i in range(24)], args, said, args, 24.0)
    assert told["matched"] == 24 and len(calls) == 1
    A.aligned([*words, *"xyz"], [i // 12 for i in range(27)], [*args, ("x", 24), ("y", 25), ("z", 26)], said, args, 24.0)
    assert len(calls) == 3


def test_fits_go_by_plain_numbers(spark):
    """A song is fitted on the numbers of its Arrow batch, not on nested pandas objects; songs that can't reach the span come nearest to it."""
    parts = [(1, 1, 8, 0.5), (1, 2, 16, 0.1), (2, 1, 1, 0.3), (3, 1, 16, 0.9), (3, 2, 16, 0.2), (3, 3, 16, 0.4)]
    df = C2.fitted(spark.createDataFrame(parts, "song long, n int, bars int, energy double"), "song", 24, 32)
    assert "MapInArrow" in plan_of(df) and "MapInPandas" not in plan_of(df)
    got = {r["song"]: (r["total"], r["choice"]) for r in df.collect()}
    assert got[1] == (24, [8, 16]) and got[2] == (2, [2]) and got[3][0] in range(24, 33) and sum(got[3][1]) == got[3][0]


def test_finalized_selections_make_their_clips_once(spark):
    """The clips that several steps read are written: the plan of the rest numbers no line of an order again."""
    from strophe.plans import QUERIES

    plan = QUERIES["g1_finalized_selections"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and plan.count("Join") <= 3


def test_sections_without_answers_are_dealt_by_song(spark):
    """Sections against a plain reading; where clips are too many to broadcast, those that answer nothing meet in no task, and songs are dealt once."""
    rng, rows, want = random.Random(4), [], {}
    noted = {"a", "main1", "main4"}
    for song in range(60):
        heard, asked, beds, main, ending = None, False, rng.random(), f"main{song % 5}", ("fade", "stop")[song % 2]
        made = []
        for n in range(1, rng.randint(2, 9)):
            clip = rng.choice("abc") if rng.random() < beds / 2 else None
            made.append((song, n, rng.choice(("drop", "build", "outro")), rng.randint(1, 4), clip, clip is None and rng.random() < 0.4, clip is not None and rng.random() < 0.5, rng.choice(("fall", "rise")), main, ending))
        loud = [r for r in made if not r[5] and not r[6]]
        music = [r[1] for r in loud if r[4] is None]
        for r in made:
            _, n, role, _, clip, silent, *_ = r
            same = [x[1] for x in made if x[2] == role]
            occurrence = {same[0]: "first", same[-1]: "last"}.get(n) if clip is None and len(same) > 1 else None
            answer = None
            if clip is None and not silent and not asked:
                asked, answer = True, heard or main
            replay = heard if clip is None and role == "drop" else None
            if clip is not None:
                heard, asked = clip, False
            end, shape = bool(loud) and n == loud[-1][1], r[7]
            if end and ending == "fade":
                shape = "fall"
            elif ending != "fade" and shape == "fall" and (end or loud and loud[-1][4] is not None and n in music[-1:]):
                shape = "flat"
            want[song, n] = (occurrence, replay, answer if answer in noted else None, shape, end and ending != "fade")
        rows += made
    sections = spark.createDataFrame(rows, "song long, n int, role string, bars int, clip string, silent boolean, rest boolean, shape string, main string, ending string")
    known = spark.createDataFrame([(c,) for c in sorted(noted)] * 2, "clip string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = B.arranged(sections, known, 120.0, ("drop",))
        plan = plan_of(df)
        got = {(r["song"], r["n"]): (r["occurrence"], r["replay"], r["answers"], r["shape"], r["home"]) for r in df.collect()}
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == want and sum(v[2] is not None for v in want.values()) > 20
    assert plan.count("Exchange hashpartitioning(") == 3 and plan.count("Sort [") == 4 and max(sizes) < 0.6 * len(rows)


def test_edits_of_a_song_come_from_its_own_rows(spark):
    """As the joined steps, over songs with short, missing, silent and resting ranges; sections are dealt once and joined to nothing."""
    rng, rows = random.Random(9), []
    for song in range(150):
        at = 0
        for n in range(1, rng.randint(2, 8)):
            rest, size = rng.random() < 0.2, rng.choice((0, 500, 2_000, 2_999, 3_000, 9_000, 70_000, 300_000))
            rows.append((song, n, at, at if rest else at + size, rng.random() < 0.2, rest))
            at = rows[-1][3]
    rows += [(None, 2, 0, 5_000, False, False), (500, 2, 0, 4_000, False, False), (500, 3, 3_500, 9_000, False, False), (500, 4, 1_000, 20_000, False, False), (501, 1, 0, 9_000, False, False)]
    bounds = spark.createDataFrame(rows, "song long, n int, start_ms long, end_ms long, silent boolean, rest boolean")
    chunks = bounds.filter("end_ms > start_ms").select("song", "start_ms", "end_ms")
    ranges = bounds.filter("n between 2 and 3").groupBy("song").agg(F.min("start_ms").alias("from_ms"), F.max("end_ms").alias("to_ms"))
    pieces = B.with_main_section(B.regenerated_pieces(chunks, ranges), bounds)
    want = B.inpaint_plan(pieces, bounds.groupBy("song").agg(F.max("end_ms").alias("total_ms")))
    got = B.section_edits(bounds, F.col("n").between(2, 3))
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 300
    plan = plan_of(QUERIES["l7_inpaint_plan"](spark, SMALL))
    assert "Join" not in plan and plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
