"""Songs built from parts, edits of a range, versions, reviews, probes: literal cases and plain Python."""

import json
import random

from pyspark.sql import functions as F

from strophe.functions.text import one_decimal
from strophe.operators import building as B
from strophe.operators import ledger
from strophe.operators import runs as R
from strophe.operators import versions as V


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_one_decimal_as_python_prints_it(spark):
    rng = random.Random(3)
    xs = [k / 1000 for k in range(0, 20_000, 10)] + [k / 1e6 for k in range(50_000, 9_000_000, 50_000)] + [rng.uniform(-1e6, 1e6) for _ in range(500)] + [0.25, 0.75, 2.5, 0.05, 0.15, 999.95]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", one_decimal(F.col("x")).alias("t")).collect()
    assert [r.t for r in got if r.t != f"{r.x:.1f}"] == []
    sizes = spark.createDataFrame([(999,), (1250,), (1350,), (2_250_000,)], "b long").select(ledger.bytes_text(F.col("b")).alias("t"))
    assert [r.t for r in sizes.collect()] == ["999 B", "1.2 KB", "1.4 KB", "2.2 MB"]


def test_arc_parts_use_the_first_slots_and_the_last(spark):
    arc = spark.createDataFrame([(1, i, "speech_bed" if i % 2 else "drop", 8) for i in range(9)], "song int, pos int, role string, bars int")
    for n, filled in ((1, [1]), (2, [1, 7]), (3, [1, 3, 7]), (4, [1, 3, 5, 7])):
        groups = spark.createDataFrame([(1, g, [f"c{g}"]) for g in range(n)], "song int, g int, clips array<string>")
        got = rows(B.arc_parts(arc, groups, ["song"]), "pos", "clips")
        assert [p for p, _ in got] == sorted([0, 2, 4, 6, 8, *filled])
        assert [c for p, c in got if p in filled] == [[f"c{g}"] for g in range(n)]


def test_bed_chords(spark):
    one = spark.range(1).select(
        B.bed_chords(F.array(F.lit("Am"), F.lit("F")), F.lit(5), F.lit(8.0)).alias("led"),
        B.bed_chords(F.array(F.lit("Am"), F.lit("F")), F.lit(1), F.lit(8.0)).alias("short"),
        B.bed_chords(F.array(F.lit("Am")), F.lit(2), F.lit(3.5)).alias("one"),
    ).first()
    assert (one.led, one.short, one.one) == (["Am", "Am", "Am", "F", "Am"], ["Am"], ["Am", "Am"])


def test_a_role_does_not_repeat_its_progression(spark):
    names = ["C", "Dm", "Em", "F", "G", "Am", "Bdim"]
    triads = [[0, 4, 7], [2, 5, 9], [4, 7, 11], [5, 9, 0], [7, 11, 2], [9, 0, 4], [11, 2, 5]]
    flat = [1.0] * 12
    data = [(1, n, role, 4, "major", triads, names, flat) for n, role in ((1, "drop"), (2, "outro"), (3, "drop"), (4, "drop"), (5, "verse"))]
    df = spark.createDataFrame(data, "song int, n int, role string, bars int, mode string, triads array<array<int>>, names array<string>, weights array<double>")
    got = {r.n: (r.degrees, r.chords) for r in B.section_chords(df).collect()}
    assert got[1][0] == [1, 5, 6, 4] and got[3][0] == [6, 4, 1, 5] and got[4][0] == [1, 5, 6, 4]
    assert got[1][1] == ["C", "G", "Am", "F"] and got[2][1] == ["F", "F", "G", "C"] and 5 not in got


SECTION = "song int, n int, role string, bars int, clip string, silent boolean, rest boolean, shape string, main string, ending string"


def test_answers_occurrences_and_endings(spark):
    def song(k, ending):
        return [
            (k, 1, "drop", 4, None, False, False, "flat", "c9", ending), (k, 2, "speech_bed", 2, "c1", False, False, "flat", "c9", ending), (k, 3, "gap", 1, None, True, False, "flat", "c9", ending),
            (k, 4, "drop", 4, None, False, False, "rise", "c9", ending), (k, 5, "drop", 4, None, False, False, "fall", "c9", ending), (k, 6, "speech_bed", 2, "c2", False, k == 3, "flat", "c9", ending),
        ]

    df = spark.createDataFrame(song(1, "stop") + song(2, "fade") + song(3, "stop"), SECTION)
    noted = spark.createDataFrame([("c9",), ("c1",)], "clip string")
    got = {(r.song, r.n): r for r in B.arranged(df, noted, 120.0, ("drop",)).collect()}
    assert [got[1, n].start_bar for n in range(1, 7)] == [0, 4, 6, 7, 11, 15]
    assert [got[1, n].occurrence for n in range(1, 7)] == ["first", None, None, None, "last", None]
    assert [got[1, n].answers for n in range(1, 7)] == ["c9", None, None, "c1", None, None]
    assert [got[1, n].replay for n in (1, 4)] == [None, "c1"]
    assert [got[1, n].shape for n in (5, 6)] == ["flat", "flat"] and got[1, 6].home  # the song closes on a passage
    assert [got[2, n].shape for n in (5, 6)] == ["fall", "fall"] and not got[2, 6].home
    assert got[3, 5].shape == "flat" and got[3, 5].home and not got[3, 6].home  # the passage plays alone


def test_pieces_of_an_edit(spark):
    chunks = spark.createDataFrame([(1, 0, 10_000), (1, 10_000, 20_000), (1, 20_000, 50_000)], "song int, start_ms long, end_ms long")
    cases = {(12_000, 30_000): [(12_000, 20_000), (20_000, 30_000)], (18_000, 30_000): [(18_000, 30_000)], (12_000, 22_000): [(12_000, 22_000)], (9_000, 11_000): [(0, 10_000), (10_000, 20_000)], (12_000, 13_000): [(10_000, 20_000)]}
    for (a, b), want in cases.items():
        got = B.regenerated_pieces(chunks, spark.createDataFrame([(1, a, b)], "song int, from_ms long, to_ms long"))
        assert rows(got, "start_ms", "end_ms") == want
    kept = spark.range(1).select(*(B.kept_slices(F.lit(0).cast("long"), F.lit(e).cast("long")).alias(f"e{e}") for e in (40, 50, 120_000, 250_001))).first()
    spans = lambda xs: [(x.start_ms, x.end_ms) for x in xs]
    assert (spans(kept.e40), spans(kept.e50), spans(kept.e120000)) == ([], [(0, 50)], [(0, 120_000)])
    assert spans(kept.e250001) == [(0, 83_334), (83_334, 166_667), (166_667, 250_001)]


def test_inpaint_problems(spark):
    plan = spark.createDataFrame([(1, 0, 40, None), (1, 40, 2_000, 3), (1, 2_000, 100_000, None), (2, 0, 3_000, 1)], "song int, start_ms long, end_ms long, main_n int")
    assert rows(B.inpaint_problems(plan), "song", "chunks", "too_many", "bad_kept", "bad_made") == [(1, 3, False, 1, 1), (2, 1, False, 0, 0)]


def test_required_passages(spark):
    clips = spark.createDataFrame([(1, "c1", 1, 3, 0.5, "hook"), (1, "q2", 5, 6, 0.4, "drop")], "sel int, clip string, start int, end int, score double, role string")
    quotes = spark.createDataFrame([(1, "q1", 1, 1, 3, "hook"), (1, "q2", 2, 7, 9, None), (1, "q3", 3, 8, 8, "outro")], "sel int, quote string, pos int, start int, end int, role string")
    assert rows(V.required_for(clips, quotes, ["sel"]).filter("quote is not null"), "clip", "quote") == [("c1", "q1")]
    added = V.with_required(clips, quotes, ["sel"]).filter("added")
    assert rows(added, "clip", "start", "end", "score", "role") == [("q2r", 7, 9, 1.0, "build"), ("q3", 8, 8, 1.0, "outro")]


def test_version_problems(spark):
    clips = spark.createDataFrame([(1, "c1"), (1, "c1"), (1, "c2")], "a int, clip string")
    asked = spark.createDataFrame([(1, x) for x in ("short", "full", "long")], "a int, length string")
    order = spark.createDataFrame([(1, "short", 0, 0, "c1"), (1, "short", 0, 1, "c9"), (1, "short", 0, 2, "c1"), (1, "full", 0, 0, "c2"), (1, "full", 1, 0, "c8")], "a int, length string, v int, pos int, clip string")
    got = V.version_problems(clips, asked, order.select("a", "length", "v").distinct(), order, "a").collect()
    assert sorted((r.kind, r.length or "", r.clip or "") for r in got) == [("missing", "long", ""), ("order", "short", ""), ("repeated", "full", ""), ("twice", "", "c1"), ("unknown", "short", "c9")]


def test_cut_limits(spark):
    words = spark.createDataFrame([(1, i, 1000 * i, 1000 * i + 400) for i in range(6)], "t int, pos int, start_ms long, end_ms long")
    spans = spark.createDataFrame([(1, 0, 0, 0, 2), (1, 0, 1, 2, 6)], "t int, quote int, part int, ws int, we int")
    got = V.cut_limits(spans, words, "t", spark.createDataFrame([(1, 5700)], "t int, total_ms long"), 900, 900, 100)
    assert rows(got, "part", "start_lo", "start_hi", "end_lo", "end_hi") == [(0, 0.0, 100.0, 1300.0, 2200.0), (1, 1200.0, 2100.0, 5300.0, 5700.0)]
    cut = V.after_previous(got.withColumn("end_cut", F.when(F.col("part") == 0, 1700.0).otherwise(5500.0)), "t")
    assert rows(cut, "part", "start_lo") == [(0, 0.0), (1, 1700.0)]


def plain_review(ids, commands):
    kept, dropped, refused = list(ids), [], 0
    for name, clips, at in commands:
        c = clips[0] if clips else None
        if name == "drop" and len(clips) == 1 and c in kept:
            kept.remove(c)
            dropped.append(c)
        elif name == "keep" and len(clips) == 1 and c in dropped:
            dropped.remove(c)
            kept.append(c)
        elif name == "move" and len(clips) == 1 and c in kept and at is not None and 1 <= at <= len(kept):
            kept.remove(c)
            kept.insert(at - 1, c)
        elif name == "order" and sorted(clips) == sorted(kept):
            kept = list(clips)
        else:
            refused += 1
    return kept, dropped, refused


def test_reviews_against_plain_lists(spark):
    rng = random.Random(8)
    cases = []
    for k in range(120):
        ids = [f"c{i}" for i in range(rng.randint(1, 5))]
        commands = [(rng.choice(["drop", "keep", "move", "order", "x"]), rng.sample(ids, rng.choice([1, 1, len(ids)])) if rng.random() < 0.9 else ["zz"], rng.choice([None, 0, 1, 2, 5])) for _ in range(rng.randint(0, 9))]
        cases.append((k, ids, commands))
    df = spark.createDataFrame(cases, "k int, ids array<string>, cs array<struct<name:string,clips:array<string>,at:int>>")
    got = {r.k: r.r for r in df.select("k", R.reviewed(F.col("ids"), F.col("cs")).alias("r")).collect()}
    for k, ids, commands in cases:
        assert (list(got[k].kept), list(got[k].dropped), got[k].refused) == plain_review(ids, commands)


def test_probes(spark):
    audio = {"codec_type": "audio", "codec_name": "mp3", "sample_rate": "48000", "channels": 2, "bit_rate": "N/A", "duration": "3.5"}
    cover = {"codec_type": "video", "disposition": {"attached_pic": 1}}
    texts = [json.dumps({"streams": [cover, audio], "format": {"bit_rate": "128000"}}), json.dumps({"streams": [{"codec_type": "video"}, audio], "format": {"duration": "9"}}), json.dumps({"streams": [cover]}), "{}", None]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(R.probed(F.col("t")).alias("p")).collect()]
    assert (got[0].format_name, got[0].duration_s, got[0].has_video, got[0].sample_rate, got[0].bit_rate) == ("unknown", 3.5, False, 48000, 128000)
    assert (got[1].duration_s, got[1].has_video, got[1].bit_rate) == (9.0, True, None)
    assert got[2:] == [None, None, None]


def test_styles(spark):
    one = spark.range(1).select(
        R.style_faults(F.array(*map(F.lit, ("warm", "Choir pads", "x" * 81, "invoice", "narrated")))).alias("f"),
        R.deduped(F.array(*map(F.lit, (" Calm ", "calm", "", "Warm")))).alias("d"),
        R.chord_words(F.array(*map(F.lit, ("Am", "Am", "F", "Am", "F"))), F.lit(True)).alias("c"),
        R.chord_words(F.array(*map(F.lit, ("Am", "Am"))), F.lit(False)).alias("rest"),
        R.chord_words(F.array().cast("array<string>"), F.lit(False)).alias("none"),
    ).first()
    assert (one.f.many, one.f.long, one.f.voiced) == (True, 1, ["choir", "narrated"])
    assert (one.d, one.c, one.rest, one.none) == (["Calm", "Warm"], ["slow chord changes Am - F"], ["harmony resting on Am"], [])


def test_finalized_selection(spark):
    clips = spark.createDataFrame(
        [(1, 0, "c1", 1, 3, 0.9, 10.0), (1, 1, "c2", 2, 5, 0.8, 10.0), (1, 2, "c3", 7, 8, 1.4, 10.0), (1, 3, "c4", 20, 21, 0.9, 10.0), (1, 4, "c4", 24, 25, 0.9, 10.0), (1, 5, "c5", 13, 14, 0.3, 10.0), (1, 6, "c6", 16, 15, 0.9, 10.0), (1, 7, "c7", 30, 31, 0.9, 99.0)],
        "sel int, pos int, clip string, start int, end int, score double, seconds double",
    ).withColumn("role", F.lit("drop"))
    quotes = spark.createDataFrame([(1, "q0", 0, 5, 6, 99.0, None), (1, "q1", 1, 10, 11, 10.0, "hook"), (1, "c3", 2, 7, 8, 10.0, None)], "sel int, quote string, pos int, start int, end int, seconds double, role string")
    order = spark.createDataFrame([(1, 0, "c3"), (1, 1, "c1"), (1, 2, "c3"), (1, 3, "c2")], "sel int, at int, clip string")
    got = V.finalized(clips, quotes, order, 3, 40, 9, 900.0).collect()
    assert [r.clip for r in sorted(got, key=lambda r: r.time_pos)] == ["c1", "q0", "c3", "q1", "c5"]
    assert [r.clip for r in sorted(got, key=lambda r: r.play_pos)] == ["q0", "c3", "c1", "q1", "c5"]
    assert {r.clip: r.score for r in got}["c3"] == 1.0 and {r.clip for r in got if r.added} == {"q0", "q1"}
    few = V.finalized(clips, quotes, order, 3, 40, 4, 900.0).collect()
    assert {r.clip for r in few} == {"q0", "q1", "c3", "c1"}  # the least score goes first, required ones stay
