"""Alignment, packing, intervals, caching and streaming on small cases."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from strophe.operators import align as A
from strophe.operators import intervals as I
from strophe.operators import match as M
from strophe.operators import select as C
from strophe.plans.cache import Stages, fingerprint


def test_gap_pairs():
    assert A.gap_pairs(["anglesey"], ["angle", "sea"], 0.6) == [((0, 1), (0, 2))]
    assert A.gap_pairs(["teichert"], ["tyker"], 0.6) == []


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def plain_gap_pairs(o, a, threshold=0.6):
    """The whole table, cell by cell; of equal totals the first of: skip ours, skip theirs, 1:1, 1:2, 2:1."""
    n, m = len(o), len(a)
    score, move = {}, {}
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                score[0, 0] = 0.0
                continue
            options = [(score[i - di, j - dj], (di, dj)) for di, dj in ((1, 0), (0, 1)) if i >= di and j >= dj]
            for di, dj in ((1, 1), (1, 2), (2, 1)):
                if i >= di and j >= dj and (s := A.indel("".join(o[i - di : i]), "".join(a[j - dj : j]))) >= threshold:
                    options.append((score[i - di, j - dj] + s, (di, dj)))
            top = max(x for x, _ in options)
            score[i, j], move[i, j] = next((x, how) for x, how in options if x == top)
    found, i, j = [], n, m
    while i or j:
        di, dj = move[i, j]
        if di and dj:
            found.append(((i - di, i), (j - dj, j)))
        i, j = i - di, j - dj
    return found[::-1]


def test_gap_pairs_against_the_whole_table():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aab") for _ in range(rng.randint(1, 5)))
    for _ in range(150):
        o, a = ([word() for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert A.gap_pairs(o, a) == plain_gap_pairs(o, a)
    assert A.gap_pairs(["ab"] * 3, ["ab"] * 3, most_cells=8) == []


def test_long_gaps_are_paired_in_bounded_memory():
    """A gap of 9 million cells, whose table of scores would take 72 MB, holds some hundred rows."""
    import tracemalloc

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(3000)]
    heard = [w[:-1] + "z" for w in words]
    tracemalloc.start()
    assert A.gap_pairs(words, heard) == [((i, i + 1), (i, i + 1)) for i in range(3000)]
    assert A.common_pairs(words, words[::2] + ["x"]) == [(2 * i, i) for i in range(1500)]
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_common_pairs_are_longest():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = A.common_pairs(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in itertools.pairwise(pairs))
        assert len(pairs) == _lcs(a, b)


def plain_quotes(words, quote, starts, ends, occurrence):
    """Every window of every length, by the longest common subsequence."""
    n, slack = len(quote), max(1, round(len(quote) * 0.2))
    sim = lambda a, b: 2 * _lcs(a, b) / (len(a) + len(b))
    spans = []
    for s in range(len(words)):
        if words[s] == quote[0] or sim(quote[:3], words[s : s + 3]) >= 0.5:
            for size in range(max(1, n - slack), n + slack + 1):
                if s + size <= len(words) and sim(quote, words[s : s + size]) >= 0.8:
                    spans.append((sim(quote, words[s : s + size]) + 0.01 * ((s in starts) + (s + size in ends)), s, size))
    top = max((x[0] for x in spans), default=0)
    apart = []
    for score, s, size in sorted((x for x in spans if x[0] >= top - 1e-9), key=lambda x: (x[1], -x[0], x[2])):
        if not apart or s >= sum(apart[-1]):
            apart.append((s, size))
    at = {None: 0, -1: -1}.get(occurrence, (occurrence or 0) - 1)
    return (*(apart[at] if -len(apart) <= at < len(apart) else (None, None)), len(apart)) if apart else None


def test_quote_places_by_rare_tokens(spark):
    """Common openings alone bring no place; lengths of common subsequences are those of the plain table."""
    rng = random.Random(4)
    quotes = [["the", "of", *(f"r{i}x{k}" for k in range(12))] for i in range(30)]
    keys = M.Keys(quotes, [3] * 30)
    number = {t: i for i, t in enumerate(keys.vocabulary.to_pylist())}
    text = np.array([number.get(t, len(number)) for t in ["the", "of", "and"] * 500 + quotes[7][:11] + ["so"] * 3], dtype=np.int32)
    quote, start = keys.places(text)
    assert set(quote.tolist()) == {7} and 1500 in start.tolist() and len(start) < 30  # of 30 x 1,500 that open alike
    for _ in range(50):
        q, w = (np.array([rng.randrange(5) for _ in range(rng.randint(1, 80))]) for _ in range(2))
        row, lengths = [0] * (len(q) + 1), []
        for t in w:
            row = [0, *row[1:]]
            above = [0] * (len(q) + 1) if not lengths else last
            for i, u in enumerate(q, 1):
                row[i] = above[i - 1] + 1 if u == t else max(above[i], row[i - 1])
            last = list(row)
            lengths.append(row[-1])
        assert M.common_lengths(q, w) == lengths
    texts = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "doc long, tokens array<string>")
    assert M.found_quotes(texts, spark.createDataFrame([], "quote long, q array<string>")).count() == 0


def test_quotes_against_every_window(spark):
    rng = random.Random(12)
    texts = [[rng.choice("abcdefgh") if rng.random() < 0.6 else "no" for _ in range(rng.randint(0, 60))] for _ in range(25)]
    quotes = [(texts[i % 25][k : k + m] or ["zz"], rng.choice([None, None, 1, 2, -1])) for i in range(40) for k, m in [(rng.randint(0, 30), rng.randint(1, 16))]]
    quotes = [([w if rng.random() < 0.9 else "x" for w in q], o) for q, o in quotes] + [(["no"] * 14 + ["a", "b", "c"], None)]
    texts.append(["no"] * 14 + ["a", "x", "y", "z"])
    edges = [(sorted(rng.sample(range(61), 6)), sorted(rng.sample(range(61), 6))) for _ in texts]
    docs = spark.createDataFrame([(i, t, *e) for i, (t, e) in enumerate(zip(texts, edges))], "doc long, tokens array<string>, starts array<int>, ends array<int>")
    asked = spark.createDataFrame([(i, q, o) for i, (q, o) in enumerate(quotes)], "quote long, q array<string>, occurrence int")
    got = {(r["doc"], r["quote"]): (r["start"], r["length"], r["occurrences"]) for r in M.found_quotes(docs, asked).collect()}
    want = {(i, j): plain_quotes(t, q, *edges[i], o) for i, t in enumerate(texts) for j, (q, o) in enumerate(quotes)}
    assert got == {k: v for k, v in want.items() if v} and got[25, 40][2] == 1
    bare = {(r["doc"], r["quote"]): (r["start"], r["length"], r["occurrences"]) for r in M.found_quotes(docs.drop("starts", "ends"), asked.drop("occurrence")).collect()}
    assert bare == {k: v for i, t in enumerate(texts) for j, (q, _) in enumerate(quotes) if (v := plain_quotes(t, q, (), (), None)) for k in [(i, j)]}


def test_quotes_are_refused(spark):
    """Not found, asked for too often, outside every sentence, and two that share a sentence."""
    text = "a b c d e f g h i j k l m n o p a b c d x y z w".split()
    sentences = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 4, 9), (1, 2, 9, 12), (1, 3, 16, 20)], "doc long, sentence int, word_start int, word_end int")
    quotes = [(1, 1, "a b c d", 2), (1, 2, "e f g h", None), (1, 3, "i j k l", None), (1, 4, "a b c d", 3), (1, 5, "q r s t", None), (1, 6, "m n o p", None), (1, 7, "b c d", -1)]
    asked = spark.createDataFrame([(d, q, t.split(), o) for d, q, t, o in quotes], "doc long, quote long, q array<string>, occurrence int")
    found = M.found_quotes(spark.createDataFrame([(1, text)], "doc long, tokens array<string>"), asked.drop("doc"))
    got = {r["quote"]: (r["first_sentence"], r["last_sentence"], r["refusal"], r["other"]) for r in M.matched_quotes(asked, found, sentences).collect()}
    assert got == {
        1: (3, 3, None, None), 2: (1, 1, None, None), 3: (1, 2, "shared", 2), 4: (None, None, "occurrence", None), 5: (None, None, "not found", None), 6: (None, None, "outside", None), 7: (3, 3, "shared", 1),
    }


def test_gaps_of_nested_intervals(spark):
    rows = [(1, 10, 90), (1, 20, 30), (1, 25, 95), (1, 97, 99), (2, 0, 5), (2, 5, 7)]
    totals = spark.createDataFrame([(1, 120), (2, 7), (3, 4)], "k int, total int")
    found = I.gaps(spark.createDataFrame(rows, "k int, s int, e int"), ["k"], "s", "e", totals, "total").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 10), (1, 95, 97), (1, 99, 120), (3, 0, 4)]


def test_repair_windows_widen_and_merge(spark):
    """Edges move to the segments that touch them, within the limit; overlaps merge; segments without words don't count."""
    holes = spark.createDataFrame([(1, 100, 200, 30), (1, 215, 260, 9), (1, 900, 950, 5), (2, 0, 10, 1), (3, 50, 60, 2)], "k int, lo int, hi int, speech int")
    segments = [(1, 60, 110, 70, 100), (1, 190, 220, 200, 215), (1, 100, 1500, 800, 900), (1, 940, 960, 950, 955), (2, 5, 40, None, None), (3, 0, 70, 51, 59)]
    found = I.repair_windows(holes, spark.createDataFrame(segments, "k int, s int, e int, first int, last int"), ["k"], 100, 70).collect()
    assert sorted(map(tuple, found)) == [(1, 100, 260, 39, 60, 260), (1, 900, 950, 5, 900, 960), (2, 0, 10, 1, 0, 10), (3, 50, 60, 2, 50, 60)]


def test_solid_needs_three():
    link = lambda i, j: A.Link(range(i, i + 1), range(j, j + 1), True)
    assert A.solid([link(0, 0), link(1, 1), link(3, 3)]) == []
    assert len(A.solid([link(0, 0), link(1, 1), link(2, 2), link(4, 3)])) == 3


def test_alignment_invariants():
    words = "The quick brown fox jumps over the lazy dog and runs away from Anglesey today".split()
    said = [("the", 0.0, 0.2), *((w, 0.3 * i + 0.3, 0.3 * i + 0.5) for i, w in enumerate(words[1:13])), ("angle", 5.0, 5.2), ("sea", 5.3, 5.5), ("uh", 5.6, 5.7), ("today", 6.0, 6.3)]
    tokens = lambda ws: [(w.lower(), i) for i, w in enumerate(ws)]
    out, told = A.aligned(words, [0] * len(words), tokens(words), said, tokens([w for w, _, _ in said]), 7.0)
    assert [x.flag for x in out if x.text == "Anglesey"] == ["fuzzy"] and [x.text for x in out if x.flag == "asr_only"] == ["uh"]
    assert all(x.start <= y.start and y.start <= y.end for x, y in itertools.pairwise(out))
    assert told["matched"] == len(words) - 1 and told["unspoken"] == 0


def test_best_parts_against_all_splits():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(2, 8)
        starts = list(itertools.accumulate(rng.uniform(0.5, 1.5) for _ in range(n)))
        ends = [s + 0.4 for s in starts]
        costs = [0.0, *(rng.choice([-1.0, 0.2, 2.5]) for _ in range(n - 1))]
        limit = (ends[-1] - starts[0]) / rng.choice([1.5, 2.2])
        got = C.best_parts(starts, ends, costs, limit)
        options = []
        for k in range(math.ceil((ends[-1] - starts[0]) / limit), n + 1):
            for cuts in itertools.combinations(range(1, n), k - 1):
                spans = list(itertools.pairwise((0, *cuts, n)))
                if all(ends[b - 1] - starts[a] <= limit for a, b in spans):
                    ideal = (ends[-1] - starts[0]) / k
                    options.append((k, sum((costs[a] if a else 0) + 2 * ((ends[b - 1] - starts[a] - ideal) / ideal) ** 2 for a, b in spans), spans))
            if options:
                break
        if options:
            cost = sum((costs[a] if a else 0) + 2 * ((ends[b - 1] - starts[a] - (ends[-1] - starts[0]) / len(got)) / ((ends[-1] - starts[0]) / len(got))) ** 2 for a, b in got)
            assert len(got) == options[0][0] and abs(cost - min(o[1] for o in options)) < 1e-9


def test_grouped_against_all_cuts():
    rng = random.Random(5)
    for _ in range(40):
        n, slots = rng.randint(4, 8), rng.randint(2, 3)
        seconds, roles = [rng.uniform(1, 9) for _ in range(n)], [rng.choice(["hook", "build", "outro"]) for _ in range(n)]
        mean = sum(seconds) / slots

        def cost(cuts):
            spans = list(itertools.pairwise((*cuts, n)))
            return sum((sum(seconds[a:b]) - mean) ** 2 / mean**2 + 0.5 * sum(roles[i] == "hook" and g != 0 or roles[i] == "outro" and g != slots - 1 for i in range(a, b)) for g, (a, b) in enumerate(spans))

        best = min(cost((0, *c)) for c in itertools.combinations(range(1, n), slots - 1))
        assert abs(cost(tuple(C.grouped(seconds, roles, slots))) - best) < 1e-9


def test_merge_and_join(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 9, 9), (1, 2, 3)], "k int, s int, e int")
    assert sorted((r["s"], r["e"]) for r in I.merged(df, ["k"], "s", "e").collect()) == [(0, 8), (9, 9)]
    right = spark.createDataFrame([(1, 4, 20), (1, 100, 101)], "k int, a int, b int")
    joined = I.overlap_join(df, right, ["k"], ("s", "e"), ("a", "b"), 3)
    assert sorted((r["s"], r["a"]) for r in joined.collect()) == [(0, 4), (5, 4), (9, 4)]


def test_stages_run_once(spark, tmp_path):
    stages = Stages(spark, f"file://{tmp_path}")
    make = lambda: spark.range(3)
    _, key, fresh = stages.run("a", 1, {"x": "1"}, {}, make)
    again = stages.run("a", 1, {"x": "1"}, {}, make)
    assert fresh and not again[2] and again[1] == key == fingerprint("a", 1, {"x": "1"}, {}) and again[0].count() == 3
    assert stages.run("a", 2, {"x": "1"}, {}, make)[2]


def test_streaming(spark, tmp_path):
    from strophe.streaming import talks

    rows = [(1, f"2024-01-01 00:{m:02d}:00", 1.0) for m in (0, 5, 50)] + [(2, "2024-01-01 00:01:00", 2.0)]
    spark.createDataFrame(rows, "k long, ts string, v double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, ts timestamp, v double").parquet(f"{tmp_path}/in")
    talks.append_ledger(stream, f"{tmp_path}/ledger", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 4
    q = talks.sessions(stream, "k", "ts").writeStream.format("memory").queryName("found").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("found").count() == 3
    q = talks.pauses(stream, "k", "ts", 600).writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["k"], (r["hi"] - r["lo"]).total_seconds()) for r in spark.table("gaps").collect()] == [(1, 2700.0)]


def test_pauses_in_one_pass(spark):
    """As gaps with an end some way behind the last interval; the plan of the query sorts words by time once, and joins no ends to them."""
    from strophe.plans import QUERIES

    rows = [(1, 10, 90), (1, 20, 30), (1, 25, 95), (1, 97, 99), (2, 0, 5), (2, 5, 7), (3, 4, 9), (3, 4, 9), (4, 3, 50), (4, 5, 6)]
    df = spark.createDataFrame(rows, "k int, s int, e int")
    totals = df.groupBy("k").agg((F.max("e") + 5).alias("total"))
    found = sorted(map(tuple, I.pauses(df, ["k"], "s", "e", 5).collect()))
    assert found == sorted(map(tuple, I.gaps(df, ["k"], "s", "e", totals, "total").collect()))
    assert found == [(1, 0, 10), (1, 95, 97), (1, 99, 104), (2, 7, 12), (3, 0, 4), (3, 9, 14), (4, 0, 3), (4, 50, 55)]
    assert sorted(map(tuple, I.pauses(df, ["k"], "s", "e", 0).collect())) == [f for f in found if f[2] - f[1] != 5]
    plan = QUERIES["j17_find_holes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
