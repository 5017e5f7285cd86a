"""Chunk layout, bar fits and note pieces: every row against plain Python or brute force on small cases."""

import itertools
import math
import random
import statistics

from strophe.operators import mixing as X
from strophe.operators import select as C
from strophe.operators import timeline as L

SECTION = "song long, n int, role string, bars int, silent boolean, rest boolean, clip string, energy double, shape string"


def song(rows, k=1):
    return [(k, n, role, bars, silent, rest, None, 0.5, "flat") for n, (role, bars, silent, rest) in enumerate(rows, 1)]


def test_layout_of_literal_songs(spark):
    bar = 2_000  # at 120 bpm
    cases = {
        (("drop", 4, False, False), ("drop", 4, False, False), ("outro", 2, False, False)): [(0, 8, 1, 2), (8, 10, 3, 3)],  # neighbours of a role are one
        (("gap", 1, True, False), ("drop", 4, False, False), ("gap", 1, True, False)): [(0, 6, 1, 3)],  # silences join what is before, the first what comes
        (("drop", 4, False, False), ("build", 1, False, False), ("outro", 4, False, False)): [(0, 5, 1, 2), (5, 9, 3, 3)],  # under 3 s: into the one before
        (("build", 1, False, False), ("drop", 4, False, False)): [(0, 5, 1, 2)],  # or after, if it is the first
        (("drop", 4, False, False), ("speech_bed", 8, False, True), ("drop", 4, False, False)): [(0, 8, 1, 3)],  # a rest takes no time
        (("drop", 61, False, False),): [(0, 30.5, 1, 1), (30.5, 61, 1, 1)],  # over two minutes: equal parts
        (("drop", 40, False, False), ("drop", 40, False, False)): [(0, 40, 1, 1), (40, 80, 2, 2)],
    }
    data = [r for k, rows in enumerate(cases) for r in song(rows, k)]
    got = {}
    for r in L.layout(spark.createDataFrame(data, SECTION), 120.0).collect():
        got.setdefault(r.song, []).append((r.chunk, r.start_ms, r.end_ms, r.first_n, r.last_n))
    for k, want in enumerate(cases.values()):
        assert [x[1:] for x in sorted(got[k])] == [(a * bar, b * bar, f, t) for a, b, f, t in want]


def test_layout_covers_the_music(spark):
    rng = random.Random(5)
    songs = [[(rng.choice(["drop", "build", "outro"]), rng.choice([1, 1, 2, 8, 30, 70]), rng.random() < 0.2, rng.random() < 0.15) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    got = {}
    for r in L.layout(spark.createDataFrame([r for k, s in enumerate(songs) for r in song(s, k)], SECTION), 120.0).collect():
        got.setdefault(r.song, []).append((r.chunk, r.start_ms, r.end_ms))
    for k, s in enumerate(songs):
        chunks = [c[1:] for c in sorted(got.get(k, []))]
        played = [x for x in s if not x[3]]
        if all(x[2] for x in played):
            assert chunks == []
            continue
        assert chunks[0][0] == 0 and chunks[-1][1] == 2_000 * sum(x[1] for x in played)
        assert all(a[1] == b[0] for a, b in itertools.pairwise(chunks))
        assert all(b - a <= 120_000 and (b - a >= 3_000 or len(chunks) == 1) for a, b in chunks)


def test_fits_against_all_choices(spark):
    rng = random.Random(6)
    songs = [[(rng.randint(1, 12), rng.choice([0.2, 0.5, 0.9])) for _ in range(rng.randint(1, 5))] for _ in range(40)]
    data = [(k, n, bars, energy) for k, s in enumerate(songs) for n, (bars, energy) in enumerate(s)]
    got = {r.song: r for r in C.fitted(spark.createDataFrame(data, "song long, n int, bars int, energy double"), "song", 24, 32).collect()}
    cost = lambda b, own, e: abs(math.log2(b / own)) * 2 ** (2 * (e if b < own else 1 - e))
    options = lambda own: sorted({min_ for min_ in (max(1, round(own * f)) for f in (0.5, 1.0, 1.5, 2.0)) if min_ <= 32})
    for k, s in enumerate(songs):
        score = lambda c, s=s: (max(24 - sum(c), sum(c) - 32, 0), sum(cost(b, own, e) for b, (own, e) in zip(c, s, strict=True)) + 0.01 * abs(sum(c) - 28))
        best = min(map(score, itertools.product(*(options(own) for own, _ in s))))
        mine = score(list(got[k].choice))
        assert got[k].total == sum(got[k].choice) and mine[0] == best[0] and abs(mine[1] - best[1]) < 1e-9
        assert abs(got[k].cost + 0.01 * abs(got[k].total - 28) - mine[1]) < 1e-9


def plain_notes(midi, level, most_gap=3, dip=6.0, least=6, voiced=0.5):
    marks = [i for i, x in enumerate(midi) if x is not None]
    stretches = []
    for i in marks:
        if stretches and i - stretches[-1][-1] <= most_gap + 1:
            stretches[-1].append(i)
        else:
            stretches.append([i])
    for a, b in ((s[0], s[-1] + 1) for s in stretches):
        edges, left = [a], a
        for i in range(a + 1, b - 1):
            low = level[i] <= level[i - 1] and level[i] <= level[i + 1]
            if low and level[i] + dip <= max(level[left:i]) and level[i] + dip <= max(level[i + 1 : b]):
                edges.append(i)
                left = i
        for s, e in itertools.pairwise([*edges, b]):
            known = [x for x in midi[s:e] if x is not None]
            if e - s >= least and known and len(known) >= voiced * (e - s):
                yield s, e, statistics.median(known), max(level[s:e])


def test_notes_against_plain_python(spark):
    rng = random.Random(7)
    streams = []
    for _ in range(40):
        n = rng.randint(0, 60)
        streams.append(([None if rng.random() < 0.25 else float(rng.randint(50, 60)) for _ in range(n)], [float(rng.choice([-40, -30, -25, -20, -18])) for _ in range(n)]))
    data = [(k, i, m, v) for k, (ms, vs) in enumerate(streams) for i, (m, v) in enumerate(zip(ms, vs, strict=True))]
    got = sorted((r.k, r.start, r.end, r.pitch, r.level) for r in X.note_pieces(spark.createDataFrame(data, "k long, i int, midi double, db double"), "k", "i", "midi", "db").collect())
    assert got == sorted((k, *x) for k, s in enumerate(streams) for x in plain_notes(*s))
    assert got
