"""The melody chain against plain Python, its reuse by fingerprints, and stored runs of several versions."""

import json
import math
import random
import statistics

import numpy as np
import pytest

from strophe.operators import melody, theory
from strophe.plans.cache import Stages
from strophe.sources import runs
from test_signals import chords_of


def plain_melody(segments, clips, bpm0=120.0, tolerance=4.0, grid=0.5, strength=0.8):
    """(tonic, mode, shift, bpm), notes and chords of one talk; segments (clip, i, start, end, pitch, level), clips {clip: duration}."""
    w = [e - s for _, _, s, e, _, _ in segments]
    p = [x[4] for x in segments]
    offset = math.atan2(sum(a * math.sin(2 * math.pi * x) for a, x in zip(w, p)), sum(a * math.cos(2 * math.pi * x) for a, x in zip(w, p))) / (2 * math.pi)
    offset -= round(offset)
    tuned = [x - offset for x in p]
    hist = [0.0] * 12
    for a, x in zip(w, tuned):
        hist[round(x) % 12] += a
    scored = []
    for mode in ("major", "minor"):
        for tonic in range(12):
            profile = [theory.PROFILES[mode][(pc - tonic) % 12] for pc in range(12)]
            if np.std(hist) > 0:
                scored.append((-round(np.corrcoef(hist, profile)[0, 1] + (0.05 if mode == "minor" else 0.0), 9), len(scored), tonic, mode))
    tonic, mode = min(scored)[2:] if scored else (9, "minor")
    scale = {(s + tonic) % 12 for s in theory.SCALES[mode]}
    snapped = []
    for x in tuned:
        q = min((abs(q - x), q) for q in range(math.floor(x) - 2, math.floor(x) + 4) if q % 12 in scale)[1]
        snapped.append(x + strength * (q - x))
    shift = 12 * math.ceil((60 - statistics.median(snapped)) / 12)
    placed = []
    for x in snapped:
        x += shift
        x += 12 * max(0, math.ceil((55 - x) / 12))
        placed.append(x - 12 * max(0, math.ceil((x - 84) / 12)))
    off = lambda x: abs(x - round(x))
    tries = []
    for bpm in range(math.ceil(bpm0 - tolerance), math.floor(bpm0 + tolerance) + 1):
        beat = 60 / bpm
        cost = statistics.fmean(off(d / beat) for d in clips.values()) + 0.5 * statistics.fmean(off(x[2] / (beat * grid)) for x in segments)
        tries.append((round(cost + theory.DRIFT * abs(bpm - bpm0) / tolerance, 6), abs(bpm - bpm0), bpm))
    bpm = min(tries)[2]
    beat, notes, chords = 60 / bpm, [], []
    for clip, duration in clips.items():
        own = [(x, pl) for x, pl in zip(segments, placed) if x[0] == clip]
        top = max((x[5] for x, _ in own), default=0)
        by_start = {}
        for x, pl in own:
            a, b = (round(t / beat / grid) * grid for t in x[2:4])
            n = (a, max(grid, b - a), x[1], pl, round(50 + 50 * max(0.0, 1 - (top - x[5]) / 30)))
            if a not in by_start or n[1] > by_start[a][1]:
                by_start[a] = n
        order = sorted(by_start.values())
        mine = [(clip, i, a, min(b, order[k + 1][0] - a) if k + 1 < len(order) else b, round(pl), v) for k, (a, b, i, pl, v) in enumerate(order)]
        notes += mine
        bars = max(1, math.ceil(max(duration / beat, max((a + b for _, _, a, b, _, _ in mine), default=0)) / 4 - 1e-9))
        weights = [[0.0] * 12 for _ in range(bars)]
        for _, _, a, b, m, _ in mine:
            for bar in range(int(a // 4), min(bars, math.ceil((a + b) / 4))):
                weights[bar][m % 12] += max(0, min(a + b, 4 * bar + 4) - max(a, 4 * bar))
        chords += [(clip, bar, d) for bar, d in enumerate(chords_of(weights, mode, tonic))]
    return (tonic, mode, shift, bpm), notes, chords


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(14)
    made = {}
    for talk in range(4):
        clips = {c: round(rng.uniform(2, 9), 3) for c in range(3)}
        rows = []
        for c in range(2 if talk else 3):  # the last clip of most talks has no segment
            at = 0.0
            for k in range(rng.randint(3, 25)):
                at = round(at + rng.uniform(0.0, 0.5), 3)
                rows.append((c, 100 * c + k, at, round(at + rng.uniform(0.05, 0.6), 3), round(rng.uniform(40, 75), 3), round(rng.uniform(-60, 0), 2)))
        made[talk] = (rows, clips)
    segments = spark.createDataFrame([(t, *r) for t, (rs, _) in made.items() for r in rs], "talk long, clip long, i long, start double, end double, pitch double, level double")
    clips = spark.createDataFrame([(t, c, d) for t, (_, cs) in made.items() for c, d in cs.items()], "talk long, clip long, duration double")
    return made, segments, clips


def test_melodies_end_to_end(talks):
    made, segments, clips = talks
    told, notes, chords = melody.melodies(segments, clips)
    told = {r["talk"]: (r["tonic"], r["mode"], r["shift"], r["bpm"]) for r in told.collect()}
    notes, chords = notes.collect(), chords.collect()
    for t, (rows, cs) in made.items():
        want = plain_melody(rows, cs)
        assert told[t] == want[0]
        assert sorted((r["clip"], r["i"], r["start_beat"], r["beats"], r["midi"], r["velocity"]) for r in notes if r["talk"] == t) == sorted(want[1])
        assert sorted((r["clip"], r["bar"], r["degree"]) for r in chords if r["talk"] == t) == sorted(want[2])


def test_steps_are_made_once(spark, talks, tmp_path):
    _, segments, clips = talks
    stages = Stages(spark, f"file://{tmp_path}")
    whole = sorted(map(tuple, melody.melodies(segments, clips)[2].collect()))
    assert sorted(map(tuple, melody.melodies(segments, clips, stages=stages, source="a")[2].collect())) == whole
    first = {p.name for p in tmp_path.iterdir()}
    assert sorted(map(tuple, melody.melodies(segments, clips, stages=stages, source="a")[2].collect())) == whole
    assert {p.name for p in tmp_path.iterdir()} == first and len(first) == 6
    melody.melodies(segments, clips, bpm=90.0, stages=stages, source="a")
    assert len({p.name for p in tmp_path.iterdir()} - first) == 3  # tempo, notes and chords


def test_runs_of_two_versions(spark):
    """A run of version 1 becomes its summary; unknown versions and texts that are no records are refused and counted."""
    old = {"options": {"voice": "v", "take": "2", "clips": None}, "stages": {"ingest": "a", "align": "b", "mix": "c", "arc": "d"}}
    new = {"schema_version": 2, "length": "full", "options": {"voice": "v"}, "stages": {"ingest": "a"}, "songs": {"full": {"options": {"take": "1"}, "stages": {"mix": "c"}}}}
    plain = {"schema_version": 1, "options": {"voice": "v"}, "stages": {"ingest": "a"}}
    texts = [old, old | {"schema_version": 1}, new, plain, {"schema_version": 7, "stages": {}}, "no json", None, {"else": 1}]
    rows = [(i, t if t is None or isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)]
    out = runs.migrated(spark.createDataFrame(rows, "id int, record string"))
    got = {r["id"]: r["run"] and r["run"].asDict(True) for r in out.collect()}
    moved = {"schema_version": 2, "length": "summary", "options": {"voice": "v"}, "stages": {"ingest": "a", "align": "b"}, "songs": {"summary": {"options": {"take": "2"}, "stages": {"mix": "c", "arc": "d"}}}}
    assert got[0] == got[1] == moved and got[2] == new
    assert got[3] == {"schema_version": 2, "length": "summary", "options": {"voice": "v"}, "stages": {"ingest": "a"}, "songs": {}}
    assert got[4] is got[5] is got[6] is got[7] is None
    assert {(r["from_version"], r["n"]) for r in runs.refusals(out).collect()} == {(7, 1), (None, 3)}


def test_short_songs_are_decoded_at_once(spark):
    """Songs within a block take one exchange and no scan, and have the chords that the scan over blocks gives; long ones beside them keep it."""
    draw = random.Random(5)
    rows = [({"talk": k % 3, "clip": k}, b, [float(draw.randint(0, 3)) for _ in range(12)]) for k in range(40) for b in range(1 + k * k % 11)]
    bars = spark.createDataFrame(rows, "key struct<talk: int, clip: int>, bar bigint, w array<double>")
    told = {block: sorted((r.key.talk, r.key.clip, r.bar, r.degree) for r in theory.chord_rows(bars, "key", "bar", "w", "major", 0, block).collect()) for block in (4096, 4, 1)}
    assert len(told[4096]) == len(rows) and told[4096] == told[4] == told[1]
    plan = theory.chord_rows(bars, "key", "bar", "w", "major", 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Join" not in plan
