"""Block scans and signal operators against plain recurrences, over blocks so small that streams span many of them."""

import math
import random

import numpy as np
import pytest

from strophe.operators import scan, series, theory
from strophe.operators import signals as G


def stream_of(rng, n, loud=0.5):
    return [round(math.sin(i * 0.3) * loud * (1 + i % 7) / 7 + rng.uniform(-0.1, 0.1), 6) for i in range(n)]


@pytest.fixture(scope="module")
def streams():
    rng = random.Random(4)
    return {0: stream_of(rng, 1000), 1: stream_of(rng, 37), 2: [0.0] * 50, 3: [0.25]}


@pytest.fixture(scope="module")
def rows(spark, streams):
    return spark.createDataFrame([(k, i, v) for k, vs in streams.items() for i, v in enumerate(vs)], "k long, i long, v double").repartition(3).cache()


def by_key(df, column):
    out = {}
    for r in df.collect():
        out.setdefault(r["k"], {})[r["i"]] = r[column]
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def cascade(sections, xs):
    for b0, b1, b2, a1, a2 in sections:
        s1 = s2 = 0.0
        ys = []
        for x in xs:
            y = b0 * x + s1
            s1, s2 = b1 * x - a1 * y + s2, b2 * x - a2 * y
            ys.append(y)
        xs = ys
    return xs


@pytest.mark.parametrize("sections", [G.k_weighting(48000), G.band_pass(44100, 200, 5000), G.high_pass(44100, 80)])
@pytest.mark.parametrize("block", [7, 100, 4096])
def test_filters(rows, streams, sections, block):
    got = by_key(G.filtered(rows, "k", "i", "v", sections, block), "v")
    for k, vs in streams.items():
        assert np.allclose(got[k], cascade(sections, vs), rtol=0, atol=1e-9)


def test_designs():
    """Known coefficients at 48 kHz, and the gain of the band-pass in its band, at its edges and outside."""
    shelf, high = G.k_weighting(48000)
    assert np.allclose(shelf, (1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585), atol=5e-3)
    assert np.allclose(high[3:], (-1.99004745483398, 0.99007225036621), atol=1e-4)
    at = lambda sections, hz, rate: abs(np.prod([np.polyval(s[2::-1], z) / np.polyval((s[4], s[3], 1.0), z) for s in sections for z in [np.exp(-2j * np.pi * hz / rate)]]))
    band = G.band_pass(44100, 200, 5000)
    assert [round(at(band, hz, 44100), 2) for hz in (1000, 200, 5000)] == [1.0, 0.71, 0.71] and at(band, 20, 44100) < 0.02
    assert round(at(G.high_pass(44100, 80), 80, 44100), 3) == 0.707


def peaks_of(xs):
    taps = np.sinc(np.arange(-40, 41) / 4) * np.kaiser(81, 5.0)
    taps *= 4 / taps.sum()
    up = np.zeros(4 * len(xs) + 4)
    up[: 4 * len(xs) : 4] = xs
    full = np.convolve(up, taps)[40 : 40 + 4 * len(xs)]
    return np.maximum(np.abs(full).reshape(-1, 4).max(axis=1), np.abs(xs))


@pytest.mark.parametrize("block", [16, 64, 1 << 16])
def test_true_peaks(rows, streams, block):
    got = by_key(G.true_peaks(rows, "k", "i", "v", block), "peak")
    for k, vs in streams.items():
        assert np.allclose(got[k], peaks_of(vs), atol=1e-12)
    assert max(got[0]) > max(abs(v) for v in streams[0])


def limit_of(need, window, recover):
    ahead = [min(need[i : i + window + 1]) for i in range(len(need))]
    padded = [ahead[0]] * window + ahead
    out, now = [], 1.0
    for i, n in enumerate(need):
        now = min(sum(padded[i : i + window + 1]) / (window + 1), n, now + (1 - now) * recover)
        out.append(now)
    return out


@pytest.mark.parametrize("block", [5, 64, 8192])
def test_limiter(spark, streams, block):
    need = {k: [min(1.0, 0.3 / max(abs(v), 1e-9)) for v in vs] for k, vs in streams.items()}
    df = spark.createDataFrame([(k, i, v) for k, vs in need.items() for i, v in enumerate(vs)], "k long, i long, v double")
    got = by_key(G.limiter(df, "k", "i", "v", 4, 0.07, block), "gain")
    for k, vs in need.items():
        assert np.allclose(got[k], limit_of(vs, 4, 0.07), atol=1e-12)


def lufs_of(xs, rate):
    size = round(0.4 * rate)
    if len(xs) < size or not any(xs):
        return None
    y = np.array(cascade(G.k_weighting(rate), xs))
    n = round((len(xs) / rate - 0.4) / 0.1) + 1
    z = np.array([np.sum(y[s : s + size] ** 2) / size for s in (np.arange(n) * 0.1 * rate).astype(int)])
    level = -0.691 + 10 * np.log10(np.maximum(z, 1e-30))
    loud = z[level >= -70]
    if not len(loud):
        return None
    kept = z[(level >= -70) & (level > -0.691 + 10 * math.log10(loud.mean()) - 10)]
    return -0.691 + 10 * math.log10(kept.mean())


def test_loudness(spark, rows):
    rate = 4000.0
    assert not G.loudness(rows, "k", "i", "v", rate).collect()  # shorter than a gating block
    made = {1: stream_of(random.Random(3), 5003), 2: [0.0] * 2000, 3: [v * (1.0 if i < 2500 else 1e-3) for i, v in enumerate(stream_of(random.Random(6), 6000))]}
    df = spark.createDataFrame([(k, i, v) for k, vs in made.items() for i, v in enumerate(vs)], "k long, i long, v double")
    for block in (133, 1 << 16):
        got = {r["k"]: r["lufs"] for r in G.loudness(df, "k", "i", "v", rate, block).collect()}
        assert got.keys() == {1, 3} and all(abs(got[k] - lufs_of(made[k], rate)) < 1e-9 for k in got)


def test_mastering(spark):
    rng = random.Random(9)
    rate, target, ceiling = 8000.0, -14.0, -1.0
    made = {0: [v * 0.05 for v in stream_of(rng, 9000)], 1: [v * (0.02 if i % 4000 > 60 else 1.9) for i, v in enumerate(stream_of(rng, 9000))], 2: [0.0] * 4000}
    df = spark.createDataFrame([(k, i, v) for k, vs in made.items() for i, v in enumerate(vs)], "k long, i long, v double")
    told, samples = G.mastered(df, "k", "i", "v", rate, target, ceiling)
    told = {r["k"]: r for r in told.collect()}
    out = by_key(samples, "v")
    window, recover = max(1, round(0.005 * rate / 32)), 1 - math.exp(-32 / rate / 0.08)
    for k, vs in made.items():
        gain = 0.0 if k == 2 else target - lufs_of(vs, rate)
        for n in range(5):
            if k == 2:
                now = np.array(vs)
                break
            x = np.array(vs) * 10 ** (gain / 20)
            spans = [peaks_of(x)[b : b + 32].max() for b in range(0, len(x), 32)]
            g = limit_of([min(1.0, 10 ** ((ceiling - 0.3) / 20) / max(p, 1e-12)) for p in spans], window, recover)
            now = x * np.repeat(g, 32)[: len(x)]
            if abs(lufs_of(now, rate) - target) < 0.05 or n == 4:
                break
            gain += target - lufs_of(now, rate)
        peak = peaks_of(now).max()
        if peak > 0 and 20 * math.log10(peak) > ceiling:
            now = now * 10 ** ((ceiling - 20 * math.log10(peak) - 0.01) / 20)
        assert np.allclose(out[k], now, atol=1e-7)
        assert abs(told[k]["gain_db"] - gain) < 1e-6
        if k < 2:
            assert told[k]["true_peak_db"] <= ceiling + 1e-9 and abs(told[k]["lufs"] - lufs_of(now, rate)) < 1e-6
    assert abs(told[0]["lufs"] - target) < 0.1 and told[2]["lufs"] is None and told[2]["rounds"] == 0


def test_tempo_of_pulses(spark):
    """Pulses at a tempo, at its half and with an off-beat; the reading is the beat, or its half or double."""
    fps, rows = 86.1328125, []
    for k, bpm in enumerate((60.0, 97.5, 119.0, 174.0)):
        for i in range(3000):
            beat = i / fps * bpm / 60
            rows.append((k, i, math.exp(-((((beat + 0.5) % 1) - 0.5) ** 2) / 0.002) + 0.4 * math.exp(-((((beat + 1) % 2) - 1) ** 2) / 0.001)))
    rows += [(9, i, 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    for block in (700, 1 << 16):
        got = {r["k"]: r["bpm"] for r in G.tempos(df, "k", "i", "v", fps, block).collect()}
        assert got.keys() == {0, 1, 2, 3}
        for k, bpm in enumerate((60.0, 97.5, 119.0, 174.0)):
            assert min(abs(got[k] / (bpm * r) - 1) for r in (0.5, 1, 2)) < 0.004
        assert abs(got[2] / 119 - 1) < 0.004


def chords_of(ws, mode, tonic):
    table, prior, moves = theory.triads(mode, tonic), theory.DEGREE_PRIOR[mode], set(theory.MOVES[mode])
    emit = lambda w, k: ((sum(w[p] for p in table[k][1]) + 0.3 * w[table[k][1][0]]) / sum(w) if sum(w) else 0.0) + prior[table[k][0]]
    score, back = [emit(ws[0], k) + (0.2 if table[k][0] == 1 else 0.0) for k in range(7)], []
    for w in ws[1:]:
        ways = [[score[j] + (0.15 if (table[j][0], table[k][0]) in moves else 0.0) + (0.05 if j == k else 0.0) for j in range(7)] for k in range(7)]
        back.append([int(np.argmax(x)) for x in ways])
        score = [max(ways[k]) + emit(w, k) for k in range(7)]
    path = [int(np.argmax(score))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return [table[k][0] for k in reversed(path)]


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_chord_paths_over_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(scan, "FAN", 4)
    rng = random.Random(block)
    songs = {k: [[rng.choice([0.0, rng.random()]) for _ in range(12)] if rng.random() > 0.1 else [0.0] * 12 for _ in range(n)] for k, n in enumerate((1, 2, 50, 97))}
    df = spark.createDataFrame([(k, b, w) for k, ws in songs.items() for b, w in enumerate(ws)], "song long, bar long, w array<double>")
    got = {}
    for r in theory.chord_rows(df, "song", "bar", "w", "minor", 9, block).orderBy("song", "bar").collect():
        got.setdefault(r["song"], []).append(r["degree"])
    assert got == {k: chords_of(ws, "minor", 9) for k, ws in songs.items()}


def test_scan_in_levels(spark, monkeypatch):
    monkeypatch.setattr(scan, "FAN", 3)
    rows = [(k, i, [float(10 * k + i)]) for k, n in ((1, 40), (2, 1), (3, 9)) for i in range(n)]
    got = scan.exclusive_scan(spark.createDataFrame(rows, "k long, i long, value array<double>"), "k", "i", "value", lambda a, b: (a[0] + b[0],))
    want = {(k, i): sum(10 * k + j for j in range(i)) if i else None for k, i, _ in rows}
    assert {(r["k"], r["i"]): r["before"] and r["before"][0] for r in got.collect()} == want


def test_gated_blocks_of_series_still_hold(spark):
    df = spark.createDataFrame([(1, 1e-3), (1, 1e-3), (1, 1e-9)], "k long, e double")
    assert abs(series.gated_loudness(df, "k", "e").first()["lufs"] - (-0.691 - 30)) < 1e-9
