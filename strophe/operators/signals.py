"""Sample streams: recursive filters, true peaks, loudness, limiting, mastering and tempo, each a block of samples per task.

Streams are rows (key, i, v) with ``i`` counted from 0 without gaps; a key may be a struct, such as stream and channel.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.storage import written

from .scan import each_block, exclusive_scan, with_halo
from .series import gated_loudness

BLOCK = 1 << 16
STRIDE = 64
Section = tuple[float, float, float, float, float]

# Oversampling and its filter, gating blocks, the K-weighting's two filters, the limiter and the rounds of mastering.
OVERSAMPLE, HALF_TAPS, KAISER = 4, 10, 5.0
GATE_S, GATE_STEP = 0.4, 0.25
SHELF_DB, SHELF_Q, SHELF_HZ = 4.0, 1 / math.sqrt(2), 1500.0
PASS_Q, PASS_HZ = 0.5, 38.0
LIMIT_SAMPLES, LOOKAHEAD_S, RELEASE_S, CEILING_MARGIN = 32, 0.005, 0.08, 0.3
ROUNDS, CLOSE_LU, TRIM_DB = 4, 0.05, 0.01


# Filters.  A section is (b0, b1, b2, a1, a2) with a0 = 1.


def _section(b: tuple[float, float, float], a: tuple[float, float, float]) -> Section:
    return (b[0] / a[0], b[1] / a[0], b[2] / a[0], a[1] / a[0], a[2] / a[0])


def high_pass(rate: float, hz: float, q: float = SHELF_Q) -> list[Section]:
    """Second order by the bilinear transform; with the default Q it is Butterworth's."""
    w = 2 * math.pi * hz / rate
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    return [_section(((1 + c) / 2, -(1 + c), (1 + c) / 2), (1 + alpha, -2 * c, 1 - alpha))]


def high_shelf(rate: float, hz: float, db: float, q: float) -> list[Section]:
    w, a = 2 * math.pi * hz / rate, 10 ** (db / 40)
    c, r = math.cos(w), math.sqrt(a) * math.sin(w) / q
    return [
        _section(
            (a * (a + 1 + (a - 1) * c + r), -2 * a * (a - 1 + (a + 1) * c), a * (a + 1 + (a - 1) * c - r)),
            (a + 1 - (a - 1) * c + r, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - r),
        )
    ]


def k_weighting(rate: float) -> list[Section]:
    return high_shelf(rate, SHELF_HZ, SHELF_DB, SHELF_Q) + high_pass(rate, PASS_HZ, PASS_Q)


def band_pass(rate: float, low: float, high: float) -> list[Section]:
    """Butterworth's band-pass of two poles on each side."""
    warped = [2 * rate * math.tan(math.pi * f / rate) for f in (low, high)]
    width, middle = warped[1] - warped[0], warped[0] * warped[1]
    half = np.exp(1j * 3 * np.pi / 4) * width / 2
    poles = [half + s * np.sqrt(half * half - middle) for s in (1, -1)]
    digital = [(2 * rate + p) / (2 * rate - p) for p in poles]
    gain = width * width * (2 * rate) ** 2 / float(np.prod([abs(2 * rate - p) ** 2 for p in poles]))
    return [(g, 0.0, -g, float(-2 * z.real), float(abs(z) ** 2)) for z, g in zip(digital, (gain, 1.0), strict=True)]


class System:
    """A cascade of sections as state' = A state + B x, y = C state + D x."""

    def __init__(self, sections: list[Section]) -> None:
        self.a, self.b, self.c, self.d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
        for b0, b1, b2, a1, a2 in sections:
            n = len(self.b)
            a, b = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
            self.a = np.block([[self.a, np.zeros((n, 2))], [np.outer(b, self.c), a]])
            self.b, self.c, self.d = np.r_[self.b, b * self.d], np.r_[b0 * self.c, 1.0, 0.0], self.d * b0

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and final state: strides side by side from rest, then what each began with is added."""
        m = len(x) // STRIDE
        parts, ends, y = x[: m * STRIDE].reshape(m, STRIDE), np.zeros((m, len(self.b))), np.empty((m, STRIDE))
        for k in range(STRIDE):
            y[:, k] = ends @ self.c + self.d * parts[:, k]
            ends = ends @ self.a.T + parts[:, k, None] * self.b
        starts, over = np.empty_like(ends), np.linalg.matrix_power(self.a, STRIDE)
        for k in range(m):
            starts[k] = state
            state = over @ state + ends[k]
        seen, row = np.empty((STRIDE, len(self.b))), self.c
        for k in range(STRIDE):
            seen[k], row = row, row @ self.a
        y = (y + starts @ seen.T).ravel()
        rest = np.empty(len(x) - m * STRIDE)
        for k, v in enumerate(x[m * STRIDE :]):
            rest[k], state = self.c @ state + self.d * v, self.a @ state + self.b * v
        return np.r_[y, rest], state


def _from_maps(system: System, before: list | None) -> np.ndarray:
    n = len(system.b)
    return np.zeros(n) if before is None else np.asarray(before[n * n :])


def _each_filtered(df: DataFrame, key: str, i: str, x: str, sections: list[Section], use, schema: str, block: int) -> DataFrame:
    """``use(key, i, y)`` for each block of the filtered samples: columns of ``schema``."""
    system = System(sections)
    n = len(system.b)
    rows = df.select(key, i, x).withColumn("block", F.floor(F.col(i) / block))
    kind = dict(rows.dtypes)[key]

    def to_map(c: dict, _) -> tuple:
        _, state = system.run(c[x].astype(float), np.zeros(n))
        return c[key][0], int(c["block"][0]), [np.r_[np.linalg.matrix_power(system.a, len(c[x])).ravel(), state]]

    def compose(f: list, g: list) -> np.ndarray:
        f, g = np.asarray(f), np.asarray(g)
        a = g[: n * n].reshape(n, n)
        return np.r_[(a @ f[: n * n].reshape(n, n)).ravel(), a @ f[n * n :] + g[n * n :]]

    maps = each_block(rows, [key, "block"], i, to_map, f"{key} {kind}, block bigint, value array<double>", arrays=True)
    before = exclusive_scan(maps, key, "block", "value", compose)
    replay = lambda c, b: use(c[key][0], c[i], system.run(c[x].astype(float), _from_maps(system, b))[0])
    return each_block(rows, [key, "block"], i, replay, schema, before, arrays=True)


def filtered(df: DataFrame, key: str, i: str, x: str, sections: list[Section], block: int = BLOCK) -> DataFrame:
    """(key, i, x) through a cascade of second-order sections.

    A block's samples act on the filter's state as an affine map; the maps are scanned, and every block is run from the state
    before it.
    """
    kind = dict(df.dtypes)[key]
    return _each_filtered(df, key, i, x, sections, lambda k, at, y: (k, at, y), f"{key} {kind}, {i} bigint, {x} double", block)


# Peaks.


def upsampling_taps() -> np.ndarray:
    """A row of taps for each of the points between samples: a Kaiser-windowed sinc of 10 samples on each side."""
    n = np.arange(-HALF_TAPS * OVERSAMPLE, HALF_TAPS * OVERSAMPLE + 1)
    h = np.sinc(n / OVERSAMPLE) * np.kaiser(len(n), KAISER)
    h *= OVERSAMPLE / h.sum()
    return np.array([[h[OVERSAMPLE * j + p] if OVERSAMPLE * j + p < len(h) else 0.0 for j in range(2 * HALF_TAPS + 1)] for p in range(OVERSAMPLE)])


def true_peaks(df: DataFrame, key: str, i: str, x: str, block: int = BLOCK) -> DataFrame:
    """(key, i, peak): the largest magnitude of a sample and of the points between it and the next, at four times the rate.

    Each block also gets the samples next to it, so a peak between two blocks is seen.
    """
    taps = upsampling_taps()
    kind = dict(df.dtypes)[key]

    def run(c: dict, _) -> tuple:
        v = c[x].astype(float)
        points = [np.abs(np.convolve(v, t)[HALF_TAPS : HALF_TAPS + len(v)]) for t in taps]
        own = c["own"].astype(bool)
        return c[key][0], c[i][own], np.maximum(np.abs(v), np.max(points, axis=0))[own]

    near = with_halo(df.select(key, i, x), i, block, HALF_TAPS, HALF_TAPS)
    return each_block(near, [key, "block"], i, run, f"{key} {kind}, {i} bigint, peak double", arrays=True)


def db(x: Column) -> Column:
    return 20 * F.log10(x)


def gain_of(level: Column) -> Column:
    return F.pow(F.lit(10.0), level / 20)


# Loudness.


def gate_energies(df: DataFrame, key: str, i: str, x: str, rate: float, block: int = BLOCK) -> DataFrame:
    """(key, gate, energy): K-weighted mean square of each gating block of 0.4 s, four of which overlap, whole ones only.

    Each block of samples adds its part to the gating blocks that it touches; only these sums are shuffled.
    """
    size, hop = round(GATE_S * rate), GATE_S * GATE_STEP * rate
    kind = dict(df.dtypes)[key]

    def use(k, at: np.ndarray, y: np.ndarray) -> tuple:
        first, stop = int(at[0]), int(at[-1]) + 1
        total = np.r_[0.0, np.cumsum(y * y)]
        gates = np.arange(max(0, math.floor((first - size) / hop)), math.floor(stop / hop) + 1)
        starts = (GATE_S * GATE_STEP * gates * rate).astype(int)
        lo, hi = (np.clip(e, first, stop) - first for e in (starts, starts + size))
        held = hi > lo
        return k, gates[held], (total[hi] - total[lo])[held]

    parts = _each_filtered(df, key, i, x, k_weighting(rate), use, f"{key} {kind}, __gate bigint, __e double", block)
    sizes = df.groupBy(key).agg(F.count("*").alias("__n"))
    gates = F.rint((F.col("__n") / rate - GATE_S) / (GATE_S * GATE_STEP)) + 1
    whole = sizes.filter(F.col("__n") >= size).select(key, gates.alias("__gates"))
    return parts.groupBy(key, "__gate").agg((F.sum("__e") / size).alias("energy")).join(whole, key).filter("__gate < __gates").select(key, F.col("__gate").alias("gate"), "energy")


def loudness(df: DataFrame, key: str, i: str, x: str, rate: float, block: int = BLOCK) -> DataFrame:
    """(key, lufs): integrated gated loudness; no row for silence and for less than one gating block."""
    return gated_loudness(gate_energies(df, key, i, x, rate, block).filter("energy > 0"), key, "energy")


# Limiting.


def limiter(df: DataFrame, key: str, i: str, need: str, window: int, recover: float, block: int = 8192) -> DataFrame:
    """(key, i, gain): a look-ahead limiter on the gains that short spans need.

    Minimum ahead, mean behind, then a release towards 1.  With u = 1 - gain a release step is u -> max(1 - cap, (1 - recover) u):
    such maps compose to maps of the same kind, so blocks are scanned, and no stream is folded in one piece.
    """
    keep = 1 - recover
    kind = dict(df.dtypes)[key]

    def caps(c: dict) -> np.ndarray:
        v, own = c[need].astype(float), c["own"].astype(bool)
        first = int(np.argmax(own))
        padded = np.r_[v, np.full(window, 1.0)]
        ahead = np.lib.stride_tricks.sliding_window_view(padded, window + 1).min(axis=1)
        behind = np.r_[np.full(max(0, window - first), ahead[0]), ahead[max(0, first - window) :]]
        glide = np.lib.stride_tricks.sliding_window_view(behind, window + 1).sum(axis=1) / (window + 1)
        return np.minimum(glide[: int(own.sum())], v[own])

    def to_map(c: dict, _) -> tuple:
        if not c["own"].any():  # the context of a block that no row is in
            return c[key][0], [], []
        low = 1 - caps(c)
        worst = float(np.max(low * keep ** np.arange(len(low) - 1, -1, -1)))
        return c[key][0], int(c["block"][0]), [[max(worst, 0.0), keep ** len(low)]]

    def replay(c: dict, before: list | None) -> tuple:
        if not c["own"].any():
            return c[key][0], [], []
        gain, out = (1 - before[0] if before else 1.0), []
        for cap in caps(c).tolist():
            gain = min(cap, gain * keep + recover)
            out.append(gain)
        return c[key][0], c[i][c["own"].astype(bool)], np.array(out)

    near = with_halo(df.select(key, i, need), i, block, window, window)
    maps = each_block(near, [key, "block"], i, to_map, f"{key} {kind}, block bigint, value array<double>", arrays=True)
    before = exclusive_scan(maps, key, "block", "value", lambda f, g: (max(g[0], g[1] * f[0]), f[1] * g[1]))
    return each_block(near, [key, "block"], i, replay, f"{key} {kind}, {i} bigint, gain double", before, arrays=True)


def span_peaks(df: DataFrame, key: str, i: str, x: str) -> DataFrame:
    """(key, b, peak): true peaks of the limiter's spans of samples."""
    return true_peaks(df, key, i, x).groupBy(key, F.floor(F.col(i) / LIMIT_SAMPLES).alias("b")).agg(F.max("peak").alias("peak"))


def limited(df: DataFrame, key: str, i: str, x: str, peaks: DataFrame, gains: DataFrame, rate: float, ceiling_db: float) -> DataFrame:
    """(key, i, x) times the ``gain_db`` of its stream, limited to the ceiling; ``peaks`` are those of the samples as they are."""
    ceiling = 10 ** (ceiling_db / 20)
    window = max(1, round(LOOKAHEAD_S * rate / LIMIT_SAMPLES))
    recover = 1 - math.exp(-LIMIT_SAMPLES / rate / RELEASE_S)
    need = F.least(F.lit(1.0), ceiling / F.greatest(F.col("peak") * gain_of(F.col("gain_db")), F.lit(1e-12)))
    spans = limiter(peaks.join(gains, key).select(key, "b", need.alias("need")), key, "b", "need", window, recover)
    lined = df.select(key, i, x, F.floor(F.col(i) / LIMIT_SAMPLES).alias("b")).join(spans, [key, "b"]).join(gains, key)
    return lined.select(key, i, (F.col(x) * gain_of(F.col("gain_db")) * F.col("gain")).alias(x))


def mastered(df: DataFrame, key: str, i: str, x: str, rate: float, target: float, ceiling_db: float) -> tuple[DataFrame, DataFrame]:
    """Streams brought to a loudness under a ceiling: (key, gain_db, trim_db, lufs, true_peak_db, rounds) and the samples.

    Gain, limit and measure are repeated for the streams that are not within 0.05 LU yet, at most ``ROUNDS`` times after the first; a
    trim then keeps the peaks under the ceiling.  Streams without a loudness pass unchanged.  Only a row for each stream is written
    between rounds.
    """
    df = df.select(key, i, x)
    peaks = written(span_peaks(df, key, i, x), "span-peaks")
    begun = loudness(df, key, i, x, rate).select(key, (F.lit(target) - F.col("lufs")).alias("gain_db"))
    state = written(begun.select(key, "gain_db", F.lit(None).cast("double").alias("lufs"), F.lit(False).alias("done"), F.lit(0).alias("rounds")), "mastering")
    for n in range(ROUNDS + 1):
        active = state.filter("not done").select(key, "gain_db")
        if not active.head(1):
            break
        out = limited(df.join(active.select(key), key, "left_semi"), key, i, x, peaks, active, rate, ceiling_db - CEILING_MARGIN)
        heard = state.drop("lufs").join(loudness(out, key, i, x, rate), key, "left")
        close = F.col("lufs").isNull() | (F.abs(F.col("lufs") - target) < CLOSE_LU) | F.lit(n == ROUNDS)
        moved = heard.filter("not done").select(key, F.when(close, F.col("gain_db")).otherwise(F.col("gain_db") + target - F.col("lufs")).alias("gain_db"), "lufs", close.alias("done"), F.lit(n + 1).alias("rounds"))
        state = written(state.filter("done").unionByName(moved), "mastering")
    gains = state.select(key, "gain_db")
    out = limited(df, key, i, x, peaks, gains, rate, ceiling_db - CEILING_MARGIN).unionByName(df.join(gains, key, "left_anti"))
    out = written(out, "limited")
    top = db(F.max("peak"))
    over = true_peaks(out, key, i, x).groupBy(key).agg(F.when(F.max("peak") > 0, top).alias("peak_db"))
    trim = F.when(F.col("peak_db") > ceiling_db, ceiling_db - F.col("peak_db") - TRIM_DB).otherwise(0.0)
    trims = written(over.join(gains, key, "left").select(key, "peak_db", F.when(F.col("gain_db").isNull(), 0.0).otherwise(trim).alias("trim_db")), "trims")
    samples = out.join(trims.select(key, "trim_db"), key).select(key, i, (F.col(x) * gain_of(F.col("trim_db"))).alias(x))
    told = trims.join(state, key, "left").join(loudness(samples, key, i, x, rate).withColumnRenamed("lufs", "final"), key, "left")
    told = told.select(key, F.coalesce("gain_db", F.lit(0.0)).alias("gain_db"), "trim_db", F.col("final").alias("lufs"), (F.col("peak_db") + F.col("trim_db")).alias("true_peak_db"), F.coalesce("rounds", F.lit(0)).alias("rounds"))
    return told, samples


# Tempo.

SLOWEST, FASTEST, USUAL = 30.0, 320.0, 120.0
REFINE = 0.04


def autocorrelation(df: DataFrame, key: str, i: str, x: str, most: int, block: int = BLOCK) -> DataFrame:
    """(key, lag, ac): sums of products ``lag`` rows apart, up to ``most``, of an envelope less its mean.

    Each block gets the ``most`` rows after it and gives one sum for each lag.
    """
    kind = dict(df.dtypes)[key]
    means = df.groupBy(key).agg(F.avg(x).alias("__mean"))
    level = df.select(key, i, x).join(means, key).select(key, i, (F.col(x) - F.col("__mean")).alias(x))
    block = max(block, most)

    def run(c: dict, _) -> tuple:
        v = c[x].astype(float)
        own = np.where(c["own"].astype(bool), v, 0.0)
        size = 1 << int(2 * len(v) - 1).bit_length()
        ac = np.fft.irfft(np.conj(np.fft.rfft(own, size)) * np.fft.rfft(v, size), size)[: min(most + 1, len(v))]
        return c[key][0], np.arange(len(ac)), ac

    near = with_halo(level, i, block, 0, most)
    return each_block(near, [key, "block"], i, run, f"{key} {kind}, lag bigint, ac double", arrays=True).groupBy(key, "lag").agg(F.sum("ac").alias("ac"))


def tempos(df: DataFrame, key: str, i: str, x: str, fps: float, block: int = BLOCK) -> DataFrame:
    """(key, bpm): tempo of an onset envelope of ``fps`` frames a second.

    The first guess is the lag with the best correlation under a prior of an octave around 120; the peak within 4 % of its beat is
    refined between frames by a parabola.  No row for a stream without a positive correlation at any lag of a beat.
    """
    slow, fast = math.floor(60 * fps / SLOWEST), max(2, math.ceil(60 * fps / FASTEST))
    ac = autocorrelation(df, key, i, x, math.ceil(slow * (1 + REFINE)) + 2, block)
    power = F.max(F.when(F.col("lag") == 0, F.col("ac"))).over(Window.partitionBy(key))  # a row for each of the lags
    by = Window.partitionBy(key).orderBy("lag")
    lags = ac.withColumn("share", F.try_divide("ac", power)).withColumn("before", F.lag("ac").over(by)).withColumn("after", F.lead("ac").over(by))
    prior = -0.5 * F.pow(F.log2(F.try_divide(F.lit(60 * fps), F.col("lag"))) - math.log2(USUAL), 2)
    beats = lags.filter((F.col("lag") >= fast) & (F.col("lag") <= slow) & (F.col("share") > 0))
    guess = beats.groupBy(key).agg(F.max_by("lag", F.struct(F.round(F.log1p(1e6 * F.col("share")) + prior, 9), -F.col("lag"))).alias("guess"))
    lo, hi = F.greatest(F.lit(2), F.floor(F.col("guess") * (1 - REFINE))), F.floor(F.col("guess") * (1 + REFINE))
    near = lags.join(guess, key).filter((F.col("lag") >= lo) & (F.col("lag") <= hi))
    best = near.groupBy(key).agg(F.max_by(F.struct("lag", "before", "ac", "after"), F.struct(F.round("share", 12), -F.col("lag"))).alias("b")).select(key, "b.*")
    curve = F.col("before") - 2 * F.col("ac") + F.col("after")
    moved = F.col("lag") + F.coalesce(F.when(curve < 0, 0.5 * (F.col("before") - F.col("after")) / curve), F.lit(0.0))
    return best.select(key, (60 * fps / moved).alias("bpm"))
