"""Frame series: levels, contours, gains and envelopes over ordered frames of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import runs_where

FLOOR = 1e-12


def level_db(energy: Column) -> Column:
    return 10 * F.log10(energy + FLOOR)


def rms_db(x: Column) -> Column:
    """Aggregate: level of the root mean square, -120 for silence."""
    rms = F.sqrt(F.avg(x * x))
    return F.when(rms > 0, 20 * F.log10(rms)).otherwise(-120.0)


def frame_levels(df: DataFrame, stream: str, i: str, x: str, frame: int) -> DataFrame:
    """Adds level_db: of ``frame`` samples around each sample, cut off at the ends."""
    half = frame // 2
    near = Window.partitionBy(stream).orderBy(i).rowsBetween(-half, half - 1)
    return df.withColumn("level_db", level_db(F.avg(F.col(x) * F.col(x)).over(near)))


def voiced_runs(df: DataFrame, stream: str, i: str, x: str) -> DataFrame:
    return runs_where(df, [stream], i, F.col(x).isNotNull()).select(stream, F.col("first").alias("start"), (F.col("last") + 1).alias("end"))


def without_octave_jumps(df: DataFrame, stream: str, i: str, x: str, window: int = 43, threshold: float = 7.0, accept: float = 4.0) -> DataFrame:
    """A frame far from the median around it moves by an octave if that brings it near; else it counts as unvoiced."""
    half = window // 2
    around = Window.partitionBy(stream).orderBy(i).rowsBetween(-half, half)
    ref = F.expr(f"percentile({x}, 0.5)").over(around)
    moved = F.when(F.col("__ref") > F.col(x), F.col(x) + 12).otherwise(F.col(x) - 12)
    fixed = F.when(F.abs(F.col(x) - F.col("__ref")) <= threshold, F.col(x)).when(F.abs(moved - F.col("__ref")) <= accept, moved)
    return df.withColumn("__ref", ref).withColumn(x, fixed).drop("__ref")


def smoothed(df: DataFrame, stream: str, i: str, x: str, kernel: int = 5) -> DataFrame:
    """Median of ``kernel`` frames inside each voiced run."""
    half = kernel // 2
    by = Window.partitionBy(stream).orderBy(i)
    voiced = F.col(x).isNotNull()
    marked = df.withColumn("__run", F.sum(F.when(voiced, 0).otherwise(1)).over(by))
    inside = Window.partitionBy(stream, "__run", voiced).orderBy(i).rowsBetween(-half, half)
    return marked.withColumn(x, F.expr(f"percentile({x}, 0.5)").over(inside)).drop("__run")


def dips(df: DataFrame, stream: str, i: str, level: str, below: float) -> DataFrame:
    """Stretches below a level, with the deepest value."""
    found = runs_where(df, [stream], i, F.col(level) < below, F.min(level).alias("deepest"))
    return found.select(stream, F.col("first").alias("start"), (F.col("last") + 1).alias("end"), "deepest")


def rate_limited(df: DataFrame, stream: str, i: str, gain: str, attack: float, release: float) -> DataFrame:
    """A gain that falls ahead of a dip and recovers after it at limited rates.

    ``min over j >= i of g_j + attack * (j - i)``, then the same backwards with ``release``: two window minima.
    """
    by = Window.partitionBy(stream).orderBy(i)
    ahead = F.min(F.col(gain) + attack * F.col(i)).over(by.rowsBetween(0, Window.unboundedFollowing)) - attack * F.col(i)
    first = df.withColumn("__a", ahead)
    after = F.min(F.col("__a") - release * F.col(i)).over(by.rowsBetween(Window.unboundedPreceding, 0)) + release * F.col(i)
    return first.withColumn(gain, after).drop("__a")


def gated_loudness(df: DataFrame, stream: str, energy: str, gate: float = -70.0, relative: float = -10.0) -> DataFrame:
    """Integrated loudness of block energies per stream: mean over blocks past the absolute gate and the gate relative to their mean."""
    lufs = lambda z: -0.691 + 10 * F.log10(z)
    loud = df.withColumn("__l", lufs(F.col(energy))).filter(F.col("__l") >= gate)
    ungated = loud.withColumn("__m", lufs(F.avg(energy).over(Window.partitionBy(stream))))
    return ungated.filter(F.col("__l") > F.col("__m") + relative).groupBy(stream).agg(lufs(F.avg(energy)).alias("lufs"))


def word_level(df: DataFrame, stream: str, level: str, core: float = 10.0) -> DataFrame:
    """Mean energy, as a level, of the frames within ``core`` dB of the loudest of the group."""
    loudest = df.withColumn("__top", F.max(level).over(Window.partitionBy(stream)))
    return loudest.filter(F.col(level) >= F.col("__top") - core).groupBy(stream).agg((10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col(level) / 10)))).alias("level_db"))


def energy_gains(df: DataFrame, song: str, level: str, energy: str, range_db: float, tolerance: float, most: float, boost: float | None = None) -> DataFrame:
    """Adds target and gain: towards a line through the median section, outside a dead zone, within limits.

    No target with fewer than two levels in the song.
    """
    by = Window.partitionBy(song)
    offset = F.col(level) - range_db * F.col(energy)
    anchored = df.withColumn("__anchor", F.expr(f"percentile({level} - {range_db} * {energy}, 0.5)").over(by)).withColumn("__n", F.count(offset).over(by))
    target = F.when((F.col("__n") >= 2) & F.col(level).isNotNull(), F.col("__anchor") + range_db * F.col(energy))
    diff = F.col("target") - F.col(level)
    limit = F.when(diff > 0, F.lit(boost if boost is not None else most)).otherwise(F.lit(most))
    gain = F.when(F.abs(diff) > tolerance, F.signum(diff) * F.least(F.abs(diff) - tolerance, limit)).otherwise(0.0)
    return anchored.withColumn("target", target).withColumn("gain", F.coalesce(gain, F.lit(0.0))).drop("__anchor", "__n")


def quietest_point(df: DataFrame, stream: str, i: str, level: str, boundary: str, tolerance: float = 0.5) -> DataFrame:
    """The point nearest ``boundary`` in the quiet stretch nearest it: frames within ``tolerance`` of the minimum."""
    least = F.min(level).over(Window.partitionBy(stream))
    quiet = df.withColumn("__min", least)
    runs = runs_where(quiet, [stream], i, F.col(level) <= F.col("__min") + tolerance, F.first(boundary).alias("__b"))
    away = F.greatest(F.lit(0), F.col("first") - F.col("__b"), F.col("__b") - F.col("last"))
    point = F.least(F.greatest(F.col("__b"), F.col("first")), F.col("last"))
    return runs.groupBy(stream).agg(F.min_by(F.struct(point.alias("point"), F.col("first"), F.col("last")), F.struct(away, "first")).alias("p")).select(stream, "p.*")
