"""Gaps, islands, interval unions and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def island_ids(df: DataFrame, keys: list[str], order: list[str], new: Column, name: str = "island") -> DataFrame:
    """Adds the number of the island a row is in; ``new`` (null counts as true) says that a row begins one."""
    by = Window.partitionBy(*keys).orderBy(*order)
    flag = F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)
    return df.withColumn("__new", flag).withColumn(name, F.sum("__new").over(by)).drop("__new")


def runs_where(df: DataFrame, keys: list[str], order: str, keep: Column, *also: Column) -> DataFrame:
    """Islands of consecutive rows for which ``keep`` holds: keys, first and last order value, count, and ``also`` aggregates."""
    by = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("__k", F.coalesce(keep, F.lit(False)))
    placed = marked.withColumn("__i", F.row_number().over(by) - F.sum(F.when(F.col("__k"), 1).otherwise(0)).over(by))
    return placed.filter("__k").groupBy(*keys, "__i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), *also).drop("__i")


def merged(df: DataFrame, keys: list[str], start: str, end: str, *also: Column) -> DataFrame:
    """Union of overlapping or touching intervals per key, with ``also`` aggregates over each union."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = island_ids(df.withColumn("__reach", reach), keys, [start, end], F.col(start) > F.col("__reach"), "__run")
    return numbered.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), *also).drop("__run")


def gaps(df: DataFrame, keys: list[str], start: str, end: str, total: DataFrame, total_col: str) -> DataFrame:
    """(keys, lo, hi): the stretches of [0, total] that no interval covers; intervals may overlap and nest."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.select(*keys, F.coalesce(F.max(end).over(before), F.lit(0)).alias("lo"), F.col(start).alias("hi"))
    tail = total.join(df.groupBy(*keys).agg(F.max(end).alias("lo")), keys, "left").select(*keys, F.coalesce("lo", F.lit(0)).alias("lo"), F.col(total_col).alias("hi"))
    return inner.unionByName(tail).filter("hi > lo")


def pauses(df: DataFrame, keys: list[str], start: str, end: str, after: float) -> DataFrame:
    """(keys, lo, hi): the stretches before and between intervals that none covers, and ``after`` behind the last end, in one pass over them."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.select(*keys, before.alias("__lo"), F.col(start).alias("__hi"), reach.alias("__reach"), F.lead(F.lit(True)).over(order).isNull().alias("__last"))
    span = lambda lo, hi: F.struct(F.col(lo).alias("lo"), hi.alias("hi"))
    own = span("__lo", F.col("__hi"))
    found = F.when(F.col("__last"), F.array(own, span("__reach", F.col("__reach") + after))).otherwise(F.array(own))
    return rows.select(*keys, F.explode(found).alias("__x")).select(*keys, "__x.*").filter("hi > lo")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: float) -> DataFrame:
    """Pairs whose intervals share more than an end point, by equality of key and bucket instead of a range condition alone.

    Both sides are copied to the buckets of ``width`` that they touch; a pair is kept in the first bucket it shares.
    Choose ``width`` near the longer typical interval: copies stay few and buckets small.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.greatest(F.col(lo), F.col(hi)) / width)))
    x = left.withColumn("__cell", cells(*a))
    y = right.withColumn("__cell", cells(*b))
    pairs = x.join(y, [*keys, "__cell"])
    first = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width)
    return pairs.filter((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (F.col("__cell") == first)).drop("__cell")


def containing_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, span: tuple[str, str], width: float, closed: bool = False) -> DataFrame:
    """Points with the spans that hold them: [start, end), or [start, end] if ``closed``."""
    x = points.withColumn("__cell", F.floor(F.col(at) / width))
    y = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(span[0]) / width), F.floor(F.greatest(F.col(span[0]), F.col(span[1])) / width))))
    inside = (F.col(at) <= F.col(span[1])) if closed else (F.col(at) < F.col(span[1]))
    return x.join(y, [*keys, "__cell"]).filter((F.col(at) >= F.col(span[0])) & inside).drop("__cell")


def repair_windows(holes: DataFrame, segments: DataFrame, keys: list[str], most: float, width: float = 60_000) -> DataFrame:
    """(keys, gap_start, gap_end, speech, start, end): holes widened to the segments that touch them, overlaps merged.

    Holes are (keys, lo, hi, speech), segments (keys, s, e, first, last) with the span of their words, null without any.  A segment whose words
    span an edge of a hole moves that edge to its own, ``most`` away at most.  A merged window has the gap's start of the first,
    the latest end and the sum of speech.
    """
    spoken = segments.filter("first IS NOT NULL")
    wide = holes.select(*keys, "lo", "hi", (F.col("lo") - 1).alias("__a"), (F.col("hi") + 1).alias("__b"))
    both = overlap_join(wide, spoken, keys, ("__a", "__b"), ("first", "last"), width)
    touches = lambda edge: F.col(edge).between(F.col("first"), F.col("last"))
    start = F.min(F.when(touches("lo") & (F.col("lo") - F.col("s") <= most), F.col("s"))).alias("__s")
    end = F.max(F.when(touches("hi") & (F.col("e") - F.col("hi") <= most), F.col("e"))).alias("__e")
    moved = holes.join(both.groupBy(*keys, "lo", "hi").agg(start, end), [*keys, "lo", "hi"], "left")
    windows = moved.select(*keys, "lo", "hi", "speech", F.least("lo", "__s").alias("start"), F.greatest("hi", "__e").alias("end"))
    out = merged(windows, keys, "start", "end", F.min_by("lo", F.struct("start", "lo")).alias("gap_start"), F.max("hi").alias("gap_end"), F.sum("speech").alias("speech"))
    return out.select(*keys, "gap_start", "gap_end", "speech", "start", "end")
