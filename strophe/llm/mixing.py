"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words; its rate (target over size) gives every document ``floor(rate)`` whole
copies and a fractional one.  Fractions are rounded by the pivotal method with sizes as weights: two
fractional documents trade mass (size times fraction stays), in one of two directions drawn so that both
expectations hold, until one fraction is 0 or 1; the other goes on.  Documents are dealt into chunks of
about ``CHUNK`` by a hash; each chunk is one ordered fold that leaves at most one fractional document, and
the residuals are dealt into chunks again: a reduction tree of ``log_CHUNK`` levels.  The last residual of a
source is rounded to the nearer end, so a source misses its target by half a document at most.

Draws are hashes of ids and the seed, chunks sort by hash, so reruns agree.  Only DataFrame functions are
used.  Defined cases: null or blank text has size 0 and takes nothing; a null source is a source of its own,
last in order; chunks sort by hash of id and text, then by size, so only rows equal in both are interchangeable; an
empty table gives an empty result; other columns pass through :func:`mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import if_small, materialise, n_words, new_path, scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
CHUNK = 256
SEED = 20_240_601
EPS = 1e-9


def weighted(sizes: DataFrame, key: str = "__source") -> DataFrame:
    """Target words per source: by weight, none above ``CEILING`` times its size, the excess reshared by weight.

    Filling up by weight stops at the level ``t`` where the sum of min(weight * t, ceiling) is the whole
    share; sources in the order of ceiling / weight reach their ceiling first, so running sums give it.
    """
    order = Window.orderBy(F.col(key).isNull(), F.col(key))  # one row per source; strings compare by code point
    ranked = sizes.withColumn("__w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    total = Window.partitionBy()
    filled = ranked.withColumn("__full", CEILING * F.col("source_size")).withColumn("__want", SHARE * F.sum("source_size").over(total))
    by_level = Window.orderBy((F.col("__full") / F.col("__w")), F.col(key).isNull(), F.col(key))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    full_before = F.coalesce(F.sum("__full").over(before), F.lit(0.0))
    weight_left = F.sum("__w").over(total) - F.coalesce(F.sum("__w").over(before), F.lit(0))
    levels = filled.withColumn("__t", (F.col("__want") - full_before) / weight_left).withColumn("__own", F.col("__full") / F.col("__w")).withColumn("__rank", F.row_number().over(by_level))
    fits = F.col("__t") <= F.col("__own")
    level = F.min_by(F.when(fits, F.col("__t")), F.when(fits, F.col("__rank"))).over(total)
    return levels.withColumn("target", F.least(F.col("__full"), F.coalesce(level, F.col("__own")) * F.col("__w"))).select(key, "source_size", "target")


def _draw(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _fold(chunk: Column) -> Column:
    """One pass over a chunk, sorted: ``live`` is the fractional document (or none), ``done`` the decided ones."""
    item = "struct<h:bigint,s:bigint,rid:bigint,p:double>"
    start = F.struct(F.lit(None).cast(item).alias("live"), F.array().cast("array<struct<rid:bigint,bit:int>>").alias("done"))

    def moved(a: Column, b: Column) -> Column:
        """Fractions of the two after the trade: a up and b down by ``up``, or the reverse by ``down``."""
        up = F.least(a["s"] * (1 - a["p"]), b["s"] * b["p"])
        down = F.least(a["s"] * a["p"], b["s"] * (1 - b["p"]))
        rise = _draw(a["h"], b["h"]) * (up + down) < down
        d = F.when(rise, up).otherwise(-down)
        clean = lambda p: F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)
        return F.struct(clean(a["p"] + d / a["s"]).alias("a"), clean(b["p"] - d / b["s"]).alias("b"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["live"]
        with_p = lambda x, p: F.struct(x["h"].alias("h"), x["s"].alias("s"), x["rid"].alias("rid"), p.alias("p"))
        open_ = lambda p: (p > 0) & (p < 1)
        decided = lambda x, p: F.struct(x["rid"].alias("rid"), p.cast("int").alias("bit"))

        def after(m: Column) -> Column:
            live = F.when(open_(m["a"]), with_p(a, m["a"])).when(open_(m["b"]), with_p(b, m["b"]))
            out = F.filter(F.array(F.when(~open_(m["a"]), decided(a, m["a"])), F.when(~open_(m["b"]), decided(b, m["b"]))), lambda x: x.isNotNull())
            return F.struct(live.cast(item).alias("live"), F.concat(acc["done"], out).alias("done"))

        traded = F.element_at(F.transform(F.array(moved(a, b)), after), 1)
        return F.when(a.isNull(), F.struct(b.cast(item).alias("live"), acc["done"].alias("done"))).otherwise(traded)

    return F.aggregate(chunk, start, step)


def taken_copies(sized: DataFrame, name: str = "mix") -> DataFrame:
    """(rid, copies) from (rid, h, __source, size, source_size, target); sizes of 0 take no copies."""
    rate = F.least(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(CEILING))
    rated = sized.filter("size > 0").withColumn("__rate", rate).withColumn("__whole", F.floor(F.col("__rate") + EPS))
    part = F.greatest(F.col("__rate") - F.col("__whole"), F.lit(0.0))
    rows = rated.select("rid", "h", "__source", "size", "source_size", F.col("__whole").cast("int").alias("whole"), F.when(part > EPS, part).otherwise(0.0).alias("p"))
    sources = rows.filter("p > 0").groupBy("__source").agg(F.count("*").alias("__n"))
    sources = materialise(sources, f"{name}-counts")
    most = sources.agg(F.max("__n")).first()[0] or 0
    level = materialise(rows.filter("p > 0").select("rid", "h", "__source", F.col("size").alias("s"), "p"), f"{name}-level")
    bits, depth = [], 0
    while most:
        hashed = level.join(if_small(sources), level["__source"].eqNullSafe(sources["__source"])).select("rid", level["__source"], "s", "p", "__n", F.xxhash64(F.lit(depth + SEED), "h").alias("h"))
        chunk = F.pmod(F.shiftrightunsigned(F.col("h"), 20), F.ceil(F.col("__n") / CHUNK))
        folded = hashed.groupBy("__source", chunk.alias("c")).agg(_fold(F.array_sort(F.collect_list(F.struct("h", "s", "rid", "p")))).alias("f"))
        folded = materialise(folded.select("__source", "f.live", "f.done"), f"{name}-level")
        bits.append(folded.select(F.explode("done").alias("d")).select("d.*"))
        last = most <= CHUNK
        level = folded.filter("live is not null").select("live.rid", "live.h", "__source", "live.s", "live.p")
        if last:
            bits.append(level.select("rid", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("bit")))
            break
        sources = materialise(level.groupBy("__source").agg(F.count("*").alias("__n")), f"{name}-counts")
        depth += 1
        most = sources.agg(F.max("__n")).first()[0] or 0
    every = rows.select("rid", F.col("whole").alias("bit"))
    for b in bits:
        every = every.unionByName(b)
    return every.groupBy("rid").agg(F.sum("bit").cast("int").alias("copies"))


def _hash() -> Column:
    return F.xxhash64(F.lit(SEED), "doc_id", F.xxhash64("text")).alias("h")


def sized(docs: DataFrame) -> DataFrame:
    """Size in words, source and a fixed row number of every row, written once."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("source").alias("__source"), n_words(F.col("text")).alias("size"), _hash()), "mix-sizes")


def mix_rows(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes."""
    return _mix(sized(docs)).select("doc_id", "size", "source_size", "target", "taken")


def _mix(rows: DataFrame) -> DataFrame:
    targets = materialise(weighted(rows.groupBy("__source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    joined = rows.join(if_small(targets), rows["__source"].eqNullSafe(targets["__source"])).select(rows["*"], "source_size", "target")
    copies = taken_copies(joined)
    out = joined.join(copies, "rid", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns."""
    base = materialise(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.monotonically_increasing_id().alias("rid"), n_words(F.col("text")).alias("size"), F.col("source").alias("__source"), _hash()), "mix-docs")
    # folds and levels are many small tables: they go, and the copies stay
    path = new_path(docs.sparkSession, "mix-copies")
    with scratch(docs.sparkSession):
        copies = materialise(_mix(base.drop("__row")).filter("copies > 0").select("rid", "copies"), "mix-copies", path=path)
    return base.join(copies.hint("merge"), "rid").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
