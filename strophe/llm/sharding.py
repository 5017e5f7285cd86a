"""K-d tree sharding over document metadata.

A node of the tree is a set of documents; it is split along the dimension in which it is widest (its
range over the range of all documents) at the weighted median, until every leaf holds its share of the
bytes.  All nodes of a level are split at once.  The median is found by narrowing: bytes are summed per
node and value of the leading bits of a 63-bit key (31 bits of coordinate, 32 bits of hash against
ties), the value that holds the middle is opened with the next bits, and so on; only these sums move,
``MOST_COUNTS`` of them at most.  No step sorts or gathers the rows of a node.

Dimensions: id, size, and the ranks of source and language among their values.  Ties are broken by a hash of
id, text, source and language; rows equal in all of these are numbered, so neither file splits nor cores nor the order
of rows matter: a rerun gives the same shards and slots.

Defined cases: null text has size 1 and checksum 0; null ids have coordinate 0; null sources and languages come first;
equal rows are told apart by their numbers alone; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, if_small, materialise, n_bytes, new_path, ranks, scratch

DIMS = ("d_id", "d_size", "d_source", "d_lang")
KEY_BITS = 63
MOST_COUNTS = 1 << 17
SLOT_ROWS = 20_000


def _ranked(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the rank of a column's value as a coordinate."""
    known = materialise(ranks(rows, column).withColumnsRenamed({column: "__v", "rank": name}), "shard-ranks")
    return rows.join(if_small(known), rows[column].eqNullSafe(known["__v"]), "left").drop("__v").withColumn(name, F.col(name).cast("double"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``tie``: a hash that tells all rows apart; rows equal in ``same`` are numbered, each split of the table on its own."""
    split = F.shiftrightunsigned("rid", 33)
    counts = rows.groupBy("same", split.alias("split")).agg(F.count("*").alias("n"))
    by_same = Window.partitionBy("same")  # a row per split of the table
    before = F.sum("n").over(by_same.orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    repeated = counts.withColumn("all", F.sum("n").over(by_same)).withColumn("before", F.coalesce(before, F.lit(0))).filter("all > 1")
    repeated = materialise(repeated.select("same", "split", "before"), "shard-repeats")
    marked = rows.withColumn("split", split).join(if_small(repeated), ["same", "split"], "left")
    inside = F.row_number().over(Window.partitionBy("same", "split").orderBy("rid")) - 1
    again = marked.filter("before IS NOT NULL").withColumn("number", F.col("before") + inside)
    every = marked.filter("before IS NULL").withColumn("number", F.lit(0).cast("long")).unionByName(again)
    return every.withColumn("tie", F.xxhash64("same", "number")).drop("same", "split", "before", "number")


def metadata(docs: DataFrame, rid: Column | None = None) -> DataFrame:
    """The metadata of every row, without texts, written once; all rows are in the root node.  ``rid`` numbers the rows."""
    size = n_bytes(F.col("text")) + 1
    rows = docs.select(
        (F.monotonically_increasing_id() if rid is None else rid).alias("rid"), "doc_id", size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("double").alias("d_id"), size.cast("double").alias("d_size"), "source", "lang", F.xxhash64("doc_id", F.xxhash64("text"), "source", "lang").alias("same"),
    )
    rows = _numbered(materialise(rows, "shard-rows"))
    rows = _ranked(_ranked(rows, "source", "d_source"), "lang", "d_lang")
    return materialise(rows.drop("source", "lang").withColumn("node", F.lit(0)), "shard-meta")


def _by_node(values: dict[int, float], leaves: int, kind: type) -> Column:
    """The value of a row's node, from an array in the plan: nodes are no more than leaves."""
    every = np.zeros(leaves, dtype=kind)
    for node, value in values.items():
        every[node] = value
    return F.element_at(F.lit(every), F.col("node") + 1)


def _key(dim: Column, lo: Column, hi: Column) -> Column:
    """31 bits of the coordinate inside the node's range, then 32 bits of hash."""
    at = F.element_at(F.array(*DIMS), dim)
    coordinate = F.coalesce(F.floor(F.try_divide(at - lo, hi - lo) * ((1 << 31) - 1)), F.lit(0)).cast("long")
    return F.shiftleft(coordinate, 32) + F.pmod("tie", F.lit(1 << 32))


def _medians(rows: DataFrame, key: Column, goals: dict[int, float], leaves: int) -> dict[int, int]:
    """Per node the key at which the running size reaches the goal, by narrowing.

    Each step counts bytes per node and value of the next bits, so few that all nodes' counts are ``MOST_COUNTS`` at most.
    """
    found, below, left = dict.fromkeys(goals, 0), dict.fromkeys(goals, 0), KEY_BITS
    bits = max(1, int(math.log2(MOST_COUNTS / max(1, len(goals)))))
    while left:
        step = min(bits, left)
        inside = rows if left == KEY_BITS else rows.filter(F.shiftrightunsigned(key, left) == _by_node(found, leaves, np.int64))
        place = F.shiftrightunsigned(key, left - step).bitwiseAND((1 << step) - 1)
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in inside.groupBy("node", place.alias("b")).agg(F.sum("size").alias("w")).collect():
            counts.setdefault(r["node"], []).append((r["b"], r["w"]))
        for node, buckets in counts.items():
            buckets.sort()
            for b, w in buckets:
                if below[node] + w >= goals[node] or b == buckets[-1][0]:
                    found[node] = found[node] << step | b
                    break
                below[node] += w
        left -= step
    return found


def kd_leaves(meta: DataFrame, leaves: int) -> DataFrame:
    """``meta`` with ``shard``: leaves numbered from 0 in tree order, near equal in size.

    A node is known by its first leaf; one for k leaves gives floor(k / 2) of k parts of its weight to the left.  What the
    driver holds is bounded by the number of leaves, never by rows.
    """
    own = [c for c in meta.columns if c != "node"]
    spans = meta.agg(*((F.max(d) - F.min(d)).alias(d) for d in DIMS)).first()
    placed, todo = meta, {0: leaves}
    while todo := {n: k for n, k in todo.items() if k > 1}:
        ends = [f(d).alias(f"{name}_{d}") for d in DIMS for name, f in (("min", F.min), ("max", F.max))]
        active = placed.filter(_by_node(dict.fromkeys(todo, 1), leaves, np.int32) == 1)
        nodes = {r["node"]: r for r in active.groupBy("node").agg(F.sum("size").alias("weight"), *ends).collect()}
        if not nodes:
            break
        wide = lambda r, d: (r[f"max_{d}"] - r[f"min_{d}"]) / spans[d] if spans[d] else 0.0
        cut = {n: max(range(len(DIMS)), key=lambda i: (wide(r, DIMS[i]), -i)) for n, r in nodes.items()}
        low, high = ({n: r[f"{end}_{DIMS[cut[n]]}"] for n, r in nodes.items()} for end in ("min", "max"))
        key = _key(_by_node({n: i + 1 for n, i in cut.items()} | {n: 1 for n in range(leaves) if n not in cut}, leaves, np.int32), _by_node(low, leaves, np.float64), _by_node(high, leaves, np.float64))
        medians = _medians(active, key, {n: r["weight"] * (todo[n] // 2) / todo[n] for n, r in nodes.items()}, leaves)
        half = {n: todo[n] // 2 for n in nodes}
        right = (_by_node(half, leaves, np.int32) > 0) & (key > _by_node(medians, leaves, np.int64))
        moved = placed.select(*own, F.when(right, F.col("node") + _by_node(half, leaves, np.int32)).otherwise(F.col("node")).alias("node"))
        before, placed = placed, materialise(moved, "shard-level")
        if before is not meta:
            drop_table(before)
        todo = {m: k for n in nodes for m, k in ((n, half[n]), (n + half[n], todo[n] - half[n]))}
    return placed.select(*own, F.col("node").alias("shard"))


def with_slots(placed: DataFrame) -> DataFrame:
    """``placed`` with ``slot``, gapless from 0 in each shard: ranges of ids are counted, offset and numbered on their own."""
    counts = placed.groupBy("shard").agg(F.count("*").alias("__rows")).withColumn("__parts", F.ceil(F.col("__rows") / SLOT_ROWS))
    counts = materialise(counts, "shard-counts")
    dealt = placed.join(if_small(counts), "shard").withColumn("__part", F.pmod(F.shiftrightunsigned("tie", 32), F.col("__parts")))
    sizes = dealt.groupBy("shard", "__part").agg(F.count("*").alias("__c"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(sizes.select("shard", "__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before")), "shard-offsets")
    number = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("tie"))
    numbered = dealt.withColumn("__i", number)
    return numbered.join(if_small(offsets), ["shard", "__part"]).select(*placed.columns, (F.col("__before") + F.col("__i") - 1).cast("long").alias("slot"))


def shard_rows(docs: DataFrame, leaves: int = 8) -> DataFrame:
    """Shard and slot of every row; the law that holds is equal bytes."""
    out = with_slots(kd_leaves(metadata(docs), leaves))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, leaves: int = 8) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot``, which replace columns of these names."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    base = materialise(docs.select(F.struct(*own).alias("__row"), F.monotonically_increasing_id().alias("rid")), "shard-docs")
    fields = [F.col(f"__row.{c}").alias(c) for c in ("doc_id", "text", "source", "lang")]
    path = new_path(docs.sparkSession, "shard-slots")
    with scratch(docs.sparkSession):  # the levels of the tree go, and the slots stay
        placed = with_slots(kd_leaves(metadata(base.select(*fields, "rid"), F.col("rid")), leaves))
        placed = materialise(placed.select("rid", F.col("shard").cast("int").alias("shard"), "slot"), "shard-slots", path=path)
    return base.join(placed.hint("merge"), "rid").select("__row.*", "shard", "slot")  # a row of each document: never broadcast


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard, its rows in files in the order of their slots."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def leaves_for(docs: DataFrame, target_bytes: int) -> int:
    """How many leaves reach the target bytes."""
    total = docs.agg(F.sum(n_bytes(F.col("text")) + 1)).first()[0] or 0
    return max(1, math.ceil(total / target_bytes))


def shards_of_bytes(docs: DataFrame, target_bytes: int) -> DataFrame:
    """Like :func:`shard_rows`, split until leaves reach the target bytes."""
    return shard_rows(docs, leaves_for(docs, target_bytes))
