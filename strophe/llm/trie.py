"""The prefix trie of conversations.

A conversation is its turns in order, each known by the first 16 bytes of the SHA-256 of its role and text and by
the bytes of its text.  Turn arrays are sorted over all ranges by (turns, id), so a prefix comes right before
what extends it and the members of a node stand together.  Each range is swept once with a stack: the common
prefix of neighbours says which nodes end and which begin.  What a range can't finish are the prefixes of its first and
its last array: those *open* nodes are given out as parts, keyed by a hash of the prefix, with the counts this
range alone would have.  A boundary with ``l`` turns in common then corrects its nodes of depth up to ``l``, which both sides
took for new; all counts are sums, so parts and corrections are added up.

Defined cases: null role and text are empty; turns sort by turn (null first), equal ones by their digest; rows
with a null conversation id belong to no conversation; repeated rows are turns each; a conversation without turns ends in the
root; an empty table has no nodes; other columns play no part.  A conversation is one array of 24 bytes for each turn, whatever
the texts; ids that end in one node are hashed in order as they come, in pieces of ``PIECE`` ids where ranges meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, if_small, materialise

PIECE = 50_000
RANGE_BYTES = 32 << 20
NOTHING = hashlib.sha256(b"").hexdigest()
TURNS = "array<struct<digest:binary,size:bigint>>"


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def turn_arrays(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) from a row for each turn: digests and sizes in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = rows.filter("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"))  # nulls inside a struct come first
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(rows: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % ``family`` in place of its own; h = crc32(c) % ``most``."""
    arrays = turn_arrays(rows)
    first = arrays.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("opening"))
    own = arrays.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"))
    opening = F.coalesce(F.slice("opening", F.lit(1), F.col("h")), F.array().cast(TURNS))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(first, "base", "left").select("conv_id", F.concat(opening, rest).alias("turns"))


class Node:
    """A node on the stack; counts are those of this range alone."""

    __slots__ = ("ends", "kids", "least", "leaves", "left", "n", "pending", "saved", "size")

    def __init__(self, size: int, left: bool) -> None:
        self.size, self.left = size, left
        self.n = self.kids = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[int] = []
        self.pending: list[tuple] = []


def chain(digests: list[bytes]) -> list[bytes]:
    """Keys of all prefixes, from the empty one."""
    keys = [b""]
    for d in digests:
        keys.append(hashlib.sha256(keys[-1] + d).digest()[:16])
    return keys


def common(a: list, b: list) -> int:
    """Turns that two arrays have in common at their start."""
    if a == b:
        return len(a)
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


SWEPT = (
    "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "key binary, parent_key binary, ids binary, digests array<binary>, sizes array<bigint>"
)
ARROW = pa.schema(
    [(c, pa.string() if c in ("kind", "ends_sha256") else pa.int64()) for c in "kind conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()]
    + [("key", pa.binary()), ("parent_key", pa.binary()), ("ids", pa.binary()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))]
)


class Sweep:
    """Rows of one range, in order, to finished nodes (``node``), parts of open ones (``part``), their ids (``ends``) and the two edges."""

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.stack: list[Node] = []
        self.first = self.last = None
        self.keys: list[bytes] = []

    def add(self, conv_id: int, turns: list[dict]) -> None:
        now = [t["digest"] for t in turns]
        if self.first is None:
            self.first, self.keys = (conv_id, now, [t["size"] for t in turns]), chain(now)
            self.stack.append(Node(0, True))
            shared = 0
        else:
            shared = common(self.last[1], now)
        while len(self.stack) - 1 > shared:
            self.pop(None)
        left = len(self.stack) == 1 and self.last is None
        self.stack += [Node(t["size"], left) for t in turns[shared:]]
        top = self.stack[-1]
        top.ends.append(conv_id)
        self.last = (conv_id, now, turns)

    def pop(self, keys: list[bytes] | None) -> None:
        """The deepest node ends; at the end of the range ``keys`` are those of the nodes that stay open."""
        node, depth = self.stack.pop(), len(self.stack)
        parent = self.stack[-1] if self.stack else None
        node.n += len(node.ends)
        if node.ends and (node.least is None or node.least > min(node.ends)):
            node.least = min(node.ends)
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.size
        if keys is not None or node.left:
            own = self.keys if keys is None else keys
            above = own[depth - 1] if depth else None
            self.out.append(("part", node.least, depth, None, node.n, node.kids, node.leaves, node.saved, None, own[depth], above, None, None, None))
            for i in range(0, len(node.ends), PIECE):
                ids = ",".join(map(str, node.ends[i : i + PIECE])).encode()
                self.out.append(("ends", node.ends[i], depth, None, None, None, None, None, None, own[depth], None, ids, None, None))
            self.out += [(*r[:10], own[depth], *r[11:]) for r in node.pending]
        else:
            ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
            self.out += [(*r[:3], node.least, *r[4:]) for r in node.pending]
            row = ("node", node.least, depth, None, node.n, node.kids, node.leaves, node.saved, ends, None, None, None, None, None)
            if parent.left:
                self.out.append((*row[:10], self.keys[depth - 1], *row[11:]))
            else:
                parent.pending.append(row)
        if parent:
            parent.n += node.n
            parent.kids += 1
            parent.leaves += node.leaves
            parent.saved += node.saved
            parent.least = node.least if parent.least is None else min(parent.least, node.least)

    def end(self) -> None:
        if self.first is None:
            return
        keys = chain(self.last[1])
        while self.stack:
            self.pop(keys)
        for kind, (conv_id, digests, sizes) in (("first", self.first), ("last", (self.last[0], self.last[1], [t["size"] for t in self.last[2]]))):
            self.out.append((kind, conv_id, None, None, None, None, None, None, None, None, None, None, digests, sizes))


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), ARROW.types, strict=True)], schema=ARROW)


def swept(convs: DataFrame) -> DataFrame:
    """Range-sorts turn arrays and sweeps each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep()
        for batch in batches:
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sweep.add(conv_id, turns)
            yield from _batches(sweep.out)
            sweep.out = []
        sweep.end()
        yield from _batches(sweep.out)

    total = int(convs.agg(F.sum(24 * F.size("turns") + 16).cast("long")).first()[0] or 0)
    ranges = max(int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets_for(total, RANGE_BYTES))
    ordered = convs.select("conv_id", "turns").repartitionByRange(ranges, "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    return ordered.mapInArrow(run, SWEPT)


CORRECTION = "key binary, parent_key binary, depth long, n_children long, n_leaves long, saved_tokens long"


def corrections(edges: DataFrame) -> DataFrame:
    """What both sides of each boundary counted as new: a row for each depth that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for before, digests, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shared = common(before, digests)
                keys, saved = chain(digests[:shared]), 0
                for d in range(shared, -1, -1):
                    saved += sizes[d - 1] if d else 0
                    rows.append((keys[d], keys[d - 1] if d else None, d, -(d < shared), -(shared == len(before)), saved))
            kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=[c.split()[0] for c in CORRECTION.split(", ")])

    order = Window.orderBy("digests", "conv_id", F.col("kind") == "last")  # two rows of each range
    met = edges.withColumn("before", F.lag("digests").over(order)).filter("kind = 'first' AND before IS NOT NULL")
    return met.select("before", "digests", "sizes").mapInArrow(run, CORRECTION)


def ends_digests(pieces: DataFrame) -> DataFrame:
    """(key, ends_sha256) of open nodes: their ids are hashed piece after piece, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        give = lambda k, h: pa.RecordBatch.from_arrays([pa.array([k], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if now:
                        yield give(key, now)
                    key, now = k, hashlib.sha256(ids)
                else:
                    now.update(b"," + ids)
        if now:
            yield give(key, now)

    return pieces.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def trie_nodes(convs: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the turn arrays of ``convs`` (conv_id, turns)."""
    found = materialise(swept(convs), "trie")
    parts = found.filter("kind = 'part'").select("key", "parent_key", "depth", "conv_id", *COUNTS)
    fixes = corrections(found.filter("kind IN ('first', 'last')")).select("key", "parent_key", "depth", F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n_convs"), *COUNTS[1:])
    opened = parts.unionByName(fixes).groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.first("parent_key").alias("parent_key"), *(F.sum(c).alias(c) for c in COUNTS))
    opened = materialise(opened.join(ends_digests(found.filter("kind = 'ends'")), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "trie-open")
    parents = if_small(opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent")))
    out = ["conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256"]
    done = found.filter("kind = 'node'")
    hung = done.filter("parent_key IS NOT NULL").select("parent_key", *(c for c in out if c != "parent_conv_id"))
    hung = hung.unionByName(opened.select(*hung.columns)).join(parents, "parent_key", "left").withColumnRenamed("parent", "parent_conv_id")
    return done.filter("parent_key IS NULL").select(*out).unionByName(hung.select(*out))
