"""Near-duplicates by SimHash over word shingles, checked by exact Jaccard similarity; what SimHash leaves out is found exactly.

Candidates come first from the operator of ``simhash``: fingerprints over the same shingles, covering-code anchors, links
within its threshold.  At a similarity of 0.8 many pairs lie farther apart, so prefixes find all others.  Two sets of similarity s or more share k of the first ``n - ceil(s n) + k`` elements of each, in any fixed order
of all shingles (prefix filter).  The order puts shingles that are common in a sample last and breaks ties by hash;
it decides how many candidates there are, never the result.  k grows with the set (:func:`needed`): long texts of
one language meet at some shingle by chance, hardly at several.  Prefixes meet by shingle:

1. Each goes to the smallest and to the largest set of about its size there and to two by chance (stars); what
   holds, and what holds of SimHash's links, is linked.
2. All pairs at a shingle that the links of step 1 do not hold together already are compared, unless their sizes or
   parity sketches prove that they are too far apart.

So a large group of near copies costs a few comparisons a member, and no pair of two components is left out.
Candidates are verified on whole sets.  Equal sets are one node.

The share of places at which texts meet grows with the table, so every place is sent with what prunes a pair there,
and places and sets to verify travel in rounds of at most ``1 / ROUNDS`` of the texts' bytes: the disk used at once is
a fixed multiple of the input.

Defined cases: null, empty and blank texts have the empty set and are copies of each other; texts of fewer words
than a shingle are one shingle; a null id is kept only where all ids of its component are null; an empty table
gives an empty result; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, drop_table, materialise, materialise_all, total_bytes
from .graph import components
from .simhash import _mixed, hashes_of, linked_in_rounds, majority

SHINGLE = 5
#: Least similarity, in percent.
SIMILAR = 80
SAMPLE_ROWS = 20_000
COMMON_KEPT = 100_000
PART_BYTES = 32 << 20
PAIRS_AT_ONCE = 1 << 18
PARITY_BITS = 512
#: What is sent at once is at most the texts' bytes divided by this, and at least ROUND_BYTES.
ROUNDS = 2
ROUND_BYTES = 256 << 20
#: A set must share one more place of its prefix for each so many elements, up to MOST_NEEDED.
PLACE_EACH = 250
MOST_NEEDED = 8
ENTRY = np.dtype([("shingle", "<u8"), ("node", "<i8"), ("n", "<u4"), ("at", "<u4"), ("group", "<i8"), ("parity", "<u8", (PARITY_BITS // 64,))])
PAIRS = "a bigint, b bigint, times bigint, needed bigint, size bigint"


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles of a text, ascending."""
    return distinct(hashes_of(text, shingle))


def distinct(hashes: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(hashes, dtype=">u8").astype("<u8"))


def needed(n):
    """How many places of their prefixes two sets must share, by the size of the smaller one."""
    return 1 + np.minimum(n // PLACE_EACH, MOST_NEEDED - 1)


def prefix_length(n: int, similar: int = SIMILAR) -> int:
    return min(n, n + int(needed(n)) + -similar * n // 100) if n else 0


def parity(own: np.ndarray) -> bytes:
    """Bit i is set if an odd number of elements is i modulo the bits: two sets differ in at least as many elements as bits."""
    return np.packbits(np.bincount((own % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1).tobytes()


def alike(a: np.ndarray, b: np.ndarray, similar: int = SIMILAR) -> bool:
    """Have two sets (ascending) the least similarity?"""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= similar * (len(a) + len(b) - shared)


def common_shingles(base: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, ascending, and how often they are there; they only order the prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle).view(np.int64))], names=["s"])

    every = max(1, base.count() // SAMPLE_ROWS)
    sample = base.filter(F.pmod(F.xxhash64("rid"), F.lit(every)) == 0).select("text")
    rows = sample.mapInArrow(run, "s bigint").groupBy("s").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "s").limit(COMMON_KEPT).toArrow()
    found, n = rows.column("s").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


def with_prefixes(base: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int, similar: int) -> DataFrame:
    """(rid, doc_id, key, n, prefix, parity, fp) of (rid, doc_id, text): equal sets have equal keys, fp is the fingerprint."""
    known, often = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prefixes, parities, prints = [], [], [], [], []
            for text in batch.column(2):
                hashes = hashes_of(text.as_py(), shingle)
                prints.append(majority(hashes))
                own = distinct(hashes)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                parities.append(parity(own))
                if len(known) and len(own):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.argsort(np.where(known[at] == own, often[at], 0), kind="stable")]
                prefixes.append(own[: prefix_length(len(own), similar)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, type=pa.binary()), pa.array(sizes, type=pa.int64()), pa.array(prefixes, type=pa.binary()), pa.array(parities, type=pa.binary()), pa.array(np.frombuffer(b"".join(prints), dtype=">i8").astype(np.int64))], names=["rid", "doc_id", "key", "n", "prefix", "parity", "fp"])

    return base.select("rid", "doc_id", "text").mapInArrow(run, f"rid bigint, doc_id {dict(base.dtypes)['doc_id']}, key binary, n bigint, prefix binary, parity binary, fp bigint")


def _pairs(entries: np.ndarray, a: np.ndarray, b: np.ndarray, similar: int) -> np.ndarray:
    """Distinct pairs (a, b, times, needed, size) of entries that meet at a shingle: left out are those whose places, if they
    are among the first that they share, leave too few in common, and those whose parity sketches are too far apart."""
    na, nb = entries["n"][a].astype(np.int64), entries["n"][b].astype(np.int64)
    most = np.minimum(na - entries["at"][a], nb - entries["at"][b]) + needed(np.minimum(na, nb)) - 1
    good = ((100 + similar) * most >= similar * (na + nb)) & (entries["node"][a] != entries["node"][b])
    a, b, size = a[good], b[good], (na + nb)[good]
    apart = np.bitwise_count(entries["parity"][a] ^ entries["parity"][b]).sum(axis=1, dtype=np.int64)
    good = (100 + similar) * apart <= (100 - similar) * size
    a, b = a[good], b[good]
    x, y = entries["node"][a], entries["node"][b]
    pairs, first, times = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1, return_index=True, return_counts=True)
    na, nb = entries["n"][a[first]].astype(np.int64), entries["n"][b[first]].astype(np.int64)
    return np.stack([*pairs, times, needed(np.minimum(na, nb)), na + nb])


def star_pairs(entries: np.ndarray, similar: int = SIMILAR) -> Iterator[np.ndarray]:
    """Pairs of each entry with the first and the last at its shingle, by size, within reach of one another, and
    with its neighbours in an order by chance that is another at every shingle; a pair counts once at a shingle."""
    at_a, at_b = [], []
    for sign in (1, -1):
        order = np.lexsort((sign * entries["node"], sign * entries["n"].astype(np.int64), entries["shingle"]))
        shingle, n = entries["shingle"][order], entries["n"][order].astype(np.int64) * sign
        first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]]) if len(order) else np.empty(0, dtype=np.int64)
        head, bound = np.arange(len(order)), np.r_[first[1:], len(order)]
        for lo, hi in zip(first[bound - first > 1].tolist(), bound[bound - first > 1].tolist(), strict=True) if len(order) else ():
            sizes = n[lo:hi]
            at = 0
            while at < hi - lo:  # a new star where sizes leave the reach of the last
                limit = sizes[at] * 100 // similar if sign > 0 else sizes[at] * similar // 100
                to = max(at + 1, int(np.searchsorted(sizes, limit, side="right")))
                head[lo + at : lo + to] = lo + at
                at = to
        own = np.flatnonzero(head != np.arange(len(order)))
        at_a.append(order[head[own]])
        at_b.append(order[own])
    order = np.lexsort((_mixed(entries["node"].astype(np.uint64) ^ entries["shingle"]), entries["shingle"]))
    next_to = np.flatnonzero(entries["shingle"][order[1:]] == entries["shingle"][order[:-1]])
    at_a.append(order[next_to])
    at_b.append(order[next_to + 1])
    a, b = np.concatenate(at_a), np.concatenate(at_b)
    a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    yield _pairs(entries, a, b, similar)


def cross_pairs(entries: np.ndarray, similar: int = SIMILAR) -> Iterator[np.ndarray]:
    """All pairs at a shingle that are in different groups and can have enough in common."""
    e = entries[np.lexsort((entries["group"], entries["shingle"]))]
    if not len(e):
        return
    new = e["shingle"][1:] != e["shingle"][:-1]
    bound = np.r_[np.flatnonzero(new) + 1, len(e)]
    inner = np.r_[np.flatnonzero(new | (e["group"][1:] != e["group"][:-1])) + 1, len(e)]
    index = np.arange(len(e))
    begin = inner[np.searchsorted(inner, index, side="right")]  # where the next group begins
    n = bound[np.searchsorted(bound, index, side="right")] - begin
    some = np.flatnonzero(n)
    ends = np.cumsum(n[some])
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        own = some[at:to]
        a = np.repeat(own, n[own])
        b = np.arange(len(a)) - np.repeat(np.cumsum(n[own]) - n[own], n[own]) + np.repeat(begin[own], n[own])
        yield _pairs(e, a, b, similar)
        at = to


def candidates(nodes: DataFrame, stars: bool, similar: int, limit: int) -> DataFrame:
    """Distinct pairs (a, b, size), a < b, of nodes (node, n, prefix, parity, group) that share as many places as they need.

    Places travel in rounds by their shingle, at most about ``limit`` bytes in each.
    """
    total = int(nodes.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0) * ENTRY.itemsize
    parts = buckets_for(total, PART_BYTES, 8)
    step = -(-parts // buckets_for(total, limit, 1))

    def deal(lo: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blobs = batch.column("prefix").to_pylist()
                lengths = np.array([len(b) // 8 for b in blobs], dtype=np.int64)
                shingles = np.frombuffer(b"".join(blobs), dtype="<u8")
                part = (_mixed(shingles) % np.uint64(parts)).astype(np.int32)
                own = np.flatnonzero((part >= lo) & (part < lo + step))
                own = own[np.argsort(part[own], kind="stable")]
                row = np.repeat(np.arange(len(lengths)), lengths)[own]
                entries = np.empty(len(own), dtype=ENTRY)
                entries["shingle"], entries["at"] = shingles[own], own - (np.cumsum(lengths) - lengths)[row]
                for name in ("node", "n", "group"):
                    entries[name] = batch.column(name).to_numpy()[row]
                entries["parity"] = np.frombuffer(b"".join(batch.column("parity").to_pylist()), dtype="<u8").reshape(-1, PARITY_BITS // 64)[row]
                ends = np.searchsorted(part[own], np.arange(lo, lo + step + 1))
                full = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays([pa.array((lo + full).astype(np.int32)), pa.array([entries[ends[p] : ends[p + 1]].tobytes() for p in full], type=pa.binary())], names=["part", "blob"])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = np.frombuffer(b"".join(x for batch in batches for x in batch.column("blob").to_pylist()), dtype=ENTRY)
        _, back, count = np.unique(entries["shingle"], return_inverse=True, return_counts=True)
        entries = entries[count[back] > 1]
        for pairs in (star_pairs if stars else cross_pairs)(entries, similar):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b", "times", "needed", "size"])

    sent = nodes.select("node", "n", "prefix", "parity", "group")
    met = materialise_all((sent.mapInArrow(deal(lo), "part int, blob binary").groupBy("part").applyInArrow(meet, PAIRS) for lo in range(0, parts, step)), "near-met")
    enough = met.groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("needed").alias("needed"), F.max("size").alias("size"))
    pairs = materialise(enough.filter("times >= needed").select("a", "b", "size"), "near-pairs")
    drop_table(met)
    return pairs


def print_pairs(nodes: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b, size), a < b, of nodes (node, n, fp): each fingerprint's least node with its others, and across SimHash's links."""
    firsts = materialise(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("f")).select("fp", "f.node", "f.n"), "near-prints")
    edges = materialise_all(linked_in_rounds(firsts.select("fp"), limit), "near-edges").distinct()
    side = lambda s: firsts.select(F.col("fp").alias(f"fp_{s}"), F.col("node").alias(s), F.col("n").alias(f"n_{s}")).hint("merge")
    across = edges.join(side("a"), "fp_a").join(side("b"), "fp_b").select("a", "b", "n_a", "n_b")
    own = nodes.select(F.col("fp").alias("fp_a"), F.col("node").alias("b"), F.col("n").alias("n_b")).join(side("a"), "fp_a").filter("a <> b").select("a", "b", "n_a", "n_b")
    pairs = across.unionByName(own).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("n_a") + F.col("n_b")).alias("size"))
    found = materialise(pairs.distinct(), "near-printed")
    drop_table(firsts)
    drop_table(edges)
    return found


def verified(pairs: DataFrame, base: DataFrame, shingle: int, similar: int, limit: int) -> DataFrame:
    """The pairs (a, b, size) whose whole sets are alike, written as (a, b); sets travel in rounds of about ``limit`` bytes and go."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)], type=pa.binary())], names=["rid", "own"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8"), similar) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, type=pa.bool_()))

    rounds = buckets_for(int(pairs.agg(F.sum("size")).first()[0] or 0) * 8, limit, 1)

    def links() -> Iterator[DataFrame]:
        for i in range(rounds):
            some = pairs.filter(F.pmod(F.xxhash64("a"), F.lit(rounds)) == i).select("a", "b")
            met = some.select(F.col("a").alias("rid")).union(some.select("b")).distinct()
            known = materialise(base.select("rid", "text").join(met.hint("merge"), "rid", "left_semi").mapInArrow(sets, "rid bigint, own binary"), "near-sets")
            side = lambda s: known.select(F.col("rid").alias(s), F.col("own").alias(f"set_{s}")).hint("merge")  # noqa: B023, E731 (sets of unknown total size are never broadcast)
            both = some.join(side("b"), "b").join(side("a"), "a")
            yield both.select("a", "b", "set_a", "set_b").mapInArrow(check, "a bigint, b bigint")
            drop_table(known)

    return materialise_all(links(), "near-links")


def roots(base: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR, limit: int | None = None) -> DataFrame:
    """(rid, doc_id, root) of (rid, doc_id, text): rows of one root are connected by pairs of the least similarity.

    Only the result stays written: what a step needed goes as soon as the steps after it have run.  ``limit``: bytes
    that a round sends, by default a share of the texts'.
    """
    limit = limit or max(ROUND_BYTES, total_bytes(base) // ROUNDS)
    made = materialise(with_prefixes(base, common_shingles(base, shingle), shingle, similar), "near-prefixes")
    rows = materialise(made.select("rid", "doc_id", "key"), "near-rows")
    keys = materialise(rows.groupBy("key").agg(F.min("rid").alias("node")), "near-keys")
    first = keys.select(F.col("node").alias("rid")).hint("merge")
    nodes = materialise(made.filter("n > 0").join(first, "rid", "left_semi").select(F.col("rid").alias("node"), "n", "prefix", "parity", "fp"), "near-nodes")
    drop_table(made)
    printed = print_pairs(nodes.select("node", "n", "fp"), limit)
    starred = candidates(nodes.withColumn("group", F.col("node")), True, similar, limit)
    likely = materialise(printed.unionByName(starred).distinct(), "near-likely")
    drop_table(printed)
    drop_table(starred)
    first = verified(likely, base, shingle, similar, limit)
    held = materialise(components(first), "near-held")
    grouped = nodes.join(held.hint("merge"), "node", "left").select("node", "n", "prefix", "parity", F.coalesce("component", "node").alias("group"))
    grouped = materialise(grouped, "near-grouped")
    drop_table(nodes)
    met = candidates(grouped, False, similar, limit)
    rest = materialise(met.join(likely.select("a", "b"), ["a", "b"], "left_anti"), "near-rest")
    for done in (grouped, met, held, likely):
        drop_table(done)
    second = verified(rest, base, shingle, similar, limit)
    held = materialise(components(first.union(second)), "near-held")
    rooted = keys.join(held, "node", "left").select("key", F.coalesce("component", "node").alias("root"))
    found = materialise(rows.join(rooted, "key").select("rid", "doc_id", "root"), "near-roots")
    for done in (rest, first, second, held, keys, rows):
        drop_table(done)
    return found


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """One row of each component: that of the least id, the first of repeated rows."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    base = materialise(docs.select(F.struct(*names).alias("__row"), F.monotonically_increasing_id().alias("rid")), "dedup-docs")
    found = roots(base.select("rid", F.col("__row.doc_id").alias("doc_id"), F.col("__row.text").alias("text")), shingle, similar)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")).alias("k"))
    kept = materialise(first.select("k.rid"), "near-kept")
    drop_table(found)
    return base.join(kept.hint("merge"), "rid", "left_semi").select("__row.*")  # rows grow with the table: never broadcast
