"""SimHash near-duplicates with a covering code as anchors.

Fingerprints: 64 bits, each the majority of that bit over the XXH64 hashes of the word shingles.
Two fingerprints within ``THRESHOLD`` bits have a 32-bit half within ``THRESHOLD // 2``.  The anchors of a
half are the words of the (31, 26) Hamming code times one free bit: every half lies within ``RADIUS`` (1) of its
home anchor.  Each distinct fingerprint goes to every anchor within radius plus threshold of its halves, and at
each anchor those at home there are compared with all that came.  So no link is lost, and fingerprints meet
only where they are near.  Copies share a fingerprint and are one row here.  At an anchor only a spanning
forest of the links leaves the task, and components are found by star rounds over the edge table.

Defined cases: null, empty and blank texts have fingerprint 0 and link like any other; texts of fewer words
than a shingle are one shingle; rows of equal id are linked by their fingerprints as any rows; a null id never
names a component unless all ids in it are null; an empty table gives an empty result; other columns pass
through :func:`deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, materialise
from .graph import components

SHINGLE = 4
THRESHOLD = 4
SEED = 42
RADIUS = 1
HALF_THRESHOLD = THRESHOLD // 2
PART_BYTES = 32 << 20
PAIRS_AT_ONCE = 1 << 20
#: A-Z to a-z, and the blanks that separate words to a space.
FOLD = bytes(range(256)).translate(bytes(32 if c in b"\t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256)))


def hashes_of(text: str | None, shingle: int = SHINGLE) -> bytes:
    """XXH64 digests (8 bytes, big-endian) of the shingles of a text, in order."""
    ws = (text or "").encode().translate(FOLD).split(b" ")
    ws = [w for w in ws if w]
    if not ws:
        return b""
    joined, digest = b" ".join(ws), xxhash.xxh64_digest
    if len(ws) <= shingle:
        return digest(joined, SEED)
    ends = list(accumulate(map(len, ws), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """Fingerprint as 8 bytes, big-endian; bit i is set if more than half of the hashes have it."""
    return majority(hashes_of(text, shingle))


def majority(hashes: bytes) -> bytes:
    """The fingerprint of the digests that :func:`hashes_of` gives."""
    digests = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), 1 << 15):
        ones += np.unpackbits(digests[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(digests)).tobytes() if len(digests) else bytes(8)


def with_fingerprints(docs: DataFrame, name: str = "fp") -> DataFrame:
    """``docs`` (with a column text) and a long with the bits of each row's fingerprint; texts are dropped if they are last used here."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema.fields if f.name != 'text')}, `{name}` bigint"
    texts_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.frombuffer(b"".join(fingerprint(t) for t in batch.column(texts_at).to_pylist()), dtype=">i8").astype(np.int64)
            rest = [c for i, c in enumerate(batch.columns) if i != texts_at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(prints)], names=[*(n for n in batch.schema.names if n != "text"), name])

    return docs.mapInArrow(run, schema)


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Of the Hamming code over bits 0 to 30: bit i has column i + 1; bit 31 is free."""
    out = np.zeros(half.shape, dtype=np.uint32)
    for row in range(5):
        mask = np.uint32(sum(1 << i for i in range(31) if (i + 1) >> row & 1))
        out |= (np.bitwise_count(half & mask).astype(np.uint32) & np.uint32(1)) << np.uint32(row)
    return out


def _home(half: np.ndarray) -> np.ndarray:
    s = _syndrome(half)
    flip = np.where(s > 0, np.uint32(1) << np.maximum(s, 1).astype(np.uint32) - np.uint32(1), np.uint32(0))
    return half ^ flip


def _masks(reach: int) -> np.ndarray:
    """Row s: what leads from a half of syndrome s to each anchor within ``reach``."""
    words = [sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(range(32), n)]
    by: list[list[int]] = [[] for _ in range(32)]
    for w, s in zip(words, _syndrome(np.array(words, dtype=np.uint32)), strict=True):
        by[s].append(w)
    wide = max(map(len, by))
    return np.array([x + [x[0]] * (wide - len(x)) for x in by], dtype=np.uint32)


def _halves(prints: np.ndarray) -> list[np.ndarray]:
    bits = prints.view(np.uint64)
    return [(bits >> np.uint64(32)).astype(np.uint32), bits.astype(np.uint32)]


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Spreads anchors over parts."""
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


ENTRY = np.dtype([("anchor", "<u8"), ("fp", "<i8")])


def _replicas(prints: np.ndarray, masks: np.ndarray) -> np.ndarray:
    out = []
    for block, half in enumerate(_halves(prints)):
        anchors = (half[:, None] ^ masks[_syndrome(half)]).astype(np.uint64) | np.uint64(block << 32)
        entries = np.empty(anchors.size, dtype=ENTRY)
        entries["anchor"], entries["fp"] = anchors.ravel(), np.repeat(prints, masks.shape[1])
        out.append(entries)
    return np.concatenate(out)


def _forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def links_at(entries: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the links among entries that share an anchor, home ones against all."""
    entries = entries[np.argsort(entries["anchor"], kind="stable")]
    anchors, prints = entries["anchor"], np.ascontiguousarray(entries["fp"])
    first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]) if len(anchors) else np.empty(0, dtype=np.int64)
    sizes = np.diff(np.r_[first, len(anchors)])
    halves = _halves(prints)
    at_home = np.where(anchors >> np.uint64(32) == 0, _home(halves[0]), _home(halves[1])).astype(np.uint64) == (anchors & np.uint64(0xFFFFFFFF))
    group = np.repeat(np.arange(len(first)), sizes)
    homes = np.flatnonzero(at_home & (sizes[group] > 1)) if len(anchors) else first
    parent: dict[int, int] = {}
    kept: list[tuple[int, int]] = []
    lengths = sizes[group[homes]] if len(homes) else np.empty(0, dtype=np.int64)
    cuts = np.searchsorted(np.cumsum(lengths), np.arange(PAIRS_AT_ONCE, lengths.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE), side="left") + 1
    at = 0
    for cut in np.unique(np.minimum(cuts, len(homes))):
        h, n = homes[at:cut], lengths[at:cut]
        at = cut
        if not len(h):
            continue
        left = np.repeat(h, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[group[h]], n)
        a, b = prints[left], prints[right]
        near = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= threshold)
        if near.any():
            pairs = np.unique(np.stack([np.minimum(a[near], b[near]), np.maximum(a[near], b[near])]), axis=1)
            kept += _forest(pairs[0], pairs[1], parent)
    return kept


def linked(prints: DataFrame) -> DataFrame:
    """Edges (fp_a, fp_b) among the distinct fingerprints ``prints`` (one long column fp) that keep every component together."""
    return reduce(DataFrame.unionByName, linked_in_rounds(prints))


def linked_in_rounds(prints: DataFrame, limit: int | None = None) -> list[DataFrame]:
    """The edges of :func:`linked` by anchors: each table sends at most about ``limit`` bytes; without one there is one table."""
    masks = _masks(RADIUS + HALF_THRESHOLD)
    total = prints.count() * 2 * masks.shape[1] * ENTRY.itemsize
    parts = buckets_for(total, PART_BYTES, 8)
    step = -(-parts // (buckets_for(total, limit, 1) if limit else 1))

    def replicate(lo: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                entries = _replicas(batch.column(0).to_numpy(), masks)
                part = (_mixed(entries["anchor"]) % np.uint64(parts)).astype(np.int32)
                if step < parts:
                    own = (part >= lo) & (part < lo + step)
                    entries, part = entries[own], part[own]
                order = np.argsort(part, kind="stable")
                entries, part = entries[order], part[order]
                ends = np.searchsorted(part, np.arange(lo, lo + step + 1))
                full = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays([pa.array((lo + full).astype(np.int32)), pa.array([entries[ends[p] : ends[p + 1]].tobytes() for p in full], type=pa.binary())], names=["part", "blob"])

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [np.frombuffer(x, dtype=ENTRY) for batch in batches for x in batch.column("blob").to_pylist()]
        kept = links_at(np.concatenate(blobs)) if blobs else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], type=pa.int64()), pa.array([y for _, y in kept], type=pa.int64())], names=["fp_a", "fp_b"])

    return [prints.mapInArrow(replicate(lo), "part int, blob binary").groupBy("part").applyInArrow(compare, "fp_a bigint, fp_b bigint") for lo in range(0, parts, step)]


def fingerprint_components(printed: DataFrame) -> DataFrame:
    """(fp, root, component_id) from (doc_id, fp): a fingerprint that names the component, and the least id among all documents in it."""
    first = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp-first")
    edges = materialise(linked(first.select("fp")), "fp-edges")
    # components over fingerprints, then the least id of each
    stars = materialise(components(edges.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))), "fp-stars")
    rooted = first.join(stars, first["fp"] == stars["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def simhash_rows(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every row."""
    printed = materialise(with_fingerprints(docs.select("doc_id", "text")), "fp")
    found = printed.join(materialise(fingerprint_components(printed), "fp-components"), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the least id, the first of repeated rows."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    base = materialise(docs.select(F.struct(*names).alias("__row"), F.monotonically_increasing_id().alias("rid")), "dedup-docs")
    printed = materialise(with_fingerprints(base.select("rid", F.col("__row.doc_id").alias("doc_id"), F.col("__row.text").alias("text"))), "fp")
    found = printed.join(fingerprint_components(printed), "fp")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")).alias("k"))
    return base.join(first.select("k.rid"), "rid", "left_semi").select("__row.*")
