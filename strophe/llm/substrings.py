"""Exact substring deduplication by merging front-coded sorted runs of suffixes.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document of smaller id.

Suffixes are sampled so that all can be exchanged: a string of ``LENGTH`` bytes is known by its anchor, the
least hash among its ``GRAM``-byte substrings, and neighbouring starts share an anchor.  A suffix entry covers a
maximal run of starts with one anchor: the text from the first start to ``LENGTH`` bytes after the last.
Equal strings have equal anchors, so all their entries meet in one group, and nothing is lost.

* Documents are dealt into buckets by id.  Each bucket first sends only its anchors (32 bits of each, by
  part) and gets back those that another document has too; only entries of such anchors go on.  Entries of a
  crowded anchor (``CROWDED`` entries or more) are split: each of their starts becomes an entry of its own, whose
  anchor is the hash of its whole string, so no group grows with the corpus.
* Each bucket sorts its entries by (anchor, text).  Entries with equal text are settled in the run: all but the
  smallest id go; so a passage of any number of copies leaves each run once.  Runs are front-coded (length of
  the prefix shared with the entry before, then the rest) and dealt out by anchor.
* Runs merge in levels of at most ``FAN_IN`` runs into one, each level dealing its run to at most as many places;
  so a task meets a fixed number of runs and the number of blobs grows with the input alone.  Each merge is a loser
  tree whose nodes keep the prefix length shared with the last winner: unequal lengths decide without a look at the
  texts, equal ones compare from there on, so no known prefix is compared again.
* The merged order and its common prefixes decide.  An entry whose prefix shared with the one before is its whole text
  repeats it.  Texts of one anchor then hand their suffixes on: a suffix inside the prefix shared with the text before is
  the same node as there, the others are sorted, and neighbours sharing ``LENGTH`` bytes are one node.  The
  least id of each node is the document that keeps the string.
* The starts found go back to the documents as spans, packed by document bucket.

Only exact bytes decide.  Defined cases: null text is empty; texts under ``LENGTH`` bytes lose nothing; a
document of null id loses nothing and takes nothing from others; rows of equal id never take from each other,
and repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, drop_table, materialise, n_bytes, total_bytes

LENGTH = 50
GRAM = 18
GRAMS = LENGTH - GRAM + 1
MOST_STARTS = 512
PIECE = 2 << 20
PART_BYTES = 24 << 20
SHORT_BYTES = 64 << 20
BUCKET_BYTES = 12 << 20
FAN_IN = 64
LEAST_LEVELS = 2
CROWDED = 20_000
BASE = 0x9E3779B97F4A7C15 | 1

ENTRY = np.dtype([("anchor", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("starts", "<u2"), ("shared", "<u2")])
DOC = np.dtype([("id", "<i8"), ("text", "<u8"), ("bucket", "<i4")])
SPAN = np.dtype([("id", "<i8"), ("text", "<u8"), ("start", "<u4"), ("stop", "<u4")])
#: What a blob holds: entries to merge, or spans on their way through.
RUN, SPANS = 0, 1


def anchors_of(data: np.ndarray) -> np.ndarray:
    """The anchor of each ``LENGTH``-byte string of ``data``: the least of its substring hashes."""
    power = lambda n: np.uint64(pow(BASE, n, 1 << 64))
    one = data.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * power(1) + one[1:]
    h, n = two, 2
    while n < 16:
        h = h[:-n] * power(n) + h[n:]
        n *= 2
    h = h[: len(h) - 2] * power(2) + two[16:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    n = 1
    while 2 * n <= GRAMS:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    rest = GRAMS - n
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def entries_of(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, document, place in the buffer and number of starts of every entry of a buffer of joined texts."""
    found: list[tuple[np.ndarray, ...]] = []
    begins = np.r_[0, ends[:-1]]
    for lo in range(0, len(buffer) - LENGTH + 1, PIECE):
        piece = buffer[lo : lo + PIECE + LENGTH - 1]
        m = anchors_of(piece)
        place = np.arange(lo, lo + len(m))
        doc = np.searchsorted(ends, place, side="right")
        valid = place + LENGTH <= ends[doc]
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(fresh)
        stop = np.flatnonzero(valid & ~np.r_[valid[1:] & ~fresh[1:], False]) + 1
        n = stop - at
        if len(n) and n.max() > MOST_STARTS:
            times = -(-n // MOST_STARTS)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, n = np.repeat(at, times) + step * MOST_STARTS, np.minimum(np.repeat(n, times) - step * MOST_STARTS, MOST_STARTS)
        found.append((m[at], doc[at].astype(np.uint32), (place[at] - begins[doc[at]]).astype(np.int64), n.astype(np.int64), place[at]))
    empty = (np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else empty


def shared_prefix(a: bytes, b: bytes, since: int = 0) -> int:
    """Length of the common prefix, known to be ``since`` at least."""
    n = min(len(a), len(b))
    if a[since:n] == b[since:n]:
        return n
    x = int.from_bytes(a[since:n], "big") ^ int.from_bytes(b[since:n], "big")
    return n - (x.bit_length() + 7) // 8


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans of a document become one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["text"], spans["id"]))]
    new_doc = np.r_[True, (spans["id"][1:] != spans["id"][:-1]) | (spans["text"][1:] != spans["text"][:-1])]
    lift = np.cumsum(new_doc).astype(np.int64) << 33  # so that one running maximum serves all documents
    stop = np.maximum.accumulate(spans["stop"].astype(np.int64) + lift)
    fresh = np.r_[True, spans["start"][1:].astype(np.int64) + lift[1:] > stop[:-1]] | new_doc
    first = np.flatnonzero(fresh)
    out = spans[first].copy()
    out["stop"] = (stop - lift)[np.r_[first[1:], len(spans)] - 1]
    return out


def packed(kind: int, *parts: bytes) -> bytes:
    head = np.array([kind, *map(len, parts)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpacked(blob: bytes, parts: int) -> tuple[int, list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    head = np.frombuffer(data[: 8 * (parts + 1)], dtype=np.int64)
    ends = 8 * (parts + 1) + np.cumsum(head[1:])
    return int(head[0]), [data[e - n : e] for e, n in zip(ends, head[1:], strict=True)]


Columns = tuple[np.ndarray, ...]


def sorted_run(joined: bytes, ids: list[int], columns: Columns) -> tuple[Columns, np.ndarray, np.ndarray]:
    """Entries (anchor, doc, at, starts, place) in the order of anchor, text and document, the prefix each shares with the
    one before under its anchor, and which stay: the first of equal texts and those of the same id."""
    by = np.argsort(columns[0], kind="stable")
    anchor, doc, at, starts, place = (x[by] for x in columns)
    shared = np.zeros(len(anchor), dtype=np.uint16)
    keep = np.ones(len(anchor), dtype=bool)
    rank = np.arange(len(anchor))
    twin = np.zeros(len(anchor) + 1, dtype=bool)
    twin[1:-1] = anchor[1:] == anchor[:-1]
    size = starts + (LENGTH - 1)
    for lo, hi in zip(np.flatnonzero(~twin[:-1] & twin[1:]).tolist(), np.flatnonzero(twin[:-1] & ~twin[1:]).tolist(), strict=True):
        own = slice(lo, hi + 1)
        strings = sorted((joined[p : p + n], d, i) for i, p, n, d in zip(range(lo, hi + 1), place[own].tolist(), size[own].tolist(), doc[own].tolist(), strict=True))
        last, owner = b"", None
        for slot, (s, d, i) in enumerate(strings, lo):
            rank[slot] = i
            if s == last and ids[d] != owner:
                keep[i] = False
                continue
            shared[i] = shared_prefix(last, s)
            if s != last:
                last, owner = s, ids[d]
    return tuple(x[rank] for x in (anchor, doc, at, starts, place)), shared[rank], keep[rank]


class Bucket:
    """The entries of the documents of a bucket as one sorted run, those with equal text settled.

    ``spans`` are the settled ones; the arrays hold what has to meet other runs.
    """

    def __init__(self, ids: np.ndarray, texts: list[bytes], bucket: int) -> None:
        order = np.argsort(ids, kind="stable")
        texts = [texts[i] for i in order]
        self.docs = docs = np.empty(len(ids), dtype=DOC)
        docs["id"], docs["bucket"] = ids[order], bucket
        docs["text"] = [xxhash.xxh64_intdigest(t) for t in texts]
        self.ids = docs["id"].tolist()
        self.joined = b"".join(texts)
        self.buffer = np.frombuffer(self.joined, dtype=np.uint8)
        found = entries_of(self.buffer, np.cumsum([len(t) for t in texts], dtype=np.int64))
        self.found: list[np.ndarray] = []
        self.run, self.shared = self._settled(found)

    def _settled(self, found: Columns) -> tuple[Columns, np.ndarray]:
        """What stays of some entries, sorted; what goes becomes spans."""
        columns, shared, keep = sorted_run(self.joined, self.ids, found)
        _, doc, at, starts, _ = (x[~keep] for x in columns)
        spans = np.empty(len(doc), dtype=SPAN)
        spans["id"], spans["text"], spans["start"], spans["stop"] = self.docs["id"][doc], self.docs["text"][doc], at, at + starts + (LENGTH - 1)
        self.found.append(spans)
        return tuple(x[keep] for x in columns), shared[keep]

    def short_anchors(self, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By part: 32 bits of each anchor, sorted, whether two documents here have it, and how many entries."""
        part, short = short_of(self.run[0], parts)
        key = part << np.int64(32) | short
        order = np.argsort(key, kind="stable")
        key, doc = key[order], self.run[1][order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
        if not len(first):
            return
        both = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
        counts = np.diff(np.r_[first, len(key)]).astype(np.uint32)
        key = key[first]
        ends = np.searchsorted(key >> 32, np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(ends)):
            own = slice(ends[p], ends[p + 1])
            yield int(p), (key[own] & 0xFFFFFFFF).astype(np.uint32), both[own], counts[own]

    def _split(self, mine: np.ndarray) -> tuple[Columns, np.ndarray]:
        """Each start of some entries as an entry of its own, anchored by its whole string."""
        _, doc, at, starts, place = (x[mine] for x in self.run)
        step = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        doc, at, place = np.repeat(doc, starts), np.repeat(at, starts) + step, np.repeat(place, starts) + step
        anchor = np.array([xxhash.xxh64_intdigest(self.joined[i : i + LENGTH]) for i in place.tolist()], dtype=np.uint64)
        return self._settled((anchor, doc, at, np.ones(len(at), dtype=np.int64), place))

    def blobs(self, wanted: dict[int, tuple[np.ndarray, np.ndarray]], short_parts: int, levels: Levels) -> Iterator[tuple[int, bytes]]:
        """The settled spans, and the front-coded entries of wanted anchors by place."""
        keys = [np.int64(p) << 32 | short.astype(np.int64) for p, (short, _) in wanted.items()]
        crowded = [k[hot] for k, (_, hot) in zip(keys, wanted.values(), strict=True)]
        part, short = short_of(self.run[0], short_parts)
        key = part << np.int64(32) | short
        asked = np.isin(key, np.concatenate(keys)) if keys else np.zeros(len(key), dtype=bool)
        hot = np.isin(key, np.concatenate(crowded)) & asked if keys else asked
        sides = [(tuple(x[asked & ~hot] for x in self.run), self.shared[asked & ~hot])]
        if hot.any():
            sides.append(self._split(np.flatnonzero(hot)))
        if len(spans := merged_spans(np.concatenate(self.found))):
            yield span_key(int(self.docs["bucket"][0])), packed(SPANS, spans.tobytes())
        for (anchor, doc, at, starts, place), shared in sides:
            digit = levels.digit(anchor, 0)
            by = np.argsort(digit, kind="stable")
            ends = np.searchsorted(digit[by], np.arange(levels.deal + 1))
            for p in np.flatnonzero(np.diff(ends)):
                i = by[ends[p] : ends[p + 1]]
                used, local = np.unique(doc[i], return_inverse=True)
                entries = np.empty(len(i), dtype=ENTRY)
                entries["anchor"], entries["doc"], entries["at"], entries["starts"], entries["shared"] = anchor[i], local, at[i], starts[i], shared[i]
                n = starts[i] + (LENGTH - 1) - shared[i]
                index = np.arange(n.sum()) + np.repeat(place[i] + shared[i] - (np.cumsum(n) - n), n)
                yield levels.key(int(p), int(self.docs["bucket"][0]), 0), packed(RUN, self.docs[used].tobytes(), coded(entries), self.buffer[index].tobytes())


class Levels:
    """How runs come together: ``depth`` levels, each merging ``fan`` runs and dealing to ``deal`` places.

    Small inputs take as many levels as ones of ``FAN_IN ** LEAST_LEVELS`` buckets, so work per byte is alike for both.
    """

    def __init__(self, buckets: int, parts: int) -> None:
        self.depth = LEAST_LEVELS
        while FAN_IN**self.depth < buckets:
            self.depth += 1
        root = lambda n: next(k for k in range(1, n + 1) if k**self.depth >= n)
        self.fan, self.deal = root(buckets), root(parts)

    def digit(self, anchor: np.ndarray, level: int) -> np.ndarray:
        """To which place of a level entries go, by their anchors."""
        route = ((anchor * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).astype(np.int64)
        return route // self.deal**level % self.deal

    def key(self, place: int, bucket: int, level: int) -> int:
        """The group of a run: the places taken so far, and which runs are merged together."""
        return place << 32 | bucket // self.fan ** (level + 1)


def span_key(bucket: int) -> int:
    return -1 - bucket


def short_of(anchor: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part, and 32 other bits, of anchors."""
    mixed = anchor * np.uint64(0x9FB21C651E98DF25)
    return (mixed >> np.uint64(40)).astype(np.int64) % parts, (mixed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def by_bucket(spans: np.ndarray, buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    spans, buckets = spans[order], buckets[order]
    cuts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(spans) else np.empty(0, dtype=np.int64)
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(spans)], strict=True):
        yield int(buckets[lo]), merged_spans(spans[lo:hi])


def coded(entries: np.ndarray) -> bytes:
    """Anchors, which ascend, as steps; then all bytes by their place in an entry: like beside like packs better."""
    steps = entries.copy()
    steps["anchor"][1:] -= entries["anchor"][:-1]
    return np.frombuffer(steps.tobytes(), dtype=np.uint8).reshape(len(entries), ENTRY.itemsize).T.tobytes()


def decoded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(ENTRY.itemsize, len(data) // ENTRY.itemsize)
    entries = np.frombuffer(planes.T.tobytes(), dtype=ENTRY).copy()
    entries["anchor"] = np.cumsum(entries["anchor"], dtype=np.uint64)
    return entries


class Run:
    """Decodes the entries of a front-coded run whose anchors are wanted, one at a time."""

    def __init__(self, docs: bytes, entries: bytes, tails: bytes) -> None:
        self.docs, self.entries, self.tails = np.frombuffer(docs, dtype=DOC), decoded(entries), tails

    def only(self, wanted: np.ndarray) -> Iterator[tuple[bytes, int, int, int, int]]:
        """(anchor and text as one key, prefix shared with the entry before, document, place, starts)."""
        e = self.entries
        at = np.searchsorted(wanted, e["anchor"])
        at[at == len(wanted)] = 0
        mine = np.flatnonzero(wanted[at] == e["anchor"]) if len(wanted) else at[:0]
        n = e["starts"].astype(np.int64) + (LENGTH - 1) - e["shared"]
        ends = np.cumsum(n)
        e, n, ends = e[mine], n[mine], ends[mine]
        keys = e["anchor"].astype(">u8").tobytes()
        last, tails = b"", self.tails
        for k, (shared, length, end, doc, place, starts) in enumerate(zip(e["shared"].tolist(), n.tolist(), ends.tolist(), e["doc"].tolist(), e["at"].tolist(), e["starts"].tolist(), strict=True)):
            head = keys[8 * k : 8 * k + 8]
            if shared or last[:8] == head:
                known, now = 8 + shared, last[: 8 + shared] + tails[end - length : end]
            else:
                known, now = shared_prefix(last[:8], head), head + tails[end - length : end]
            yield now, known, doc, place, starts
            last = now


def merge(runs: list[Iterator[tuple[bytes, int, int, int, int]]]) -> Iterator[tuple[int, tuple, int]]:
    """(run, entry, prefix shared with the entry before) in key order.

    The loser tree keeps, at each node, the loser and its prefix shared with the winner.
    """
    k = len(runs)
    heads: list[tuple | None] = [next(r, None) for r in runs]
    losers, prefix = [0] * k, [0] * k
    winner = [0] * k + list(range(k))
    known = [0] * k + [0 if h else -1 for h in heads]  # of an exhausted run -1: it loses against all others

    def before(a: int, b: int, h: int) -> bool:
        """Whether ``a`` goes first; their keys share ``h`` bytes, no more."""
        p, q = heads[a][0], heads[b][0]
        if h < len(p) and h < len(q):
            return p[h] < q[h]
        return (len(p), a) < (len(q), b)

    for node in range(k - 1, 0, -1):
        a, b, la, lb = winner[2 * node], winner[2 * node + 1], known[2 * node], known[2 * node + 1]
        if la == lb >= 0:
            h = shared_prefix(heads[a][0], heads[b][0], la)
            a, b, lb = (a, b, h) if before(a, b, h) else (b, a, h)
        elif la < lb:
            a, b, la, lb = b, a, lb, la
        winner[node], known[node], losers[node], prefix[node] = a, la, b, lb
    top, shared = (winner[1] if k > 1 else 0), 0
    while heads[top] is not None:
        yield top, heads[top], shared
        heads[top] = entry = next(runs[top], None)
        shared = entry[1] if entry else -1
        node = (top + k) >> 1
        while node:
            lx = prefix[node]
            if shared < lx:
                prefix[node], shared = shared, lx
                top, losers[node] = losers[node], top
            elif shared == lx >= 0:
                x = losers[node]
                prefix[node] = h = shared_prefix(heads[top][0], heads[x][0], lx)
                if not before(top, x, h):
                    top, losers[node] = x, top
            node >>= 1


Member = tuple[int, int, int, int, int]


def equal_texts(runs: list[Run], wanted: np.ndarray) -> Iterator[tuple[bytes, int, list[Member]]]:
    """(key, prefix shared with the key before, members) of each distinct key in order; members are (id, run, doc, place, starts)."""
    ids = [r.docs["id"].tolist() for r in runs]
    key, since, members = b"", 0, []
    for run, (now, _, doc, at, starts), shared in merge([r.only(wanted) for r in runs]):
        if members and shared == len(now) == len(key):
            members.append((ids[run][doc], run, doc, at, starts))
            continue
        if members:
            yield key, since, members
        key, since, members = now, shared, [(ids[run][doc], run, doc, at, starts)]
    if members:
        yield key, since, members


def keepers(group: list[tuple[bytes, int, list[Member]]]) -> list[list[int]]:
    """For each text of an anchor, in order, the least id that has the string at each of its starts."""
    nodes: list[list[int]] = []
    fresh: list[tuple[bytes, int]] = []
    total = 0
    for key, since, _ in group:
        known = max(0, since - 8 - LENGTH + 1) if nodes else 0
        own = nodes[-1][:known] if known else []
        for i in range(8 + len(own), len(key) - LENGTH + 1):
            fresh.append((key[i : i + LENGTH], total))
            own.append(total)
            total += 1
        nodes.append(own)
    fresh.sort()
    same = [0] * total
    before, first = b"", 0
    for string, node in fresh:
        if string != before:
            before, first = string, node
        same[node] = first
    least: dict[int, int] = {}
    nodes = [[same[n] for n in own] for own in nodes]
    for own, (_, _, members) in zip(nodes, group, strict=True):
        id_ = min(members)[0]
        for n in own:
            if least.get(n, id_) >= id_:
                least[n] = id_
    return [[least[n] for n in own] for own in nodes]


def spans_of(group: list[tuple[bytes, int, list[Member]]], out: list[tuple[int, int, int, int]]) -> None:
    """Spans (run, doc, start, stop) of one anchor's entries that another document keeps."""
    if len(group) == 2:
        (p, _, _), (q, _, _) = group
        # every string of a text has in it what lies between its last start and the end of its first string
        if p[len(p) - LENGTH : 8 + LENGTH] not in q or q[len(q) - LENGTH : 8 + LENGTH] not in p:
            spans_of(group[:1], out)
            group = group[1:]
    if len(group) == 1:
        members = group[0][2]
        if len(members) > 1:
            least = min(members)[0]
            out += [(run, doc, at, at + starts + LENGTH - 1) for id_, run, doc, at, starts in members if id_ > least]
        return
    least = min(m[0] for _, _, members in group for m in members)
    if all(m[0] == least for _, _, members in group for m in members):
        return
    for owners, (_, _, members) in zip(keepers(group), group, strict=True):
        for id_, run, doc, at, _ in members:
            begin = None
            for i, owner in enumerate(owners):
                if owner < id_:
                    begin = i if begin is None else begin
                elif begin is not None:
                    out.append((run, doc, at + begin, at + i - 1 + LENGTH))
                    begin = None
            if begin is not None:
                out.append((run, doc, at + begin, at + len(owners) - 1 + LENGTH))


def packed_spans(runs: list[Run], out: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, bytes]]:
    """Spans by the key of their document bucket."""
    if out:
        run, doc, start, stop = np.array(out, dtype=np.int64).T
        offset = np.cumsum([0, *(len(r.docs) for r in runs)])
        docs = np.concatenate([r.docs for r in runs])[offset[run] + doc]
        spans = np.empty(len(run), dtype=SPAN)
        spans["id"], spans["text"], spans["start"], spans["stop"] = docs["id"], docs["text"], start, stop
        for bucket, some in by_bucket(spans, docs["bucket"]):
            yield span_key(bucket), packed(SPANS, some.tobytes())


def opened(blobs: list[bytes]) -> list[Run]:
    return [Run(*unpacked(blob, 3)[1]) for blob in blobs]


def decided(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """The last merge of a place: spans of all strings that a document of smaller id has."""
    runs = opened(blobs)
    every = np.sort(np.concatenate([r.entries["anchor"] for r in runs]))
    wanted = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    out: list[tuple[int, int, int, int]] = []
    group: list[tuple[bytes, int, list[Member]]] = []
    for entry in equal_texts(runs, wanted):
        if group and entry[1] < 8:
            spans_of(group, out)
            group = []
        group.append(entry)
    if group:
        spans_of(group, out)
    yield from packed_spans(runs, out)


def joined_runs(blobs: list[bytes], place: int, level: int, levels: Levels) -> Iterator[tuple[int, bytes]]:
    """A merge before the last: one run for each next place, of equal texts those of the least id, and spans of the others."""
    runs = opened(blobs)
    offset = np.cumsum([0, *(len(r.docs) for r in runs)]).tolist()
    docs = np.concatenate([r.docs for r in runs])
    out: list[tuple[int, int, int, int]] = []
    rows: list[tuple[int, int, int, int, int]] = []
    tails: list[bytes] = []
    anchor = np.concatenate([r.entries["anchor"] for r in runs])
    source = np.repeat(np.arange(len(runs)), [len(r.entries) for r in runs])
    met, alone = anchors_met(anchor, source)
    for key, since, members in equal_texts(runs, met):
        least, shared = min(members)[0], max(0, since - 8)
        for id_, run, doc, at, starts in members:
            if id_ > least:
                out.append((run, doc, at, at + starts + LENGTH - 1))
                continue
            rows.append((int.from_bytes(key[:8], "big"), offset[run] + doc, at, starts, shared))
            tails.append(key[8 + shared :])
            shared = len(key) - 8
    yield from packed_spans(runs, out)
    every = np.concatenate([r.entries for r in runs])
    every["doc"] += np.array(offset[:-1], dtype=np.uint32)[source]
    entries = np.concatenate([every[alone], np.array(rows, dtype=ENTRY)])
    bytes_of = lambda e: e["starts"].astype(np.int64) + (LENGTH - 1) - e["shared"]
    begin = np.concatenate([[0], np.cumsum(np.concatenate([bytes_of(every), bytes_of(entries[int(alone.sum()) :])]))])[:-1]
    begin = np.concatenate([begin[: len(every)][alone], begin[len(every) :]])
    buffer = np.frombuffer(b"".join([*(r.tails for r in runs), *tails]), dtype=np.uint8)
    by = np.argsort(entries["anchor"], kind="stable")
    digit = levels.digit(entries["anchor"][by], level)
    for p in np.unique(digit).tolist():
        i = by[digit == p]
        used, local = np.unique(entries["doc"][i], return_inverse=True)
        mine = entries[i]
        mine["doc"] = local
        n = bytes_of(mine)
        index = np.arange(n.sum()) + np.repeat(begin[i] - (np.cumsum(n) - n), n)
        yield levels.key(place * levels.deal + p, int(docs["bucket"][0]), level), packed(RUN, docs[used].tobytes(), coded(mine), buffer[index].tobytes())


def anchors_met(anchor: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors that several runs have, ascending, and which entries have none of them; ``source`` ascends.

    Entries of an anchor that only one run has are in order as they stand, and their prefixes hold: they are not merged again.
    """
    by = np.argsort(anchor, kind="stable")
    ordered = anchor[by]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(by) else by
    last = np.r_[first[1:], len(by)] - 1
    several = source[by[first]] != source[by[last]]
    alone = np.empty(len(by), dtype=bool)
    alone[by] = np.repeat(~several, last - first + 1)
    return ordered[first[several]], alone


def _bucket_of(batches: Iterator[pa.RecordBatch]) -> Bucket | None:
    ids, texts, bucket = [], [], 0
    for batch in batches:
        if batch.num_rows:
            bucket = batch.column("bucket")[0].as_py()
            ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
            texts += [t.encode() for t in batch.column("text").to_pylist()]
    return Bucket(np.concatenate(ids), texts, bucket) if ids else None


def _rows(**columns: list) -> pa.RecordBatch:
    kinds = {"blob": pa.binary(), "place": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds.get(n, pa.int32())) for n, c in columns.items()], names=[*columns])


def _compressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def shared_anchors(dealt: DataFrame, parts: int) -> DataFrame:
    """(bucket, part, blob): the short anchors of each bucket that another document has too, and which are crowded."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if bucket := _bucket_of(batches):
            made = [(p, packed(int(bucket.docs["bucket"][0]), short.tobytes(), np.packbits(both).tobytes(), counts.tobytes())) for p, short, both, counts in bucket.short_anchors(parts)]
            yield _rows(part=[p for p, _ in made], blob=[b for _, b in made])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = 0, []
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                bucket, (short, both, counts) = unpacked(blob, 3)
                short = np.frombuffer(short, dtype=np.uint32)
                part = p
                found.append((bucket, short, np.unpackbits(np.frombuffer(both, dtype=np.uint8))[: len(short)].astype(bool), np.frombuffer(counts, dtype=np.uint32)))
        if not found:
            return
        every = np.concatenate([x for _, x, _, _ in found])
        by = np.argsort(every, kind="stable")
        every = every[by]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        twice = every[first[np.diff(np.r_[first, len(every)]) > 1]]
        crowded = every[first[np.add.reduceat(np.concatenate([c for *_, c in found])[by].astype(np.int64), first) >= CROWDED]]
        rows = [(b, x[both | np.isin(x, twice, assume_unique=True)]) for b, x, both, _ in found]
        rows = [(b, _compressed(packed_keys(x, np.isin(x, crowded, assume_unique=True)))) for b, x in rows if len(x)]
        yield _rows(bucket=[b for b, _ in rows], part=[part] * len(rows), blob=[x for _, x in rows])

    return dealt.groupBy("bucket").applyInArrow(send, "part int, blob binary").groupBy("part").applyInArrow(meet, "bucket int, part int, blob binary")


def packed_keys(short: np.ndarray, hot: np.ndarray) -> bytes:
    return short.tobytes() + np.packbits(hot).tobytes()


def unpacked_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Four bytes a key, then a bit each: n keys take 4n + ceil(n / 8) bytes."""
    n = (8 * len(data)) // 33
    return np.frombuffer(data[: 4 * n], dtype=np.uint32), np.unpackbits(np.frombuffer(data[4 * n :], dtype=np.uint8))[:n].astype(bool)


def repeated_spans(dealt: DataFrame, shared: DataFrame, short_parts: int, levels: Levels) -> DataFrame:
    """(bucket, blob) of the spans to remove."""
    schema = "place bigint, blob binary"

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = _bucket_of(iter(left.to_batches()))
        made = []
        if bucket:
            wanted = {p: unpacked_keys(zstandard.ZstdDecompressor().decompress(b)) for p, b in zip(right.column("part").to_pylist(), right.column("blob").to_pylist(), strict=True)}
            made = [*bucket.blobs(wanted, short_parts, levels)]
        return pa.Table.from_batches([_rows(place=[p for p, _ in made], blob=[b for _, b in made])])

    def step(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, blobs = -1, []
            for batch in batches:
                place = batch.column("place")[0].as_py() if batch.num_rows else place
                blobs += batch.column("blob").to_pylist()
            if not blobs:
                return
            made = [(place, b) for b in blobs] if place < 0 else [*(decided(blobs) if level == levels.depth else joined_runs(blobs, place >> 32, level, levels))]
            yield _rows(place=[p for p, _ in made], blob=[b for _, b in made])

        return run

    rows = dealt.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(send, schema)
    for level in range(1, levels.depth + 1):
        rows = rows.groupBy("place").applyInArrow(step(level), schema)
    return rows.select((-1 - F.col("place")).cast("int").alias("bucket"), "blob")


SCHEMA = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row: id, length in bytes, the spans removed and the bytes that stay."""
    total = total_bytes(docs)
    short_parts, parts, buckets = buckets_for(total, SHORT_BYTES, 4), buckets_for(total, PART_BYTES, 8), buckets_for(total, BUCKET_BYTES, 8)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    long_enough = dealt.filter((n_bytes(F.col("text")) >= LENGTH) & F.col("doc_id").isNotNull())
    shared = materialise(shared_anchors(long_enough, short_parts), "anchors")
    spans = materialise(repeated_spans(long_enough, shared, short_parts, Levels(buckets, parts)), "spans")
    drop_table(shared)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        raw = b"".join(unpacked(b, 1)[1][0] for b in right.column("blob").to_pylist())
        found = merged_spans(np.frombuffer(raw, dtype=SPAN))
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for id_, text, start, stop in found.tolist():
            by.setdefault((id_, text), []).append((start, stop))
        sizes, spans, kept = [], [], []
        ids = left.column("doc_id").to_pylist()
        for id_, t in zip(ids, left.column("text").to_pylist(), strict=True):
            data = (t or "").encode()
            own = by.get((id_, xxhash.xxh64_intdigest(data)), []) if by and id_ is not None else []
            edges = [0, *(x for s in own for x in s), len(data)]
            sizes.append(len(data))
            spans.append([{"start": a, "stop": b} for a, b in own])
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table([pa.array(ids, type=pa.int64()), pa.array(sizes, type=pa.int64()), pa.array(spans, type=span), pa.array(kept, type=pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return dealt.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(cut, SCHEMA)
