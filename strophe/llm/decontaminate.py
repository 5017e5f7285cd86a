"""Benchmark decontamination by latent semantic retrieval, then common-subsequence and answer checks.

1. Texts become sequences of benchmark word numbers, once for all items (other words can't match; they keep their places).
2. Passages are windows of ``2 * STRIDE`` words at every ``STRIDE``; document frequencies of the benchmark's words
   over all passages give TF-IDF weights.  Words in more than ``MAX_SHARE`` of passages weigh nothing, but each
   item keeps its ``LEAST_TERMS`` rarest.
3. A randomised SVD of the passage matrix in one pass: every task adds up its part of ``A'(A R)`` for a random
   ``R``, the parts add up by a tree, and the Nystroem form gives the right singular vectors.
4. Passages and items meet in the latent space: cosine of ``MIN_COSINE`` or more makes a candidate.  The space of an item is
   spanned by the singular vectors and the item itself, so truncation loses no item, and a cosine depends on the
   passage, the item and the corpus, never on the items beside it.  An item longer than a passage also comes as
   overlapping windows of a passage's length, any of which makes it a candidate.
5. A candidate is a leak if a window of the text holds, in order, ``MIN_COMMON`` of the item's words, and also
   ``MIN_ANSWER`` of its last sentence (its answer) unless ``SURE_COMMON`` of all words are there.

The corpus is numbered once and read three times, whatever the number of items; items meet a batch of passages in
blocks of ``ITEMS_AT_ONCE``, which bounds the matrices and changes no result.  The benchmark itself is sent to every
task: one of more than ``MOST_ITEM_BYTES`` is refused (split it and join the leaks).

Defined cases: null, empty and blank texts have no words and no leaks; an item without words matches
nothing; repeated rows give the same leaks once; ids of any type and null ids are carried as any value; either table
may be empty; other columns pass through :func:`decontaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, if_small, materialise, new_path, scratch

WORDS = re.compile(r"\w+")
STRIDE = 48
MAX_SHARE = 0.005
LEAST_TERMS = 4
SKETCH = 64
MIN_COSINE = 0.7
MIN_COMMON = 0.6
SURE_COMMON = 0.85
MIN_ANSWER = 0.5
ITEMS_AT_ONCE = 500
MOST_ITEM_BYTES = 64 << 20
#: Items longer than a passage are also sought by windows of a passage's length at this stride.
ITEM_STRIDE = STRIDE // 2
TERM_BLOCK = 512
TASK_GROUPS = 64


def item_windows(words: np.ndarray) -> list[np.ndarray]:
    """Overlapping windows of an item longer than a passage, the last one at its end."""
    last = len(words) - 2 * STRIDE
    return [words[at : at + 2 * STRIDE] for at in [*range(0, last, ITEM_STRIDE), last]] if last > 0 else []


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class Items:
    """The benchmark: words by number, item sequences, answers, and the queries that seek them."""

    def __init__(self, texts: list[str | None]) -> None:
        split = [words_of(t) for t in texts]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for t in split for w in t))}
        self.words = [np.array([self.number[w] for w in t], dtype=np.int32) for t in split]
        # items without words seek nothing; the windows of a long item stand beside it, so a block holds near all of them
        queries = [(w, i) for i, t in enumerate(self.words) if len(t) for w in [t, *item_windows(t)]]
        self.queries = [w for w, _ in queries]
        self.owner = np.array([i for _, i in queries], dtype=np.int64)
        answers = [[s for s in re.split(r"[.!?\n]+", t or "") if WORDS.search(s)] for t in texts]
        self.answers = [np.array([self.number[w] for w in words_of(a[-1])], dtype=np.int32) if a else np.empty(0, dtype=np.int32) for a in answers]


def numbered(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """(doc_id, ids): the texts as word numbers, -1 for words that no item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for batch in batches:
            blobs = [np.array([get(w, -1) for w in words_of(t)], dtype=np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, type=pa.binary())], names=["doc_id", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def passage_terms(ids: list[np.ndarray], terms: int, column: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passage, term and count of each pair that occurs, and the number of the first passage of each text.

    ``column`` renumbers words; those at -1 are left out.
    """
    blocks = np.array([-(-len(x) // STRIDE) for x in ids], dtype=np.int64)
    first = np.cumsum(blocks) - blocks
    flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    if column is not None:
        flat = np.where(flat >= 0, column[flat], -1)
    at = np.flatnonzero(flat >= 0)
    text = np.searchsorted(np.cumsum(lengths), at, side="right")
    block = first[text] + (at - (np.cumsum(lengths) - lengths)[text]) // STRIDE
    key = block * terms + flat[at]
    earlier = key[block > first[text]] - terms  # the passage that began a stride before
    pairs, counts = np.unique(np.concatenate([key, earlier]), return_counts=True)
    return pairs // terms, pairs % terms, counts, first


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Some megabytes of documents at a time."""
    for batch in batches:
        blobs = batch.column("ids").to_pylist()
        sizes = np.cumsum([len(b) for b in blobs])
        cuts = np.unique(np.r_[0, np.searchsorted(sizes, np.arange(4 << 20, (sizes[-1] if len(sizes) else 0) + 1, 4 << 20)) + 1, len(blobs)])
        for lo, hi in zip(cuts, cuts[1:]):
            hi = min(hi, len(blobs))
            if lo < hi:
                yield batch.column("doc_id").slice(lo, hi - lo), [np.frombuffer(b, dtype=np.int32) for b in blobs[lo:hi]]


def passage_counts(texts: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """In how many passages each word is, and the number of passages; added up by word before they reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(terms, dtype=np.int64), 0
        for _, ids in _batches(batches):
            _, term, _, _ = passage_terms(ids, terms)
            total += np.bincount(term, minlength=terms)
            n += sum(-(-len(x) // STRIDE) for x in ids)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1].astype(np.int64)), pa.array(np.r_[total[some], n])], names=["term", "n"])

    rows = texts.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}
    return np.array([counts.get(t, 0) for t in range(terms)], dtype=np.int64), counts.get(-1, 0)


class Weights:
    """TF-IDF columns: the words that weigh, their new numbers and inverse document frequencies."""

    def __init__(self, items: Items, counts: np.ndarray, passages: int) -> None:
        keep = counts <= MAX_SHARE * max(passages, 1)
        for w in items.queries:
            rare = np.unique(w)
            keep[rare[np.argsort(counts[rare], kind="stable")[:LEAST_TERMS]]] = True
        self.column = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int64)
        self.terms = int(keep.sum())
        self.idf = np.log((1 + passages) / (1 + counts[keep])) + 1

    def rows(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Passages that weigh anything: their numbers, the first entry of each, terms, unit-length weights; first passage of each text."""
        passage, term, count, first = passage_terms(ids, self.terms, self.column)
        value = count * self.idf[term]
        start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.empty(0, dtype=np.int64)
        if len(start):
            norm = np.sqrt(np.add.reduceat(value * value, start))
            value = value / np.repeat(norm, np.diff(np.r_[start, len(passage)]))
        return passage[start], start, term, value.astype(np.float32), first

    def vector(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit-length weights of an item or a window of one."""
        own = self.column[words]
        term, count = np.unique(own[own >= 0], return_counts=True)
        value = count * self.idf[term]
        return term, value / max(float(np.linalg.norm(value)), 1e-30)


ROWS_AT_ONCE = 1 << 13


def _projected(start: np.ndarray, term: np.ndarray, value: np.ndarray, basis: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Products of passages with ``basis``, some rows at a time: (from, to, product)."""
    ends = np.r_[start[1:], len(term)]
    for lo in range(0, len(start), ROWS_AT_ONCE):
        hi = min(lo + ROWS_AT_ONCE, len(start))
        a, b = start[lo], ends[hi - 1]
        yield lo, hi, np.add.reduceat(basis[term[a:b]] * value[a:b, None], start[lo:hi] - a, axis=0)


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Add up partial matrices by block of rows: those of each group of tasks first, then the groups' sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = None, None
        for batch in batches:
            for *k, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "group", "blob")), strict=True):
                x = np.frombuffer(blob)
                total, key = (x.copy() if total is None else total + x), k
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], type=pa.int32()) for x in key] + [pa.array([total.tobytes()])], names=["block", "group", "blob"])

    schema = "block int, group int, blob binary"
    out = np.zeros(shape)
    for r in parts.groupBy("block", "group").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).collect():
        x = np.frombuffer(r["blob"]).reshape(-1, shape[1])
        out[r["block"] * TERM_BLOCK : r["block"] * TERM_BLOCK + len(x)] = x
    return out


def latent_basis(texts: DataFrame, weights: Weights) -> np.ndarray:
    """Right singular vectors (terms by components) of the passages."""
    terms, sketch = weights.terms, min(SKETCH, weights.terms)
    random = np.random.default_rng(7).standard_normal((terms, sketch)).astype(np.float32)

    def emit(matrix: np.ndarray) -> pa.RecordBatch:
        some = [b for b in range(0, len(matrix), TERM_BLOCK) if matrix[b : b + TERM_BLOCK].any()]
        group = TaskContext.get().partitionId() % TASK_GROUPS
        blobs = pa.array([matrix[b : b + TERM_BLOCK].tobytes() for b in some], type=pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([b // TERM_BLOCK for b in some], type=pa.int32()), pa.array([group] * len(some), type=pa.int32()), blobs], names=["block", "group", "blob"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms, sketch))
        for _, ids in _batches(batches):
            _, start, term, value, _ = weights.rows(ids)
            ends = np.r_[start[1:], len(term)]
            for lo, hi, product in _projected(start, term, value, random):
                a, b = start[lo], ends[hi - 1]
                row = np.repeat(np.arange(hi - lo), ends[lo:hi] - start[lo:hi])
                by = np.argsort(term[a:b], kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(term[a:b][by]) > 0])
                total[term[a:b][by][cut]] += np.add.reduceat(product[row[by]] * value[a:b][by][:, None], cut, axis=0)
        yield emit(total)

    corpus = _summed(texts.mapInArrow(sketched, "block int, group int, blob binary"), (terms, sketch))
    values, vectors = singular_vectors(corpus, random.astype(np.float64))
    return np.ascontiguousarray(vectors[:, values > 1e-6 * values[:1].sum()]).astype(np.float32)


class Space:
    """The latent spaces of all queries: the shared singular vectors, and of each query what lies outside them."""

    def __init__(self, items: Items, weights: Weights, basis: np.ndarray) -> None:
        self.basis, self.terms = basis, weights.terms
        self.vectors = [weights.vector(w) for w in items.queries]
        self.inside = np.array([v.astype(np.float32) @ basis[t] for t, v in self.vectors], dtype=np.float32).reshape(len(self.vectors), basis.shape[1])
        self.outside = np.maximum(1 - np.einsum("ij,ij->i", self.inside, self.inside, dtype=np.float64), 0).astype(np.float32)

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """The first query of each block, and the block as columns."""
        for lo in range(0, len(self.vectors), ITEMS_AT_ONCE):
            some = self.vectors[lo : lo + ITEMS_AT_ONCE]
            out = np.zeros((self.terms, len(some)), dtype=np.float32)
            for i, (term, value) in enumerate(some):
                out[term, i] = value
            yield lo, out

    def cosines(self, lo: int, projected: np.ndarray, product: np.ndarray) -> np.ndarray:
        """Cosines of passages (their projections, and their products with a block of queries) with the queries."""
        own = slice(lo, lo + product.shape[1])
        beside = product - projected @ self.inside[own].T  # what a passage shares with the query outside the vectors
        beside *= beside / np.maximum(self.outside[own], 1e-6) * (self.outside[own] > 1e-6)
        length = np.einsum("ij,ij->i", projected, projected)[:, None] + beside
        return product / np.sqrt(np.maximum(length, 1e-12))


def singular_vectors(sketch: np.ndarray, random: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors of A from ``A'(A R)`` and ``R``, by a shifted Nystroem step."""
    shift = 1e-10 * max(float(np.linalg.norm(sketch)), 1e-30)
    moved = sketch + shift * random
    inner = random.T @ moved
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    keep = value > 1e-12 * max(float(value[-1]), 1e-300)
    left, size, _ = np.linalg.svd(moved @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
    return np.sqrt(np.maximum(size**2 - shift, 0)), left


def common_length(item: np.ndarray, window: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit vector step per word of the window."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    row, full = 0, (1 << len(item)) - 1
    for w in window.tolist():
        if p := places.get(w):
            x = row | p
            row = x & ~(x - ((row << 1) | 1)) & full
    return row.bit_count()


def shared_words(item: np.ndarray, window: np.ndarray) -> int:
    """Words in common, each as often as both have it: no common subsequence is longer."""
    own, counts = np.unique(item, return_counts=True)
    at = np.searchsorted(own, window)
    at[at == len(own)] = 0
    return int(np.minimum(counts, np.bincount(at[own[at] == window], minlength=len(own))).sum())


def verdict(item: np.ndarray, answer: np.ndarray, text: np.ndarray, lo: int, hi: int) -> tuple[int, int, bool]:
    """Best window in words [lo - n, hi + n) of a text: words in common, its start, is it a leak."""
    n = len(item)
    width, step = n + max(4, n // 4), max(1, n // 8)
    lo, hi = max(0, lo - n), min(len(text), hi + n)
    best, at = -1, lo
    if shared_words(item, text[lo:hi]) < MIN_COMMON * n:  # no window can hold enough of the item
        return best, at, False
    for start in range(lo, max(lo + 1, hi - width + step + 1), step):
        if (c := common_length(item, text[start : start + width])) > best:
            best, at = c, start
    told = len(answer) == 0 or common_length(answer, text[at : at + width]) >= MIN_ANSWER * len(answer)
    return best, at, best >= SURE_COMMON * n or best >= MIN_COMMON * n and told


def leaks_of(texts: DataFrame, items: Items, weights: Weights, space: Space) -> DataFrame:
    """(doc_id, item, n_common, n_item, at_word, cosine) of every leak; ``item`` numbers the benchmark's rows."""

    def candidates(ids: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """Text, place of the passage, item and cosine."""
        passage, start, term, value, first = weights.rows(ids)
        for at, columns in space.blocks():
            both = np.hstack([space.basis, columns])
            for lo, _, product in _projected(start, term, value, both):
                k = space.basis.shape[1]
                cosine = space.cosines(at, product[:, :k], product[:, k:])
                rows, cols = np.nonzero(cosine >= MIN_COSINE)
                owner, scores = items.owner[at + cols], cosine[rows, cols]
                by = np.lexsort((-scores, owner, rows))  # the best query of each passage and item
                by = by[np.r_[True, (np.diff(rows[by]) != 0) | (np.diff(owner[by]) != 0)]] if len(by) else by
                for p, i, c in zip(passage[lo + rows[by]].tolist(), owner[by].tolist(), scores[by].tolist(), strict=True):
                    t = int(np.searchsorted(first, p, side="right")) - 1
                    yield t, (p - int(first[t])) * STRIDE, i, min(c, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids in _batches(batches):
            best: dict[tuple[int, int], tuple] = {}
            for t, at, i, c in candidates(ids):
                common, where, leak = verdict(items.words[i], items.answers[i], ids[t], at, at + 2 * STRIDE)
                if leak and (common, c) > best.get((t, i), (0, 0.0))[:2]:
                    best[t, i] = (common, c, where)
            found = [(t, i, common, len(items.words[i]), where, c) for (t, i), (common, c, where) in best.items()]
            columns = [*zip(*found, strict=True)] if found else [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(columns[0], type=pa.int64())), *(pa.array(list(x), type=k) for x, k in zip(columns[1:], kinds, strict=True))], names=["doc_id", "item", "n_common", "n_item", "at_word", "cosine"])

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, item int, n_common bigint, n_item bigint, at_word bigint, cosine double")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_common, n_item, at_word, cosine) of every leak."""
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_ITEM_BYTES:
        raise ValueError(f"a benchmark of {size} bytes is over the bound of {MOST_ITEM_BYTES}")
    rows = benchmark.select("item_id", "text").distinct().orderBy("text", "item_id").collect()
    items = Items([r["text"] for r in rows])
    kind = benchmark.schema["item_id"].dataType.simpleString()
    if not items.number:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {kind}, n_common bigint, n_item bigint, at_word bigint, cosine double")
    texts = materialise(numbered(docs, items.number), "numbered")
    weights = Weights(items, *passage_counts(texts, len(items.number)))
    space = Space(items, weights, latent_basis(texts, weights))
    found = materialise(leaks_of(texts, items, weights, space), "leaks")
    drop_table(texts)
    named = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
    keys = ("doc_id", "item_id")
    best = found.join(F.broadcast(named), "item").groupBy(*keys).agg(F.max(F.struct("n_common", "cosine", "n_item", "at_word")).alias("b"))
    return best.select(*keys, "b.n_common", "b.n_item", "b.at_word", "b.cosine")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no leak, with all their columns; by row, as ids can be null or repeat."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    base = materialise(docs.select(F.struct(*names).alias("__row"), F.monotonically_increasing_id().alias("rid")), "leak-docs")
    path = new_path(docs.sparkSession, "leaky")
    with scratch(docs.sparkSession):
        found = leaks(base.select(F.col("rid").alias("doc_id"), F.col("__row.text").alias("text")), benchmark)
        bad = materialise(found.select(F.col("doc_id").alias("rid")).distinct(), "leaky", path=path)
    return base.join(if_small(bad, 1_000_000), "rid", "left_anti").select("__row.*")
