"""Similarity search of quotes in texts: windows of about a quote's length, by token equality first."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK, LEAST, EDGE_BONUS = 0.2, 0.8, 0.01
CELLS = 1 << 25
#: Quotes are searched in blocks that the driver hands out: no more bytes of tokens than this.
MOST_QUOTE_BYTES = 64 << 20
#: Stand for no token in openings that are shorter than three.
PAST_QUOTE, PAST_TEXT = -2, -3


class Keys:
    """A block of quotes, their token numbers, and the tokens of each of which a similar window holds one.

    A window shares ``needed`` tokens or more with a quote of m: so one of any choice of more than m - needed.  The choice
    takes those that few quotes have, and long ones first.
    """

    def __init__(self, quotes: list[list[str]], slacks: list[int]):
        times = Counter(t for q in quotes for t in set(q))
        self.vocabulary = pa.array(sorted(times), type=pa.string())
        number = {t: i for i, t in enumerate(self.vocabulary.to_pylist())}
        self.reach = np.array([len(q) + s for q, s in zip(quotes, slacks, strict=True)], dtype=np.int64)
        self.quotes = [np.array([number[t] for t in q], dtype=np.int32) for q in quotes]
        self.needed = np.array([least_shared(len(q), s) for q, s in zip(quotes, slacks, strict=True)], dtype=np.float64) - 1e-9
        self.opening = np.array([([number[t] for t in q[:3]] + [PAST_QUOTE] * 3)[:3] for q in quotes], dtype=np.int32).reshape(-1, 3)
        self.member = np.zeros((len(quotes), len(number) + 1), dtype=bool)  # the last: any other token
        of: list[list[int]] = [[] for _ in number]
        for i, q in enumerate(quotes):
            self.member[i, [number[t] for t in q]] = True
            own, least = Counter(q), len(q) - ceil(self.needed[i]) + 1
            for t in sorted(own, key=lambda t: (times[t], -len(t), t)):
                if least <= 0:
                    break
                of[number[t]].append(i)
                least -= own[t]
        self.n_of = np.array([*map(len, of), 0], dtype=np.int64)
        self.first_of, self.of = np.cumsum(self.n_of) - self.n_of, np.array([i for x in of for i in x], dtype=np.int64)

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(quote, start) in a text where a window opens like a quote and has enough tokens that are in the quote."""
        n = self.n_of[ids]
        at = np.repeat(np.arange(len(ids)), n)  # an occurrence of a key of a quote
        quote = self.of[np.repeat(self.first_of[ids], n) + _counted(n)]
        low = np.maximum(0, at - self.reach[quote] + 1)
        code = np.unique(np.repeat(quote * len(ids) + low, at - low + 1) + _counted(at - low + 1))
        quote, start = np.divmod(code, max(1, len(ids)))
        padded = np.r_[ids, np.full(2, PAST_TEXT, dtype=ids.dtype)]
        q, w = self.opening[quote], padded[start[:, None] + np.arange(3)]
        same = q[:, :, None] == w[:, None, :]
        two = np.zeros(len(quote), dtype=bool)
        for i, k in combinations(range(3), 2):
            for j, m in combinations(range(3), 2):
                two |= same[:, i, j] & same[:, k, m]
        lengths = (q != PAST_QUOTE).sum(axis=1) + (w != PAST_TEXT).sum(axis=1)
        opens = same[:, 0, 0] | np.where(lengths > 4, two, same.any(axis=(1, 2)))  # similarity of the openings is 0.5 or more
        quote, start = quote[opens], start[opens]
        n = np.minimum(self.reach[quote], len(ids) - start)
        inside = self.member[np.repeat(quote, n), ids[np.repeat(start, n) + _counted(n)]]
        enough = np.bincount(np.repeat(np.arange(len(quote)), n), weights=inside, minlength=len(quote)) >= self.needed[quote]
        return quote[enough], start[enough]


def _counted(n: np.ndarray) -> np.ndarray:
    """0 to n[i] - 1 for each i."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def least_shared(m, slack):
    """Tokens that a quote of m shares at least with a window of the least similarity, at any length tried."""
    return LEAST / 2 * (2 * m - slack)


def common_lengths(q: np.ndarray, window: np.ndarray) -> list[int]:
    """The length of a longest common subsequence of ``q`` and each beginning of the window, by rows of bits (Hyyro)."""
    masks: dict[int, int] = {}
    for i, t in enumerate(q.tolist()):
        masks[t] = masks.get(t, 0) | 1 << i
    full = rest = (1 << len(q)) - 1
    out = []
    for t in window.tolist():
        met = rest & masks.get(t, 0)
        rest = (rest + met | rest - met) & full
        out.append(len(q) - rest.bit_count())
    return out


def _blocks(lists: list[list[str]]) -> list[tuple[int, int]]:
    """Ranges of quotes of at most ``CELLS`` quotes times tokens."""
    blocks, lo, seen = [], 0, set()
    for i, q in enumerate(lists):
        seen.update(q)
        if i > lo and (i - lo + 1) * len(seen) > CELLS:
            blocks.append((lo, i))
            lo, seen = i, set(q)
    return [*blocks, (lo, len(lists))]


def _slack() -> Column:
    return F.greatest(F.lit(1), F.bround(F.size("q") * SLACK).cast("int"))


def _scored(keys: Keys, ids: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(quote, start, length, score) of the similar windows of one text."""
    for quote, start in zip(*map(np.ndarray.tolist, keys.places(ids)), strict=True):
        q = keys.quotes[quote]
        for length, common in enumerate(common_lengths(q, ids[start : start + keys.reach[quote]]), 1):
            score = 2.0 * common / (len(q) + length)
            if score >= LEAST and length >= 2 * len(q) - keys.reach[quote]:
                yield quote, start, length, score


def _found(docs: pa.Array, names: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    row, quote, start, length, score = zip(*found, strict=True) if found else [()] * 5
    columns = [docs.take(pa.array(row, type=pa.int64())), names.take(pa.array(quote, type=pa.int64())), pa.array(start, type=pa.int32()), pa.array(length, type=pa.int32()), pa.array(score, type=pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "quote", "start", "length", "score"])


def _out(texts: DataFrame, quotes: DataFrame) -> str:
    return f"doc {dict(texts.dtypes)['doc']}, quote {dict(quotes.dtypes)['quote']}, start int, length int, score double"


def own_windows(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """As :func:`scored_windows`, of quotes (doc, quote, q) each in its own text alone: texts meet their quotes, and nothing comes to the driver."""
    asked = quotes.groupBy("doc").agg(F.collect_list(F.struct("quote", "q", _slack().alias("slack"))).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, asked = batch.column(1), batch.column(2)
            ends, bounds = tokens.offsets.to_numpy(), asked.offsets.to_numpy()
            name, q, slack = (asked.values.field(i) for i in range(3))
            found = []
            for i in np.flatnonzero(np.diff(ends)).tolist():
                places = [k for k in range(bounds[i], bounds[i + 1]) if len(q[k])]
                lists, slacks = [q[k].as_py() for k in places], [slack[k].as_py() for k in places]
                for lo, hi in _blocks(lists) if lists else []:
                    keys = Keys(lists[lo:hi], slacks[lo:hi])
                    ids = pc.fill_null(pc.index_in(tokens.values[ends[i] : ends[i + 1]], keys.vocabulary), len(keys.vocabulary)).to_numpy()
                    found += [(i, places[lo + quote], *rest) for quote, *rest in _scored(keys, ids)]
            yield _found(batch.column(0), name, found)

    return texts.select("doc", "tokens").join(asked.hint("merge"), "doc").mapInArrow(run, _out(texts, quotes))


def scored_windows(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc, quote, start, length, score): windows of ``LEAST`` similarity or more that open with the quote's first token, or share two
    of three opening tokens in order.

    The quotes come to the driver, ``MOST_QUOTE_BYTES`` of them at most, else this raises; each block of them, of at most
    ``CELLS`` quotes times tokens, is one pass over the texts.
    """
    known = quotes.filter("size(q) > 0").select("quote", "q", _slack().alias("slack"))
    held = known.agg(F.sum(F.octet_length(F.array_join("q", " ")) + 16)).first()[0] or 0
    if held > MOST_QUOTE_BYTES:
        raise ValueError(f"{held} bytes of quotes; search them in parts of {MOST_QUOTE_BYTES} at most")
    asked = known.toArrow().combine_chunks()
    lists, slacks = asked.column("q").to_pylist(), asked.column("slack").to_pylist()

    def find(lo: int, hi: int):
        keys = Keys(lists[lo:hi], slacks[lo:hi])
        names = asked.column("quote").slice(lo, hi - lo)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens = batch.column(1)
                ids = pc.fill_null(pc.index_in(tokens.values, keys.vocabulary), len(keys.vocabulary)).to_numpy()
                ends = tokens.offsets.to_numpy()
                found = [(i, *x) for i in np.flatnonzero(np.diff(ends)).tolist() for x in _scored(keys, ids[ends[i] : ends[i + 1]])]
                yield _found(batch.column(0), names.combine_chunks(), found)

        return texts.select("doc", "tokens").mapInArrow(run, _out(texts, quotes))

    return reduce(DataFrame.unionByName, [find(*b) for b in _blocks(lists)])


def found_quotes(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc, quote, start, length, score, occurrences): where each quote is in each text, at ``LEAST`` similarity or more.

    The most similar windows win; those that begin or end with a sentence (token places ``starts`` and ``ends`` of a text, if
    it has these columns) win ties.  Of equal windows that don't overlap, ``occurrence`` of a quote (if it has that
    column; 1 is the first, -1 the last) picks one, the first by default; with fewer there is no place, only their number.
    Quotes that have a ``doc`` are searched in that text alone.
    """
    own = "doc" in quotes.columns
    scored = (own_windows if own else scored_windows)(texts, quotes)
    edges = F.lit(0)
    if {"starts", "ends"} <= set(texts.columns):
        scored = scored.join(texts.select("doc", "starts", "ends"), "doc")
        edges = F.array_contains("starts", F.col("start")).cast("int") + F.array_contains("ends", F.col("start") + F.col("length")).cast("int")
    scored = scored.withColumn("total", F.col("score") + EDGE_BONUS * edges)
    top = F.max("total").over(Window.partitionBy("doc", "quote"))
    equal = scored.withColumn("top", top).filter(F.col("total") >= F.col("top") - 1e-9)
    spans = F.array_sort(F.collect_list(F.struct("start", (-F.col("total")).alias("less"), "length", "score")))
    apart = F.aggregate(
        spans, F.array().cast("array<struct<start:int,less:double,length:int,score:double>>"),
        lambda kept, s: F.when((F.size(kept) == 0) | (s["start"] >= F.element_at(kept, -1)["start"] + F.element_at(kept, -1)["length"]), F.concat(kept, F.array(s))).otherwise(kept),
    )
    found = equal.groupBy("doc", "quote").agg(apart.alias("kept"))
    asked = F.lit(None).cast("int")
    if "occurrence" in quotes.columns:
        by = ["doc", "quote"] if own else ["quote"]
        found, asked = found.join(quotes.select(*by, "occurrence"), by), F.col("occurrence")
    place = F.try_element_at("kept", F.coalesce(asked, F.lit(1)).cast("int"))
    return found.select("doc", "quote", place["start"].alias("start"), place["length"].alias("length"), place["score"].alias("score"), F.size("kept").alias("occurrences"))


def quote_sentences(matches: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc, quote, first_sentence, last_sentence): the sentences [word_start, word_end) that a match overlaps."""
    end = F.col("start") + F.col("length")
    met = matches.join(sentences, "doc").filter((F.col("word_start") < end) & (F.col("word_end") > F.col("start")))
    return met.groupBy("doc", "quote").agg(F.min("sentence").alias("first_sentence"), F.max("sentence").alias("last_sentence"))


def matched_quotes(quotes: DataFrame, found: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc, quote, first_sentence, last_sentence, score, refusal, other) of quotes (doc, quote, occurrence) in their own texts.

    ``found`` is of :func:`found_quotes`, sentences as of :func:`quote_sentences`.  A quote is refused (``refusal``; else null) if its text
    has it fewer times than ``occurrence`` says, if it is not found, or if no sentence holds it; of two quotes that follow on and
    share sentences, the later one is ``shared`` with the ``other``.
    """
    places = quote_sentences(found, sentences)
    met = quotes.select("doc", "quote", "occurrence").join(found, ["doc", "quote"], "left").join(places, ["doc", "quote"], "left")
    fault = (
        F.when(F.col("occurrence") > F.coalesce("occurrences", F.lit(0)), "occurrence").when(F.col("start").isNull(), "not found").when(F.col("first_sentence").isNull(), "outside")
    )
    told = met.withColumn("refusal", fault)
    by = Window.partitionBy("doc").orderBy("first_sentence", "quote")  # the quotes asked of one text
    good = told.filter("refusal IS NULL").withColumn("other", F.when(F.lag("last_sentence").over(by) >= F.col("first_sentence"), F.lag("quote").over(by)))
    good = good.withColumn("refusal", F.when(F.col("other").isNotNull(), "shared"))
    bad = told.filter("refusal IS NOT NULL").withColumn("other", F.lit(None).cast(dict(good.dtypes)["other"]))
    return good.unionByName(bad).select("doc", "quote", "first_sentence", "last_sentence", "score", "refusal", "other")
