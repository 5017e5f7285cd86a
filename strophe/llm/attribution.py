"""Token counts by section, attributed by offsets.

Whole documents are encoded once; byte-level tokens cover the text without gaps, so their lengths give the
span of each.  Sections are the lines of a text, each with its line break.  Spans and sections, both in
order, meet in one merge by binary search, and a token over a boundary goes by an explicit rule:

* ``majority``: the section with most of its bytes, the earlier one if equal (the default),
* ``start``: the section of its first byte,
* ``split``: to each section the share of its bytes.

Defined cases: null and empty texts have one empty section without tokens; a final line break ends the last
section and opens no other; ids of any type play no part, so repeated rows and null ids each come back; an empty table gives an
empty result; other columns are ignored.  Texts with very long runs without a break are encoded whole as well.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "section bigint, start_char bigint, n_chars bigint, n_tokens double, n_crossing bigint"


class Encoder:
    """Ids and byte spans by a file of ranks (token, rank per line)."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The end of each token in bytes."""
        return np.cumsum(self.length[np.array(self.encoding.encode_ordinary(text), dtype=np.int64)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, pattern)
    return _ENCODERS[path]


def section_starts(data: np.ndarray) -> np.ndarray:
    """The first byte of each line."""
    breaks = np.flatnonzero(data == 10) + 1
    return np.r_[0, breaks[breaks < len(data)]]


def attributed(ends: np.ndarray, starts: np.ndarray, size: int, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of those touch more than one section."""
    n = len(starts)
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    crossing = np.flatnonzero(first != last)
    counts = np.bincount(first[first == last], minlength=n).astype(np.float64)
    touched = np.zeros(n, dtype=np.int64)
    stops = np.r_[starts[1:], size]
    for t in crossing.tolist():
        a, b = int(begins[t]), int(ends[t])
        over = np.arange(first[t], last[t] + 1)
        held = np.minimum(stops[over], b) - np.maximum(starts[over], a)
        if rule == "split":
            counts[over] += held / (b - a)
            touched[over] += 1
        else:
            to = over[0] if rule == "start" else over[np.argmax(held)]
            counts[to] += 1
            touched[to] += 1
    return counts, touched


def section_tokens(docs: DataFrame, ranks: str, pattern: str, rule: str = "majority") -> DataFrame:
    """One row per section of each text: its characters, its tokens, and those of them that cross a boundary."""
    if rule not in ("majority", "start", "split"):
        raise ValueError(f"no such rule: {rule}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks, pattern)
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                starts = section_starts(data)
                counts, touched = attributed(code.ends(text), starts, len(data), rule)
                letters = np.r_[0, np.cumsum((data & 0xC0) != 0x80)] if not text.isascii() else np.arange(len(data) + 1)
                at = letters[starts]
                found.append((np.full(len(starts), i), np.arange(len(starts)), at, np.diff(np.r_[at, letters[-1]]), counts, touched))
            if found:
                row, section, at, chars, counts, touched = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, (section, at, chars, counts, touched))], names=["doc_id", "section", "start_char", "n_chars", "n_tokens", "n_crossing"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")
