"""Token ids in ORC: integer run-length encoded lists, row indexes, and Bloom filters on document ids.

Texts are dealt by ranges of ids, sorted, encoded and written; so files and stripes follow in id order, a
reader of some ids skips by file, stripe and row-index statistics and by Bloom filter, and stripes can be read
in parallel.  Any tokenizers file does.  Where a file declares the normaliser and the cut that ``KNOWN`` states, the
encoder cuts ordinary texts so itself and remembers pieces: a new piece goes through the file's own model, and a text
with anything out of the ordinary through the whole tokenizer.  With any other file every text does.

Defined cases: null text is empty and has the end id alone; null ids sort first; rows of equal id are in the order of
the first ``PREFIX`` characters of their texts (null first), then of their hashes, so one id can span many files; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, if_small, materialise, new_path, shuffle_files_dropped, total_bytes

END_ID = 1
FILE_BYTES = 24 << 20
#: Files grow rather than become more than this.
MOST_FILES = 50_000
PREFIX = 64
ROWS_AT_ONCE_BYTES = 16 << 20
#: How this tokenizer cuts lower-case Latin-1 text (its own pattern; fixed value).
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Latin-1 characters that are control characters, white space to one library only, or letters and numbers outside the ranges above.
ODD = bytes([*range(0x09), *range(0x0E, 0x20), *range(0x7F, 0xA1), 0xAA, 0xAD, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE])
PIECES_KEPT = 400_000
#: What a file must declare for its texts to be cut here (fixed values of its format).
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
}


def cuts_as_here(declared: dict) -> bool:
    """Does a tokenizers file, as a dictionary, cut ordinary texts as :data:`PIECES` does?"""
    model = declared["model"]
    marked = all(t["content"].startswith("<|") and not t["normalized"] for t in declared["added_tokens"])
    return marked and model["type"] == "BPE" and not model.get("dropout") and all(declared.get(k) == v for k, v in KNOWN.items())


def ordinary(text: str) -> bool:
    """Can the text be cut here?  Latin-1 without odd characters or what may be a special token."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return len(data.translate(None, ODD)) == len(data) and "<|" not in text


class Encoder:
    """Encodes texts with a tokenizers file; pieces seen are kept in two generations of bounded size."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.cuts = cuts_as_here(json.loads(self.whole.to_str()))
        self.model = self.whole.model
        self.mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.young.get(piece) or self.old.get(piece)
        if found is None:
            mapped = piece if piece.isascii() else "".join(m for m, _ in self.mapped(piece))
            found = np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()
        if len(self.young) >= PIECES_KEPT:
            self.young, self.old = {}, self.young
        self.young[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.cuts or not ordinary(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        pieces = PIECES.findall(text.lower())
        out = [*map(self.young.get, pieces)]
        if None in out:
            out = [ids if ids is not None else self._piece(p) for p, ids in zip(pieces, out, strict=True)]
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, so that words stay known from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of (doc_id, text), the end id last."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            lo, parts, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                parts.append(encode(text.as_py() or "") + end)
                size += len(parts[-1])
                if size > ROWS_AT_ONCE_BYTES or i == batch.num_rows - 1:
                    counts = np.array([len(p) // 4 for p in parts], dtype=np.int64)
                    values = pa.Array.from_buffers(pa.int32(), int(counts.sum()), [None, pa.py_buffer(b"".join(parts))])
                    ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(parts)), pa.array(counts), ids], names=["doc_id", "n_tokens", "ids"])
                    lo, parts, size = i + 1, [], 0

    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>")


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write the ids of all texts as ORC in id order; ``seq`` numbers rows in that order (file in the high bits)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = min(MOST_FILES, buckets_for(total_bytes(rows), FILE_BYTES, 4))
    # the last keys split an id of many rows; only rows of equal id and text can change places
    keys = {"__prefix": F.substring("text", 1, PREFIX), "__hash": F.xxhash64("text"), "__row": F.monotonically_increasing_id()}
    order = ["doc_id", *keys]
    ordered = rows.withColumns(keys).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = encoded(ordered.select("doc_id", "text"), tokenizer).withColumn("seq", F.monotonically_increasing_id())
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}
    with shuffle_files_dropped(docs.sparkSession):
        out.write.options(**options).orc(path)


ORC_SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, seq bigint"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORC_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some ids: the filter reaches the ORC reader, which prunes by statistics and Bloom filters."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(ids))


def index_rows(tokens: DataFrame) -> DataFrame:
    """Per document, from its ids as read: start (ids of all documents before), n_tokens and ids_crc32.

    Counts add up per file first; so a window holds one file's rows, or one row per file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy()).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends)), pa.array(sums, type=pa.int64())], names=["doc_id", "seq", "n_tokens", "ids_crc32"])

    rows = materialise(tokens.select("doc_id", "seq", "ids").mapInArrow(run, "doc_id bigint, seq bigint, n_tokens bigint, ids_crc32 bigint").withColumn("file", F.shiftrightunsigned("seq", 33)), "token-rows")
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = materialise(sums.select("file", F.coalesce(F.sum("n").over(before(Window.orderBy("file"))), F.lit(0)).alias("before")), "token-files")
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("file").orderBy("seq"))), F.lit(0))
    return rows.withColumn("inside", inside).join(if_small(files), "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_index(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write, read back, index."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path)
    return index_rows(read_tokens(docs.sparkSession, path))
