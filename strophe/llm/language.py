"""Language identification by string kernels.

Kernel: blended spectrum of presence, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|) over the sets of byte n-grams of
length 1 to 4 (lower case; digits, punctuation and blanks as one sign), hashed into ``DIMS`` places.  Nystroem:
``LANDMARKS`` training texts, features K(x, landmarks) K(landmarks, landmarks)^(-1/2).  One-versus-rest kernel ridge
regression on them; scoring is two matrix products per block of texts.  Every n-gram lies inside its own text and
its own blanks, and scores are rounded to ``PLACES``, so a prediction never depends on the rows beside it.

The model is fitted on a sample of the training texts: the least hashes (of id, then of text) of each language, at most
``PER_LANGUAGE`` of each and ``SAMPLE`` in all (one of each if there are more languages than that).  Rows equal in
language, id and text take places under the bound each, but enter the fit once.  What is held out, and texts without language or letter, are never seen.
Prediction takes whole texts and uses nothing else.

Defined cases: null texts and texts without a letter (Unicode category L; ``rlike`` decides it for training and
prediction alike) are ``und`` with score 0; without a training text all are; ties go to the first language in order;
null ids count as the empty string for the split; repeated rows each get the same answer; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import if_small, materialise

DIMS = 1 << 14
LANDMARKS = 128
PER_LANGUAGE = 1000
SAMPLE = 8000
RIDGE = 0.05
SHARPNESS = 6.0
PLACES = 9
TASK_GROUPS = 16
BLOCK_TEXTS, BLOCK_BYTES = 64, 1 << 20
#: All ASCII but letters becomes a blank.
PLAIN = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
SALTS = tuple(np.uint32(s) for s in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))
#: One blank before a text, and after it as many as the longest n-gram can reach.
BEFORE, AFTER = b" ", b" " * (len(SALTS) - 1)


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 per text: which places its n-grams hash to.

    An n-gram starts at the blank before its text or at a byte of it, so it ends in the blanks after it at the latest.
    """
    out = np.zeros((len(texts), DIMS), dtype=np.uint8)
    data = [BEFORE + t.lower().encode().translate(PLAIN) + AFTER for t in texts]
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    starts = np.ones(sizes.sum(), dtype=bool)
    starts[(np.cumsum(sizes)[:, None] - np.arange(1, len(AFTER) + 1)).ravel()] = False
    row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes - len(AFTER))
    b = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint32)
    gram = np.zeros(len(b), dtype=np.uint32)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    for n, salt in enumerate(SALTS):
        gram = (gram[: len(b) - n] << np.uint32(8)) | b[n:]
        h = (gram[starts[: len(gram)]] + np.uint32(n)) * salt
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
        out[row, h] = 1
    return out


class Model:
    """Landmarks (packed bits, so that little is sent), their scale, and weights from kernel values to languages."""

    def __init__(self, languages: list[str], bits: np.ndarray, labels: np.ndarray) -> None:
        self.languages = languages
        x = np.unpackbits(bits, axis=1)[:, :DIMS].astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        at = np.unique(np.linspace(0, len(x) - 1, min(LANDMARKS, len(x))).astype(int))
        self.landmarks = bits[at]
        z = x[at]
        value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
        good = value > 1e-6 * value[-1]
        root = vector[:, good] / np.sqrt(value[good])
        phi = (x @ z.T).astype(np.float64) @ root
        share = np.bincount(labels, minlength=len(languages))[labels]
        weight = len(labels) / (len(languages) * share)  # each language weighs the same
        target = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
        one = np.hstack([phi, np.ones((len(phi), 1))])
        ridge = RIDGE * np.eye(one.shape[1])
        ridge[-1, -1] = 1e-9
        solved = np.linalg.solve(one.T @ (weight[:, None] * one) + ridge, one.T @ (weight[:, None] * target))
        self.weights, self.bias = root @ solved[:-1], solved[-1]

    def unpacked(self) -> np.ndarray:
        """The landmarks as columns of 0 and 1: products with them are whole numbers, exact in any order."""
        z = np.unpackbits(self.landmarks, axis=1)[:, :DIMS].astype(np.float32)
        return np.ascontiguousarray(z.T)

    def scores(self, bits: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
        """Probabilities by language: kernel values by one product, one-versus-rest outputs by another."""
        x = bits.astype(np.float32)
        own = bits.sum(axis=1, dtype=np.float64)[:, None]
        kernel = (x @ landmarks) / np.sqrt(np.maximum(own * landmarks.sum(axis=0, dtype=np.float64), 1))
        e = SHARPNESS * (kernel @ self.weights + self.bias)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        return np.round(e / e.sum(axis=1, keepdims=True), PLACES)


def _blocks(texts: list[str | None], worded: list[bool]) -> Iterator[list[int]]:
    """Rows with a letter, a bounded number of rows and bytes at a time."""
    own: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if worded[i]:
            own.append(i)
            size += len(t)
            if len(own) >= BLOCK_TEXTS or size >= BLOCK_BYTES:
                yield own
                own, size = [], 0
    if own:
        yield own


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def sample_keys(docs: DataFrame) -> DataFrame:
    """(lang, id_hash, text_hash) of the sample.

    Ranks at or under the bound reach Spark's group limit, so each task sends at most that many rows of a language.
    """
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & has_letter(F.col("text")))
    keys = usable.select("lang", F.xxhash64("doc_id").alias("id_hash"), F.xxhash64("text").alias("text_hash"))
    languages = materialise(keys.select("lang").distinct(), "languages").count()
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(1, languages)))
    least = keys.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(TASK_GROUPS)))
    for by in (["lang", "group"], ["lang"]):  # the least of each group of tasks, then of all: no task holds all tasks' rows
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("id_hash", "text_hash"))
        least = least.withColumn("rank", rank).filter(F.col("rank") <= each).drop("rank")
    return materialise(least.select("lang", "id_hash", "text_hash").distinct(), "sample-keys")


def training_rows(docs: DataFrame) -> DataFrame:
    """(lang, id_hash, text_hash, bits) of the sample: keys are chosen first, and texts join them after."""
    keys = sample_keys(docs)
    keyed = docs.filter(~held_out() & has_letter(F.col("text"))).select("lang", F.xxhash64("doc_id").alias("id_hash"), F.xxhash64("text").alias("text_hash"), "text")
    picked = keyed.join(if_small(keys), ["lang", "id_hash", "text_hash"]).select("lang", "id_hash", "text_hash", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # at most one entry per key of the sample
        for batch in batches:
            fresh = []
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            for lo in range(0, len(fresh), BLOCK_TEXTS):
                some = batch.take(pa.array(fresh[lo : lo + BLOCK_TEXTS]))
                bits = np.packbits(presence(some.column(3).to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array([x.tobytes() for x in bits], type=pa.binary())], names=["lang", "id_hash", "text_hash", "bits"])

    found = picked.mapInArrow(run, "lang string, id_hash bigint, text_hash bigint, bits binary")
    return found.groupBy("lang", "id_hash", "text_hash").agg(F.max("bits").alias("bits"))


def fitted(docs: DataFrame) -> Model | None:
    rows = sorted((r["lang"], r["id_hash"], r["text_hash"], r["bits"]) for r in training_rows(docs).collect())
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    by = {k: i for i, k in enumerate(languages)}
    bits = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
    return Model(languages, bits, np.array([by[r[0]] for r in rows]))


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = model.unpacked() if model else None
        for batch in batches:
            texts, worded = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            names, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            for own in _blocks(texts, worded) if model else ():
                p = model.scores(presence([texts[i] for i in own]), landmarks)
                best = p.argmax(axis=1)
                names[own], scores[own] = [model.languages[k] for k in best], p[np.arange(len(own)), best]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, type=pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", held_out().alias("held_out"), "text", has_letter(F.col("text")).alias("worded"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_rows(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    return predicted(docs, fitted(docs))
