"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing to target weights, sharding.

Each stage is written as Parquet and read again as the documents of the next; so a lost executor costs the
stage it works on, not what came before.  All stages but the last return the columns of ``documents``.

Null ids, texts, languages and sources, repeated rows, empty tables and extra columns are as the operators
define them: rows of equal id that near-dedup meets count as copies, and the mix repeats rows it takes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strophe.llm import decontaminate, mixing, neardup, quality, sharding
from strophe.llm.common import drop_table, materialise, new_path, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every adaptive threshold."""
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash over five-word shingles, similarity 0.8 or more by an exact check."""
    return neardup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix with their shard and slot."""
    return sharding.sharded(docs, 8)


STAGES = [
    ("quality rules", quality_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Components, singular vectors and pivotal draws are iterative, so SQL can't express the rows of ``run``; a test
#: holds each stage's rows against brute force over the rows of the stage before.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: documents' columns, shard and slot.  What a stage made on its way goes once its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            kept = materialise(stage(spark, docs, sf_dir), name, path=path)
        if n:
            drop_table(docs)
        docs = kept
    return docs


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Run all stages and write the corpus: a folder per shard, rows in the order of their slots."""
    docs = run(spark, sf_dir)
    sharding.write_shards(docs, path)
    drop_table(docs)
