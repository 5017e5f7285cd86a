"""Fingerprinted stages: state of each stage's record, and materialisation that skips what is up to date."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(stage: str, version: int, inputs: dict[str, str], params: dict) -> str:
    """SHA-256 of what a stage's result depends on, in one canonical form."""
    return hashlib.sha256(json.dumps({"stage": stage, "version": version, "inputs": inputs, "params": params}, sort_keys=True).encode()).hexdigest()


def fingerprints(stage: Column, version: Column, inputs: Column) -> Column:
    """The same idea over rows: ``inputs`` is a map, sorted by key first."""
    entries = F.array_sort(F.map_entries(inputs))
    return F.sha2(F.to_json(F.struct(stage.alias("stage"), version.alias("version"), entries.alias("inputs"))), 256)


def states(records: DataFrame) -> DataFrame:
    """Adds state, the first that holds of: blocked, not run, failed, interrupted, stale, missing outputs, complete.

    Columns: waiting, status (null: no record), fingerprint, wanted, outputs, present.
    """
    state = (
        F.when(F.col("waiting") > 0, "blocked").when(F.col("status").isNull(), "not run").when(F.col("status") == "failed", "failed").when(F.col("status") == "running", "interrupted")
        .when(~F.col("fingerprint").eqNullSafe(F.col("wanted")), "stale").when(F.col("present") < F.col("outputs"), "missing outputs").otherwise("complete")
    )
    return records.withColumn("state", state)


def merged_options(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New options over old ones; null keeps what was."""
    names = [c for c in old.columns if c != key]
    return old.alias("o").join(new.alias("n"), key, "full").select(key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in names))


class Stages:
    """Steps of a pipeline by name, each written once for its fingerprint in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def run(self, stage: str, version: int, inputs: dict[str, str], params: dict, make: Callable[[], DataFrame]) -> tuple[DataFrame, str, bool]:
        """The stage's table, its fingerprint, and whether it had to be made; the success file marks a complete one."""
        key = fingerprint(stage, version, inputs, params)
        path = f"{self.folder}/{stage}-{key[:16]}"
        fresh = not self._exists(f"{path}/_SUCCESS")
        if fresh:
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path), key, fresh
