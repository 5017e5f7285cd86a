"""Helpers that the corpus operators share: materialised tables, small joins, word expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words lie between spaces and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which all executors share.

    A folder of this machine is used only where the setting is unset and the master is local.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strophe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Shuffle files of the queries run inside go as soon as their result is written."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Paths of the tables made since each open :func:`scratch` began.
_SCRATCH: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/strophe/{name}-{uuid.uuid4().hex}"
    for made in _SCRATCH:
        made.append(path)
    return path


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables made inside are deleted at the end: for results that have been written elsewhere by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete(spark, path)


def materialise(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing done before."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with shuffle_files_dropped(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_all(dfs: Iterable[DataFrame], name: str, codec: str = "zstd") -> DataFrame:
    """Write tables of one schema (at least one) after each other as one: shuffle files of each go before the next runs."""
    path = None
    for df in dfs:
        path = path or new_path(df.sparkSession, name)
        with shuffle_files_dropped(df.sparkSession):
            df.write.option("compression", codec).mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialise` wrote and nobody reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/strophe/" in folder:
            delete(df.sparkSession, folder)


def if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A broadcast hint, only where a count of the (materialised) rows proves the bound; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ranks(values: DataFrame, column: str) -> DataFrame:
    """(column, rank): distinct values numbered from 0 in order, nulls first; ranges are sorted and counted on their own."""
    ordered = values.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    seq = materialise(ordered.withColumn("__seq", F.monotonically_increasing_id()), "ranks")
    part = F.shiftrightunsigned("__seq", 33)
    sizes = seq.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return seq.withColumn("__part", part).join(F.broadcast(offsets), "__part").select(column, (F.col("__before") + F.col("__seq").bitwiseAND((1 << 33) - 1)).alias("rank"))


def let(value: Column, body) -> Column:
    """Bind ``value`` once; a plain alias would be inlined into every lambda that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def total_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.sum(n_bytes(F.col(column)))).first()[0] or 0)


def buckets_for(total: int, target: int, least: int = 1) -> int:
    """How many buckets of about ``target`` bytes hold ``total`` bytes."""
    return max(least, -(-total // target))
