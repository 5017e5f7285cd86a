"""Stored run records of several schema versions, brought to the newest by a chain of struct transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What belongs to a song since version 2, and the name of the song that a run of version 1 was.
SONG_STAGES = ("select", "clips", "melody", "arc", "arrange", "generate", "take", "mix")
SONG_OPTIONS = ("clips", "take")
SUMMARY = "summary"
NEWEST = 2

#: The fields of all versions; what a version doesn't have is null.
PARTS = "options map<string,string>, stages map<string,string>"
RECORD = f"schema_version int, length string, {PARTS}, songs map<string,struct<{PARTS.replace(' map', ':map')}>>"


def _empty() -> Column:
    return F.create_map().cast("map<string,string>")


def _split(values: Column, names: tuple[str, ...]) -> tuple[Column, Column]:
    """Entries of the names and the others; a null map has none."""
    held = F.coalesce(values, _empty())
    return F.map_filter(held, lambda k, _: k.isin(*names)), F.map_filter(held, lambda k, _: ~k.isin(*names))


def song_of_its_own(r: Column) -> Column:
    """Version 1 to 2: the run's song becomes its summary; options that are null go, a run without a song gets none."""
    song_stages, stages = _split(r["stages"], SONG_STAGES)
    song_options, options = _split(r["options"], SONG_OPTIONS)
    song = F.struct(F.map_filter(song_options, lambda _, v: v.isNotNull()).alias("options"), song_stages.alias("stages"))
    has = (F.size(song["options"]) > 0) | (F.size(song["stages"]) > 0)
    songs = F.when(has, F.create_map(F.lit(SUMMARY), song)).otherwise(F.create_map().cast(f"map<string,struct<{PARTS.replace(' map', ':map')}>>"))
    return F.struct(F.lit(2).alias("schema_version"), F.lit(SUMMARY).alias("length"), options.alias("options"), stages.alias("stages"), songs.alias("songs"))


#: From each version to the next.
CHAIN: dict[int, Callable[[Column], Column]] = {1: song_of_its_own}


def migrated(runs: DataFrame, record: str = "record") -> DataFrame:
    """``runs`` with its JSON records as structs of the newest version in ``run``.

    A record without a version is of version 1; ``run`` is null for one of an unknown version or that isn't JSON.
    """
    found = runs.withColumn("__r", F.from_json(record, RECORD))
    whole = F.col("__r.schema_version").isNotNull() | F.col("__r.options").isNotNull() | F.col("__r.stages").isNotNull()
    now = found.withColumn("__v", F.when(whole, F.coalesce(F.col("__r.schema_version"), F.lit(1)))).withColumn("__old", F.col("__v"))
    shape = dict(found.dtypes)["__r"]
    for version in range(1, NEWEST):
        step = F.col("__v") == version
        now = now.withColumn("__r", F.when(step, CHAIN[version](F.col("__r")).cast(shape)).otherwise(F.col("__r"))).withColumn("__v", F.when(step, version + 1).otherwise(F.col("__v")))
    return now.withColumn("run", F.when(F.col("__v") == NEWEST, F.col("__r"))).withColumn("from_version", F.col("__old")).drop("__r", "__v", "__old")


def refusals(runs: DataFrame) -> DataFrame:
    """(from_version, n) of records that :func:`migrated` refused; null is no record at all."""
    return runs.filter("run IS NULL").groupBy("from_version").agg(F.count("*").alias("n"))
