"""Queries that run a chain of operators: melodies end to end, and stored runs of several versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions.canonical import canonical_json, digest
from strophe.operators import melody as M
from strophe.sources import runs as R
from strophe.tables import frames, load

from .registry import query


def pitch_segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Voiced frames as segments, sixteen frames to a clip, and the clips."""
    v, place = F.col("v"), F.col("i") % 16
    start = F.round(place * 0.4 + v % 1.0 * 0.1, 3)
    rows = frames(spark, d).select(F.col("stream").alias("talk"), F.floor(F.col("i") / 16).alias("clip"), "i", start.alias("start"), F.round(start + 0.15 + v % 0.3, 3).alias("end"), F.col("midi").alias("pitch"), F.col("db").alias("level"))
    clips = rows.groupBy("talk", "clip").agg(F.round(F.max("end") + 0.3, 3).alias("duration"))
    return rows.filter("pitch IS NOT NULL"), clips


@query()
def l17_melodies(spark: SparkSession, d: str) -> DataFrame:
    """Notes with the key and tempo of their talk; a test holds the whole chain against plain Python."""
    talks, notes, _ = M.melodies(*pitch_segments(spark, d), harmony=False)
    return notes.join(talks.select("talk", "tonic", "mode", "bpm"), "talk")


@query()
def l17_melody_chords(spark: SparkSession, d: str) -> DataFrame:
    return M.melodies(*pitch_segments(spark, d))[2]


@query("""WITH o AS (SELECT o_orderkey AS run_id, o_orderkey % 5 AS k, o_custkey % 4 AS s, o_custkey % 3 AS t FROM orders)
  SELECT run_id, CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END::INT AS from_version, CASE WHEN k < 3 THEN 2 END::INT AS version,
    CASE k WHEN 0 THEN 'summary' WHEN 1 THEN 'summary' WHEN 2 THEN 'full' END AS length, CASE WHEN k < 3 THEN 'ingest' END AS run_stages, CASE WHEN k < 3 THEN 'voice' END AS run_options,
    CASE WHEN k = 2 THEN 'full:mix' WHEN k < 2 AND (s > 0 OR t > 0) THEN 'summary:' || ['', 'melody', 'melody,mix', 'melody,mix'][s + 1] WHEN k < 2 THEN '' END AS song_stages,
    CASE WHEN k = 2 THEN '' WHEN k < 2 THEN CASE WHEN t > 0 THEN 'take' ELSE '' END END AS song_options FROM o""")
def k8_migrated_runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as run records of versions 1 (told or not) and 2, one to come, and texts that are no records."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    take = F.when(customer % 3 == 0, "null").otherwise(F.concat(F.lit('"'), (customer % 7).cast("string"), F.lit('"')))
    done = F.get(F.array(F.lit(""), F.lit(', "melody": "a"'), F.lit(', "mix": "b", "melody": "a"'), F.lit(', "melody": "a", "mix": "c"')), (customer % 4).cast("int"))
    first = F.concat(F.lit('"options": {"voice": "x", "take": '), take, F.lit('}, "stages": {"ingest": "f"'), done, F.lit("}}"))
    texts = [
        F.concat(F.lit("{"), first), F.concat(F.lit('{"schema_version": 1, '), first),
        F.lit('{"schema_version": 2, "length": "full", "options": {"voice": "y"}, "stages": {"ingest": "f"}, "songs": {"full": {"options": {}, "stages": {"mix": "b"}}}}'),
        F.lit('{"schema_version": 3, "options": {}, "stages": {}}'), F.lit("no record"),
    ]
    runs = load(spark, d, "orders").select(key.alias("run_id"), F.get(F.array(*texts), F.pmod(key, F.lit(5)).cast("int")).alias("record"))
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    songs = lambda f: F.array_join(F.transform(F.map_entries("run.songs"), f), ";")
    return R.migrated(runs).select(
        "run_id", "from_version", F.col("run.schema_version").alias("version"), F.col("run.length").alias("length"), names("run.stages").alias("run_stages"), names("run.options").alias("run_options"),
        songs(lambda e: F.concat(e["key"], F.lit(":"), names(e["value"]["stages"]))).alias("song_stages"), songs(lambda e: names(e["value"]["options"])).alias("song_options"),
    )


@query("""WITH p AS (SELECT p_partkey, '{"brand": "' || p_brand || '", "lengths": {"full": ' || p_size || ', "short": ' || p_size // 2 || '}, "name": "' || p_name || ' \\u00e9\\n", "styles": ["' || p_type || '", null], "tempo": {"auto": ' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || ', "bpm": ' || (60 + p_size) || '.5}}' AS text FROM part)
  SELECT p_partkey, text, sha256(text) AS digest FROM p""")
def p18_preset_digests(spark: SparkSession, d: str) -> DataFrame:
    """Parts as presets: the canonical text and digest that stages depend on."""
    size = F.col("p_size")
    preset = F.struct(
        F.concat("p_name", F.lit(" é\n")).alias("name"), F.col("p_brand").alias("brand"), F.struct((60.5 + size).alias("bpm"), (size % 2 == 0).alias("auto")).alias("tempo"),
        F.array("p_type", F.lit(None).cast("string")).alias("styles"), F.create_map(F.lit("short"), F.floor(size / 2), F.lit("full"), size.cast("long")).alias("lengths"),
    )
    rows = load(spark, d, "part").select("p_partkey", preset.alias("preset"))
    kind = rows.schema["preset"].dataType
    return rows.select("p_partkey", canonical_json(F.col("preset"), kind).alias("text"), digest(F.col("preset"), kind).alias("digest"))
