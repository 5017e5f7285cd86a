"""The queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, chat, decontaminate, language, manifest, mixing, pieces, quality, sharding, simhash, substrings, tokens, trie
from .common import materialise, table
from .sql import ORACLE


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_index(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


#: Conversation -1 is a JSON record of another layout than the table, and holds control strings.
PROBE = """{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}"""


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows and a JSON record, each by the mapping its fingerprint selects; the formatted table is written and read back."""
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(PROBE).alias("record"))
    table_turns = chat.turn_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return chat.digests(materialise(chat.formatted(table_turns.unionByName(chat.json_turn_rows(probe))), "chat"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 8)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_rows(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_rows(table(spark, sf_dir, "documents"))


def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = attribution.section_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return counts.withColumn("n_tokens", F.col("n_tokens").cast("long"))  # whole under the majority rule


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proofs(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie_nodes(trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (op1_token_orc, op2_chat_format, op3_kd_shards, op4_quality_rules, op5_language_id, op6_mix_sources, op7_simhash, op8_token_attribution, op9_substring_dedup, op10_decontaminate, op11_merkle_manifest, op12_sentencepiece, op13_prefix_trie)
}

__all__ = ["ORACLE", "QUERIES"]
