"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import digests

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out_prediction

    return held_out_prediction(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gated_lm import score

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import hex_fingerprint, near_duplicates

    groups = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, radius=4)
    return groups.select("doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_digest import scan

    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_tools import declared_tools, events

    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return events(messages, declared_tools(messages))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_audit import audit

    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import trie

    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import digests

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from . import chat_tools, decontaminate, license_digest, prefix_trie, source_audit, warc

    return {
        "op3_decontaminate": decontaminate.ORACLE,
        "op8_warc": warc.ORACLE,
        "op9_license_digest": license_digest.oracle(),
        "op10_chat_tools": chat_tools.ORACLE,
        "op11_source_audit": source_audit.ORACLE,
        "op12_prefix_trie": prefix_trie.ORACLE,
    }
