"""Queries of the training-data operators over the driver's tables, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heatgraph.llm import credentials, langid, media, mixing, packing, quality, simhash, sql, substring, toxicity, weaklabel


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the driver's folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return credentials.secret_report(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, whole, in sequences limited in tokens, segments and loss-bearing tokens."""
    return packing.pack_conversations(_table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as FLAC and read back."""
    return media.media_report(_table(spark, sf_dir, "documents"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated until all sources have equal shares."""
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op7_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores learned from the votes of heuristics."""
    return weaklabel.weak_label_report(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores learned from the labels."""
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages that an earlier one has."""
    return substring.substring_report(_table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the near-copy group of every document."""
    return simhash.simhash_report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "pipeline": pipeline,
    "op1_secret_scans": op1_secret_scans,
    "op2_language_id": op2_language_id,
    "op3_vector_packing": op3_vector_packing,
    "instruction_packing": instruction_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_flac_media": op5_flac_media,
    "op6_poisson_mixing": op6_poisson_mixing,
    "op7_weak_labels": op7_weak_labels,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash_dedup": op10_simhash_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op1_secret_scans": sql.secrets_sql(),
    "op4_quality_rules": sql.quality_sql(),
    "op6_poisson_mixing": mixing.mix_sql(),
    "op9_substring_dedup": sql.substring_sql(),
}
