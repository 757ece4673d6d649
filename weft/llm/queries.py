"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(_read(spark, sf_dir, "documents"))


def _held_out(docs: DataFrame, of: int, which: int) -> DataFrame:
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))
    return docs.withColumn("held_out", F.coalesce(remainder == which, F.lit(False)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, languages

    docs = _held_out(_read(spark, sf_dir, "documents"), 4, 2)
    found = languages(docs, fit(docs.where("not held_out")))
    return _held_out(found, 4, 2).select("doc_id", "held_out", "lang_pred", "score", "shares")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), width=3, radius=2)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"), least=0.93)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated, digest

    return digest(contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), width=10))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs = _held_out(_read(spark, sf_dir, "documents").select("doc_id", "text"), 3, 1)
    learned = fit(docs.where("not held_out"), _read(spark, sf_dir, "labels"))
    return score(docs, learned).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file on this machine; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_array import digest, suffix_repeats

    return digest(suffix_repeats(_read(spark, sf_dir, "documents"), width=200))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), tokenizer_path(), room=4096, end_id=1)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .block_anchors import block_repeats, digest

    return digest(block_repeats(_read(spark, sf_dir, "documents"), width=35))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}
