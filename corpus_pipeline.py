"""A corpus from raw documents to packed sequences, stage by stage.

Each stage works on all that its predecessor kept; ``run`` writes nothing itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.llm import decontaminate, near_copies, packing, quality, queries, suffix_array
from weft.session import ship

#: SQL can't express these stages.
ORACLE_SQL = None


def _length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where it was cut."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below one half; null texts count as empty."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return quality.score(packed, quality.fit(docs, labels), to="score").where("score >= 0.5").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: five words, similarity 0.8."""
    ship(spark)
    return near_copies.without_copies(docs, width=5, least=0.8)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 200 bytes or more that occur elsewhere out of all their places."""
    ship(spark)
    return _length(suffix_array.without_repeats(docs, width=200))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the words that benchmark windows hit out of the texts."""
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _length(decontaminate.without_hits(docs, benchmark, width=10))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack(docs, queries.tokenizer_path(), room=4096, end_id=1)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near dedup", near_dedup),
    ("suffix array dedup", repeat_removal),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.shared import table

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, name.replace(" ", "-"))
    return docs
