"""A corpus cleaned stage by stage, each stage an operator of ``palimpsest.llm``.

Every stage works on all that the one before kept; all but the last return the columns of ``documents``. Nulls, repeated
rows and empty tables are handled as the operators say. A text that line dedup changed has a new n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import byte_bpe, decontaminate, line_dedup, quality_cnn, simhash
from palimpsest.llm.common import fresh, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go."""
    return quality_cnn.keep_good(docs, quality_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of five and more documents stay in one; a text that had none of them is as it was, null included."""
    columns = docs.columns
    was = fresh(docs, "was")
    kept = line_dedup.dedup_lines(docs.withColumn(was, F.col("text")))
    changed = F.col("n_dropped") > 0
    kept = kept.withColumn("text", F.when(changed, F.col("text")).otherwise(F.col(was)))
    if "n_chars" in columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id; a row without doc_id goes if its group has
    one, and stays in a group of such rows alone."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate.remove_contaminated(docs, decontaminate.prepare(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("encode", encoded),
]

#: The trained classifier cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
