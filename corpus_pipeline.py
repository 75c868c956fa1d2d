"""A training-corpus pipeline: quality, line dedup, near-duplicate documents, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.  For rows that are null, empty, repeated or
very long, and for empty tables, see the operators that the stages call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanternflow.llm import core, jaccard_join, line_dedup, packing, pii, quality_classifier


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    core.small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_classifier.good_only(docs, labels)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document has."""
    core.small_batches(spark)
    return core.like(line_dedup.dedup_lines(docs), docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    core.small_batches(spark)
    return jaccard_join.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data and the terms that disclose it."""
    core.small_batches(spark)
    return pii.sanitise(docs, related=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences."""
    core.small_batches(spark)
    return packing.pack_documents(docs, packing.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("pii", sanitise),
    ("packing", pack),
]

#: Training, tokenising and packing have no SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = core.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
