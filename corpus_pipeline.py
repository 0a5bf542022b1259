"""From raw documents to token ids: five stages, each on all that the one before it kept.

Every stage but the last returns the columns of `documents`. Its rows are written as
Parquet to the folder all executors share and read again as the next one's input, so a
lost executor never repeats a stage that is done. The tables of the stages lie in the open
workspace and go when it closes.

Every stage keeps what its operator defines: null and empty texts score, compare and encode
as texts without words, and texts without words are near-duplicates of each other, so one
stays; of rows that repeat an id and a text one stays; null ids come after all others; very long texts pass whole; an empty table passes through; extra
columns, clashing names included, pass unchanged until the last stage, which returns its own.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuswarden.llm import decontaminate, prefix_bpe, quality, secrets, simhash
from corpuswarden.session import workspace


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of the quality classifier."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the values of secrets masked; `n_chars` follows where a text changed."""
    return secrets.redact(docs, length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document."""
    return prefix_bpe.round_trip(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_a_kind),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("encoding", encode),
]

# A learned classifier, fingerprints by XXH64 and byte-pair encoding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{workspace(spark).folder}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
