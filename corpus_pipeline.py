"""Training-corpus pipeline: language ID, near-dedup, repeated passages, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder (spark.checkpoint.dir) and read again as the
next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from churnlens.llm import bpe, decontaminate, langid, minhash, repeats
from churnlens.llm.tables import table
from churnlens.session import scratch_path, ship_package

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each class of near duplicates: links at a similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with repeated passages of 50 words or more cut but for one occurrence."""
    return repeats.cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the text, and the text decoded from them."""
    back = bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN)
    return back.selectExpr("doc_id", "size(ids) AS n_tokens", "ids", "decode(decoded, 'UTF-8') AS text")


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: Signatures, suffix arrays and merges can't be written in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
