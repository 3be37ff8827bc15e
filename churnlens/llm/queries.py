"""Registered queries of the document operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from churnlens.llm import (
    bpe,
    chat,
    decontaminate,
    divergence,
    html_text,
    langid,
    licenses,
    minhash,
    packing,
    quality_model,
    quality_rules,
    repeats,
    spelling,
)
from churnlens.llm.oracles import ORACLES
from churnlens.llm.tables import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(langid.document_evidence(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages"))
    return pages.selectExpr("page_id", "visible_text AS text", "CAST(length(visible_text) AS BIGINT) AS n_chars")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.conversation_digests(chat.format_conversations(chat.table_records(rows)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID of the web pages: visible text, markup language and address."""
    pages = html_text.extract(table(spark, sf_dir, "pages"))
    return langid.identify(langid.page_evidence(pages, pages["visible_text"])).withColumnRenamed("id", "page_id")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), path, digest=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_language_id,
        op2_license_scan,
        op3_byte_bpe,
        op4_minhash_near_dedup,
        op5_html_extraction,
        op6_chat_formatting,
        op7_quality_rules,
        op8_quality_classifier,
        op9_suffix_array_dedup,
        op10_benchmark_decontamination,
        op11_spelling_variants,
        op12_packing,
        op13_source_divergence,
        language_id_pages,
    ]
    return {f.__name__: f for f in named}


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
