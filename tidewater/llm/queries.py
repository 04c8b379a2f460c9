"""Queries of this subpackage and their SQL, for `__spark_entry__`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, centroids, chat_format, exact_dedup, html_extract, language_id, mixing, near_dedup, packing, pii, quality_model, quality_rules, resampling
from .runtime import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": lambda s, d: exact_dedup.op1_exact_dedup(s, table(s, d, "documents")),
        "op2_near_dedup": lambda s, d: near_dedup.near_dedup(table(s, d, "documents")),
        "op3_html_extract": lambda s, d: html_extract.html_extract(table(s, d, "pages")),
        "op4_mixing": lambda s, d: mixing.mix(table(s, d, "documents")),
        "op5_packing": lambda s, d: packing.pack_digests(table(s, d, "documents"), bpe.tokenizer_path("byte_bpe_50k.tiktoken")),
        "op6_quality_model": lambda s, d: quality_model.quality_model(table(s, d, "documents"), table(s, d, "labels")),
        "op7_quality_rules": lambda s, d: quality_rules.op7_quality_rules(table(s, d, "documents")),
        "op8_language_id": lambda s, d: language_id.op8_language_id(table(s, d, "documents")),
        "op9_chat_format": lambda s, d: chat_format.op9_chat_format(s, table(s, d, "conversations")),
        "op10_bpe": lambda s, d: bpe.bpe_digests(table(s, d, "documents"), bpe.tokenizer_path()),
        "op11_centroids": lambda s, d: centroids.op11_centroids(table(s, d, "embeddings")),
        "op12_resampling": lambda s, d: resampling.op12_resampling(table(s, d, "documents"), table(s, d, "benchmark")),
        "op13_pii": lambda s, d: pii.op13_pii(table(s, d, "documents")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op7_quality_rules": quality_rules.ORACLE, "op9_chat_format": chat_format.ORACLE, "op11_centroids": centroids.ORACLE, "op12_resampling": resampling.ORACLE}
