"""Queries of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphloom.llm import alignment, chat_format, decontamination, divergence, line_dedup, mixing, quality_rules, secret_scan, sharding, simhash, token_counts, toxicity, url_filter

_OPERATORS = (
    url_filter.op1_url_filter,
    mixing.op2_mixing,
    toxicity.op3_toxicity,
    simhash.op4_simhash,
    chat_format.op5_chat_format,
    line_dedup.op6_line_dedup,
    secret_scan.op7_secret_scan,
    token_counts.op8_token_counts,
    quality_rules.op9_quality_rules,
    decontamination.op10_decontamination,
    divergence.op11_divergence_audit,
    alignment.op12_alignment,
    sharding.op13_sharding,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.SQL, "op2_mixing": mixing.SQL, "op5_chat_format": chat_format.SQL, "op10_decontamination": decontamination.SQL, "op11_divergence_audit": divergence.SQL}
