"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plausia.llm import decontamination, language_id, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup, token_counts, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality_classifier.query,
        "op2_token_counts": token_counts.query,
        "op3_quality_rules": quality_rules.query,
        "op4_near_dedup": near_dedup.query,
        "op5_language_id": language_id.query,
        "op6_toxicity": toxicity.query,
        "op7_mixing": mixing.query,
        "op8_substring_dedup": substring_dedup.query,
        "op9_url_filter": url_filter.query,
        "op10_decontamination": decontamination.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.ORACLE_SQL,
        "op4_near_dedup": near_dedup.ORACLE_SQL,
        "op8_substring_dedup": substring_dedup.ORACLE_SQL,
        "op9_url_filter": url_filter.ORACLE_SQL,
    }
