"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm import bpe, decontaminate, quality_classifier, quality_rules, secrets, secrets_sql, simhash, substring_dedup, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_bpe": bpe.op2_bpe,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_warc": warc.op6_warc,
    "op7_secrets": secrets.op7_secrets,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": substring_dedup.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op6_warc": warc.SQL,
    "op7_secrets": secrets_sql.SQL,
    "op8_decontamination": decontaminate.SQL,
    "op9_url_filter": url_filter.SQL,
}
