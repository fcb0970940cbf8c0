"""Queries and SQL of the ten operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearsay.llm import bpe, decontaminate, langid, licenses, linededup, neardup, quality, sharding, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_query,
    "op2_language_id": langid.op2_query,
    "op3_decontamination": decontaminate.op3_query,
    "op4_url_filter": urls.op4_query,
    "op5_near_duplicates": neardup.op5_query,
    "op6_toxicity": toxicity.op6_query,
    "op7_line_dedup": linededup.op7_query,
    "op8_quality_rules": quality.op8_query,
    "op9_sharding": sharding.op9_query,
    "op10_bpe": bpe.op10_query,
}
ORACLES: dict[str, str] = {
    "op4_url_filter": urls.OP4_SQL,
    "op7_line_dedup": linededup.OP7_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op9_sharding": sharding.OP9_SQL,
}
