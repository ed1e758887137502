"""Queries of the training-data operators by name: each applies its operator to the whole of its table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_decontamination": "decontamination",
    "op2_ngram_join": "ngram_join",
    "op3_chat_format": "chat",
    "op4_quality_rules": "quality",
    "op5_minimax_shards": "sharding",
    "op6_byte_bpe": "bpe",
    "op7_line_dedup": "line_dedup",
    "op8_html_main_text": "html",
    "op9_toxicity": "toxicity",
    "op10_license_scan": "licenses",
    "op11_quality_gam": "gam",
    "op12_source_divergence": "divergence",
    "op13_periodic_runs": "periodic",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"gazette.llm.{module}").query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"gazette.llm.{module}"), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
