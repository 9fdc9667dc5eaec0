"""Registry of the operator queries and of the pipeline."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

#: query -> module that defines it
MODULES = {
    "op7_lm_scoring": "lm_scores",
    "op9_embedding_dedup": "embedding_join",
    "op8_quality_classifier": "quality_knn",
    "op10_secret_scan": "secrets",
    "op6_url_filter": "url_filter",
    "op5_mixing": "mixing",
    "op4_quality_rules": "quality_rules",
    "op3_html_extraction": "html_text",
    "op1_packing": "packing",
    "op2_simhash_dedup": "simhash",
    "op11_source_audit": "source_audit",
    "op12_conversation_repair": "conversation_repair",
    "op13_license_scan": "license_scan",
}


def llm_queries() -> dict[str, Builder]:
    return {name: getattr(importlib.import_module(f"fleetkit.llm.{module}"), name)
            for name, module in MODULES.items()}


def llm_oracles() -> dict[str, str]:
    out = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"fleetkit.llm.{module}"), "ORACLE_SQL", None)
        if sql is not None:
            out[name] = sql
    return out
