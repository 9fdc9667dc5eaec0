"""Registry of all query keys (oracle-checked and rows-only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit import constants as K
from fleetkit.operators import risk
from fleetkit.plans import catalog, rows_only

Builder = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """J1 features -> J8 urgency -> the k most urgent tools (a top-k report)."""
    scored = risk.urgency_scores(catalog.features(spark, sf_dir))
    return (scored.select("tool_code", "category", "location", "status", "condition_score",
                          "total_usage_hours", "days_since_last_maintenance", "usage_intensity",
                          F.round("urgency_score", 6).alias("urgency_score"))
            .orderBy(F.col("urgency_score").desc(), "tool_code").limit(k))


def spark_queries() -> dict[str, Builder]:
    out = {k: fn for k, (fn, _) in catalog.REGISTRY.items()}
    out.update(rows_only.REGISTRY)
    return out


def oracle_queries() -> dict[str, str]:
    out = {k: sql for k, (_, sql) in catalog.REGISTRY.items() if sql is not None}
    out.update(rows_only.ORACLES)
    return out


__all__ = ["flagship", "spark_queries", "oracle_queries", "K"]
