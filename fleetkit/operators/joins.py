"""Joins (D1-D6).

No join here forces a broadcast: the tools table grows with the fleet, so the
strategy is left to AQE, which broadcasts a side only when its measured size
is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise plans a
sort-merge join whose skewed partitions it splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetkit import constants as K
from fleetkit.functions import rules as R


def scan_enrich(scans: DataFrame, tools: DataFrame) -> DataFrame:
    """Each scanned code with its tool, or found = false.  Duplicate
    scans stay (one output row per scan)."""
    t = tools.select(F.col("tool_code").alias("code"), "tool_name", "status", "category",
                     "location", F.lit(True).alias("_found"))
    return (scans.join(t, "code", "left")
            .withColumn("found", F.coalesce(F.col("_found"), F.lit(False))).drop("_found"))


def risk_digest(predictions: DataFrame, tools: DataFrame, threshold: float = K.RISK_HIGH) -> DataFrame:
    """D6 + K2: high-risk predictions enriched with the tool's name."""
    hi = predictions.where(F.col("confidence_score") > F.lit(float(threshold)))
    return (hi.join(tools.select("tool_code", "tool_name", "location"), "tool_code", "inner")
            .select("tool_code", "tool_name", "location",
                    R.percent1(F.col("confidence_score")).alias("risk_text"),
                    "maintenance_priority", "predicted_failure_date", "days_until_maintenance",
                    F.lit(K.RISK_ALERT_ACTION).alias("recommended_action")))
