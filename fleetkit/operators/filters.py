"""Projections and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetkit import constants as K
from fleetkit.functions import rules as R
from fleetkit.functions.dates import days_until

API_COLUMNS = ["tool_code", "tool_name", "category", "location", "status",
               "condition_score", "usage_hours"]


def _isin(col: str, values: Sequence | None):
    """pandas-style membership: a None in ``values`` also selects nulls."""
    if values is None:
        return F.lit(True)
    vals = [v for v in values if v is not None]
    cond = F.col(col).isin(vals) if vals else F.lit(False)
    if any(v is None for v in values):
        cond = cond | F.col(col).isNull()
    return F.coalesce(cond, F.lit(False))


def facet_filter(tools: DataFrame, statuses=None, categories=None, locations=None) -> DataFrame:
    """Status IN .. AND category IN .. AND location IN .. (None = all)."""
    return tools.where(_isin("status", statuses) & _isin("category", categories)
                       & _isin("location", locations))


def facet_values(tools: DataFrame) -> DataFrame:
    """Distinct values of the three facets (nulls kept)."""
    return (tools.select("status", "category", "location")
            .unpivot([], ["status", "category", "location"], "facet", "value")
            .distinct())


def api_projection(tools: DataFrame) -> DataFrame:
    """The 7-column projection of the JSON export."""
    return tools.select(*API_COLUMNS)


def risk_over(predictions: DataFrame, threshold: float = K.RISK_HIGH) -> DataFrame:
    """C4: strict ``confidence_score > threshold``."""
    return predictions.where(F.col("confidence_score") > F.lit(float(threshold)))


def urgent_items(due: DataFrame, as_of, urgent_days: int = K.URGENT_DAYS) -> DataFrame:
    """Due items at most ``urgent_days`` away (overdue included), with
    the alert wording."""
    d = days_until("next_maintenance_due", as_of)
    return (due.withColumn("days_until", d).where(F.col("days_until") <= urgent_days)
            .withColumn("urgency_text", R.alert_label("days_until")))


def maintenance_flags(tools: DataFrame, as_of) -> DataFrame:
    """Per-tool due flag: 'overdue' (< 0 days), 'warn' (<= 7), else null."""
    d = days_until("next_maintenance_due", as_of)
    return (tools.where(F.col("next_maintenance_due").isNotNull())
            .select("tool_code", d.alias("days_until"))
            .withColumn("flag", R.maintenance_flag("days_until")))
