"""Table scans (A1-A5, A12): explicit projections and pushed-down filters.

Filters are plain Column predicates on the scanned DataFrame, so Catalyst
pushes them into the Parquet reader (``PushedFilters``) and prunes columns
(``ReadSchema``).  Sorting is applied last and only where the reference
defines an order; ties are broken by the business key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetkit import constants as K
from fleetkit.functions.dates import as_of_date

TOOL_COLUMNS = [
    "tool_code", "tool_name", "category", "location", "purchase_date",
    "last_maintenance_date", "next_maintenance_due", "status", "condition_score",
    "usage_hours", "maintenance_cost", "created_at", "updated_at",
]


def tools_scan(tools: DataFrame) -> DataFrame:
    """A1: every tool, explicit column list."""
    return tools.select(*TOOL_COLUMNS)


def tool_lookup(tools: DataFrame, tool_code: str) -> DataFrame:
    """A2: point lookup; an empty frame means 'not found'."""
    return tools.where(F.col("tool_code") == F.lit(tool_code))


def usage_scan(usage: DataFrame, tool_code: str | None = None) -> DataFrame:
    """A3: usage rows newest first (null checkout times last)."""
    df = usage if tool_code is None else usage.where(F.col("tool_code") == F.lit(tool_code))
    return df.orderBy(F.col("checkout_time").desc_nulls_last(), F.col("seq").asc())


def predictions_scan(predictions: DataFrame, tool_code: str | None = None) -> DataFrame:
    """A4: all predictions by confidence then date (both descending); one
    tool's predictions by date descending, repeats of a date by creation time and
    confidence."""
    if tool_code is None:
        return predictions.orderBy(F.col("confidence_score").desc_nulls_last(),
                                   F.col("prediction_date").desc_nulls_last(), F.col("tool_code"))
    return (predictions.where(F.col("tool_code") == F.lit(tool_code))
            .orderBy(F.col("prediction_date").desc_nulls_last(), F.col("created_at").desc_nulls_last(),
                     F.col("confidence_score").desc_nulls_last()))


def due_filter(as_of, days_ahead: int):
    """Due within ``days_ahead`` days of the as-of *date* (inclusive) and not
    already in maintenance.  Null due dates and null statuses drop out."""
    return ((F.col("next_maintenance_due") <= F.date_add(as_of_date(as_of), days_ahead))
            & (F.col("status") != F.lit("maintenance")))


def due_scan(tools: DataFrame, as_of, days_ahead: int = K.DUE_HORIZON_ALERT) -> DataFrame:
    """A5 + G1: tools due for maintenance, earliest due first."""
    return tools.where(due_filter(as_of, days_ahead)).orderBy("next_maintenance_due", "tool_code")


def maintenance_log(maintenance: DataFrame, tool_code: str | None = None) -> DataFrame:
    """Maintenance history, newest first."""
    df = maintenance if tool_code is None else maintenance.where(F.col("tool_code") == F.lit(tool_code))
    return df.orderBy(F.col("maintenance_date").desc(), F.col("seq").desc())
