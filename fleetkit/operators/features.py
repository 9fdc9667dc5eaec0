"""Feature frame (J1): tools + usage and maintenance statistics + derived
features, one row per tool.

Both statistics are aggregated *before* the joins (no usage x maintenance
fan-out) and are one row per tool; each aggregate is already hash-partitioned
by ``tool_code``, so when the joins are sort-merge joins only the tools side
is shuffled (AQE broadcasts the statistics instead when they are small).
Derived features are computed before the null-fill, as in the reference: a
tool without usage rows gets a null ratio that is then filled with 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetkit.functions.dates import days_since
from fleetkit.functions.rules import safe_div
from fleetkit.operators.kpis import maintenance_stats, usage_stats

USAGE_STATS = ("total_usage_hours", "avg_usage_hours", "usage_count", "checkout_count")
MAINT_STATS = ("total_maintenance_cost", "avg_maintenance_cost", "maintenance_count")
DERIVED = ("days_since_purchase", "days_since_last_maintenance", "usage_intensity",
           "maintenance_frequency", "cost_per_hour")


def prepare_features(tools: DataFrame, usage: DataFrame, maintenance: DataFrame, as_of,
                     usage_empty: bool | None = None, maintenance_empty: bool | None = None) -> DataFrame:
    """J1.  ``*_empty`` may be passed when known; otherwise a LIMIT-1 probe
    (``isEmpty``) decides, since a wholly empty table yields 0-filled
    statistics *before* the derived features (not nulls)."""
    if usage_empty is None:
        usage_empty = usage.isEmpty()
    if maintenance_empty is None:
        maintenance_empty = maintenance.isEmpty()

    f = tools
    if usage_empty:
        f = f.select("*", F.lit(0.0).alias("total_usage_hours"), F.lit(0.0).alias("avg_usage_hours"),
                     F.lit(0).cast("long").alias("usage_count"), F.lit(0).cast("long").alias("checkout_count"))
    else:
        f = f.join(usage_stats(usage), "tool_code", "left")
    if maintenance_empty:
        f = f.select("*", F.lit(0.0).alias("total_maintenance_cost"), F.lit(0.0).alias("avg_maintenance_cost"),
                     F.lit(0).cast("long").alias("maintenance_count"),
                     F.lit(None).cast("date").alias("last_maintenance"))
    else:
        f = f.join(maintenance_stats(maintenance), "tool_code", "left")

    dsp = days_since("purchase_date", as_of)
    f = f.select(
        "*",
        dsp.alias("days_since_purchase"),
        days_since("last_maintenance", as_of).alias("days_since_last_maintenance"),
        safe_div(F.col("total_usage_hours"), dsp + 1).alias("usage_intensity"),
        (safe_div(F.col("maintenance_count"), dsp + 1) * F.lit(365.0)).alias("maintenance_frequency"),
        safe_div(F.col("total_maintenance_cost"), F.col("total_usage_hours") + 1).alias("cost_per_hour"),
    )
    numeric = [fld.name for fld in f.schema.fields if isinstance(fld.dataType, T.NumericType)]
    return f.select(*[F.coalesce(F.col(c), F.lit(0).cast(f.schema[c].dataType)).alias(c) if c in numeric
                      else F.col(c) for c in f.columns])
