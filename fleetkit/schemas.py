"""Domain table schemas (tools, usage, maintenance, predictions, events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, D, TS, DBL, L, I = (T.StringType(), T.DateType(), T.TimestampNTZType(),
                       T.DoubleType(), T.LongType(), T.IntegerType())
MONEY = T.DecimalType(18, 2)


def _f(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


TOOLS = T.StructType([
    _f("tool_code", S, False), _f("tool_name", S, False), _f("category", S, False),
    _f("location", S, False), _f("purchase_date", D), _f("last_maintenance_date", D),
    _f("next_maintenance_due", D), _f("status", S), _f("condition_score", DBL),
    _f("usage_hours", DBL), _f("maintenance_cost", MONEY), _f("created_at", TS),
    _f("updated_at", TS),
])

USAGE = T.StructType([
    _f("seq", L), _f("tool_code", S, False), _f("user_id", S, False),
    _f("checkout_time", TS), _f("checkin_time", TS), _f("usage_duration", DBL),
    _f("usage_type", S), _f("notes", S), _f("created_at", TS),
])

MAINTENANCE = T.StructType([
    _f("seq", L), _f("tool_code", S, False), _f("maintenance_date", D, False),
    _f("maintenance_type", S, False), _f("description", S), _f("cost", MONEY),
    _f("technician", S), _f("condition_before", DBL), _f("condition_after", DBL),
    _f("created_at", TS),
])

PREDICTIONS = T.StructType([
    _f("tool_code", S, False), _f("prediction_date", D, False),
    _f("predicted_failure_date", D), _f("confidence_score", DBL),
    _f("maintenance_priority", S), _f("model_version", S), _f("created_at", TS),
    _f("days_until_maintenance", I), _f("condition_risk", DBL), _f("anomaly_risk", DBL),
])

# Check-out / check-in events (batch table or stream).
TOOL_EVENTS = T.StructType([
    _f("seq", L), _f("ts", TS), _f("tool_code", S), _f("user_id", S), _f("event_kind", S),
])

SCANS = T.StructType([_f("seq", L), _f("ts", TS), _f("code", S)])

STATUS_UPDATES = T.StructType([_f("seq", L), _f("tool_code", S), _f("status", S)])

# Bulk-import / intake batch: the CSV template columns plus arrival order.
INTAKE = T.StructType([
    _f("seq", L), _f("tool_code", S), _f("tool_name", S), _f("category", S),
    _f("location", S), _f("purchase_date", D), _f("condition_score", DBL),
])

INTAKE_CSV = T.StructType([
    _f("tool_code", S), _f("tool_name", S), _f("category", S), _f("location", S),
    _f("purchase_date", D), _f("condition_score", DBL),
])

LABEL_BATCH = T.StructType([_f("seq", L), _f("tool_code", S), _f("tool_name", S)])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
