"""Risk rules: urgency (J8), fusion into predictions (J9, J10),
recommendations (J13) and the retrain decision (J14).  Pure Columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetkit import constants as K
from fleetkit.functions import rules as R
from fleetkit.functions.dates import as_of_date, ts_lit


def urgency_score():
    """(10 - condition)/2.5 + min(3 * intensity, 3) if intensity > 0
    + min(days since maintenance / 30, 3) if that is > 0."""
    cond = (F.lit(10.0) - F.col("condition_score")) / F.lit(2.5)
    use = F.when(F.col("usage_intensity") > 0, F.least(F.col("usage_intensity") * F.lit(3.0), F.lit(3.0))).otherwise(0.0)
    dsm = F.col("days_since_last_maintenance")
    age = F.when(dsm > 0, F.least(dsm / F.lit(30.0), F.lit(3.0))).otherwise(0.0)
    return cond + use + age


def urgency_scores(features: DataFrame) -> DataFrame:
    return features.withColumn("urgency_score", urgency_score())


def fuse(scored: DataFrame, as_of, model_version: str = K.MODEL_VERSION) -> DataFrame:
    """``scored`` has tool_code, condition_pred (predicted 10 - condition)
    and anomaly_score (signed decision score, negative = anomalous)."""
    cr = F.least(F.col("condition_pred") / F.lit(10.0), F.lit(1.0))
    ar = R.sigmoid_neg(F.col("anomaly_score"))
    risk = cr * F.lit(K.CONDITION_WEIGHT) + ar * F.lit(K.ANOMALY_WEIGHT)
    out = scored.select("tool_code", cr.alias("condition_risk"), ar.alias("anomaly_risk"),
                        risk.alias("confidence_score"))
    days = F.greatest(F.lit(1), (F.lit(float(K.FAILURE_HORIZON_DAYS)) * (F.lit(1.0) - F.col("confidence_score"))).cast("int"))
    return out.select(
        "tool_code",
        as_of_date(as_of).alias("prediction_date"),
        F.date_add(as_of_date(as_of), days).alias("predicted_failure_date"),
        "confidence_score",
        R.priority(F.col("confidence_score")).alias("maintenance_priority"),
        F.lit(model_version).alias("model_version"),
        ts_lit(as_of).alias("created_at"),
        days.alias("days_until_maintenance"),
        "condition_risk", "anomaly_risk",
    )


def recommendations(predictions: DataFrame, threshold: float = K.RISK_RECOMMEND) -> DataFrame:
    """Actionable rows for risk > threshold."""
    r = F.col("confidence_score")
    return predictions.where(r > F.lit(float(threshold))).select(
        "tool_code",
        F.col("maintenance_priority").alias("priority"),
        R.recommended_action(r).alias("recommended_action"),
        R.round2(F.lit(K.BASE_MAINTENANCE_COST) * (F.lit(1.0) + r * F.lit(2.0))).alias("estimated_cost"),
        F.col("predicted_failure_date").alias("suggested_date"),
        R.reasons(F.col("condition_risk"), F.col("anomaly_risk"), r).alias("reasoning"),
    )


def retrain_due(metadata: DataFrame, as_of, hours: int = K.RETRAIN_AFTER_HOURS) -> DataFrame:
    """Retrain when no model exists or the newest is older than
    ``hours``; ``metadata`` has one row per saved model (created_at)."""
    cutoff = F.timestamp_add("HOUR", F.lit(-hours), ts_lit(as_of))
    newest = metadata.agg(F.max("created_at").alias("newest_model"))
    return newest.select("newest_model",
                         (F.col("newest_model").isNull() | (F.col("newest_model") < cutoff)).alias("retrain"))
