"""Label batches (L1-L3): a manifest table instead of image files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetkit import constants as K
from fleetkit.functions import rules as R


def label_manifest(batch: DataFrame, output_dir: str = K.LABEL_DIR) -> DataFrame:
    """L1: per requested label: success with payload (= code) and file path,
    or failed with 'Missing tool_code' when the code is null or empty."""
    prefix = output_dir if output_dir.endswith("/") else output_dir + "/"
    code = F.col("tool_code")
    missing = code.isNull() | (code == "")
    return batch.select(
        "seq", "tool_code", "tool_name",
        F.when(missing, F.lit("failed")).otherwise(F.lit("success")).alias("outcome"),
        F.when(missing, F.lit(K.MISSING_CODE_ERROR)).alias("error"),
        F.when(~missing, code).alias("qr_data"),
        F.when(~missing, F.concat(F.lit(prefix), R.label_file_name(code))).alias("filepath"),
    )


def label_collisions(manifest: DataFrame) -> DataFrame:
    """L2: files written for more than one distinct code (later overwrites)."""
    ok = manifest.where(F.col("outcome") == "success")
    return (ok.groupBy("filepath")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("tool_code").alias("n_codes"),
                 F.min("tool_code").alias("first_code"), F.max("tool_code").alias("last_code"))
            .where(F.col("n_codes") > 1))


def label_summary(manifest: DataFrame) -> DataFrame:
    """L3: success / failed / total counts."""
    o = F.col("outcome")
    return manifest.agg(F.count_if(o == "success").alias("success"),
                        F.count_if(o == "failed").alias("failed"),
                        F.count(F.lit(1)).alias("total"))
