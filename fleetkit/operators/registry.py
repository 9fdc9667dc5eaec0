"""Model registry (J14, J16): several saved bundles, the newest complete one wins.

``<root>/models/<id>`` holds a bundle's parts (``forest.save``).  ``<root>/log`` is an append-only table with
one row per published model, written after all its parts: a bundle whose job was killed while it was
saved has no row and is never seen.  A model whose parts were removed later is passed over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit.functions.dates import ts_lit
from fleetkit.operators import forest

LOG = "model string, model_version string, rmse double, r2 double, created_at timestamp_ntz"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def publish(bundle: forest.Bundle | None, root: str) -> str | None:
    """Saves a bundle under an id of its own and enters it into the log; returns the id (None without a model)."""
    if bundle is None:
        return None
    spark = bundle.dictionary.sparkSession
    name = f"{bundle.created_at:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    forest.save(bundle, f"{root}/models/{name}")
    row = spark.createDataFrame([(name, bundle.version, bundle.metrics.get("rmse"), bundle.metrics.get("r2"))],
                                "model string, model_version string, rmse double, r2 double")
    row.select("*", ts_lit(bundle.created_at).alias("created_at")).write.mode("append").parquet(f"{root}/log")
    return name


def models(spark: SparkSession, root: str) -> DataFrame:
    """Published models whose parts all exist: model, model_version, rmse, r2, created_at (empty without a registry).

    One row per model; the log is small (one row per training), so its ids are looked up by the driver."""
    if not _exists(spark, f"{root}/log"):
        return spark.createDataFrame([], LOG)
    log = spark.read.schema(LOG).parquet(f"{root}/log")
    whole = [r.model for r in log.select("model").collect()
             if all(_exists(spark, f"{root}/models/{r.model}/{part}") for part in forest.PARTS)]
    return log.where(F.col("model").isin(whole))


def newest(spark: SparkSession, root: str) -> forest.Bundle | None:
    """The bundle created last (ties: the larger id), None without any."""
    row = models(spark, root).orderBy(F.desc("created_at"), F.desc("model")).first()
    return None if row is None else forest.load(spark, f"{root}/models/{row.model}")
