"""Model training and scoring pipeline (J4-J6, J9 on models, J11, J12, J15, J16).

features (J1) -> label dictionary (J2) -> population scaling (J3)
-> hash split 80/20 (J4) -> MLlib RandomForestRegressor of 10 - condition
(J5) -> RMSE / R^2 on the hold-out (J6) -> isolation forest on all rows (J7)
-> fused predictions (J9).  Training runs only with more than 10 rows and at
least 5 features.  The bundle (forest, isolation nodes, dictionary, scaler,
metadata) is saved with MLlib writers and Parquet and loads only when every
part exists.
"""

from __future__ import annotations

import datetime as _dt
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetkit import constants as K
from fleetkit.functions.dates import ts_lit
from fleetkit.operators import encode, isolation, trees
from fleetkit.operators.risk import fuse

KEY = "tool_code"
#: Rows of a task's share in a tree fit (MLlib keeps about 1 KB a row at 100 trees).
FIT_BLOCK_ROWS = 250_000


@dataclass
class Bundle:
    forest: PipelineModel
    iforest: isolation.IsolationModel
    dictionary: DataFrame
    scaler: dict[str, tuple[float, float]]
    features: list[str]
    version: str
    created_at: _dt.datetime
    metrics: dict[str, float]


def is_test(key_col: str = KEY, seed: int = K.SPLIT_SEED):
    """Deterministic 20 % hold-out by key hash (stable under repartitioning; md5, so that any engine can repeat
    it; a null key counts as an empty one)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key_col).cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return F.pmod(drawn, F.lit(10)) < K.TEST_FRACTION_TENTHS


def prepare(features: DataFrame, dictionary: DataFrame, scaler: dict, cols: list[str]) -> DataFrame:
    enc = encode.encode(features, dictionary)
    scaled = encode.scale(enc.select(KEY, *dict.fromkeys(["condition_score", *cols])), scaler, suffix="_z")
    return scaled.withColumn("label", F.lit(10.0) - F.col("condition_score"))


def in_blocks(data: DataFrame, n: int) -> DataFrame:
    """Few large partitions for a tree fit over ``n`` rows: two per core, another one per core only above
    ``FIT_BLOCK_ROWS`` rows each.

    In every pass each MLlib task builds, writes and merges the histograms of all nodes being split, however few rows
    it has; small partitions multiply that work.  No shuffle: neighbouring partitions are read together, and
    fewer partitions than that stay as they are.  Rows of like labels, which end in the same nodes, stand together, so
    a task works on few histograms at a time.  The matrix is kept in this form: every pass finds it sorted."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    waves = max(2, math.ceil(n / (FIT_BLOCK_ROWS * cores)))        # whole ones, or cores would wait for the last
    return data.coalesce(cores * waves).sortWithinPartitions("label", KEY)


def train(features: DataFrame, as_of, n_trees: int = K.RF_TREES, depth: int = K.RF_DEPTH,
          if_trees: int = K.IF_TREES, seed: int = K.SPLIT_SEED,
          exclude: tuple[str, ...] = (), dictionary: DataFrame | None = None) -> Bundle | None:
    """J15 retrain flow; returns None when there is not enough data.

    A retrain passes the last bundle's ``dictionary``: its codes keep their
    meaning and labels new since then are -1; without it one is fitted.

    The label is 10 - condition_score while condition_score is also the first
    feature (target leakage, kept for parity); ``exclude`` drops feature
    columns, e.g. ``("condition_score",)`` for an honest hold-out score."""
    from fleetkit.session import ensure_checkpoint_dir
    spark = features.sparkSession
    ensure_checkpoint_dir(spark)
    cols = [c for c in K.FEATURE_COLUMNS
            if (c in features.columns or c.endswith("_encoded")) and c not in exclude]
    n = features.count()                 # of the tools alone: a count needs none of their statistics
    if n <= K.MIN_TRAIN_ROWS or len(cols) < K.MIN_FEATURES:
        return None
    read = [c for c in cols if c in features.columns]
    # encoded, scaled and assembled from one pass
    features = features.select(*dict.fromkeys([KEY, "condition_score", *K.CATEGORICAL_COLUMNS, *read])).persist()
    if dictionary is None:
        dictionary = encode.fit_label_dictionary(features)
    enc = encode.encode(features, dictionary)
    scaler = encode.fit_scaler(enc, cols)
    zcols = [c + "_z" for c in cols]
    matrix = prepare(features, dictionary, scaler, cols).select(KEY, "label", *zcols, is_test().alias("held_out"))
    data = in_blocks(matrix, n).cache()
    data.count()                         # both models read the matrix alone
    features.unpersist()

    def isolate() -> isolation.IsolationModel:
        iso = isolation.fit(data, KEY, zcols, n_trees=if_trees, max_samples=K.IF_MAX_SAMPLES, seed=seed)
        iso.nodes = iso.nodes.cache()
        return isolation.fit_offset(data, iso, KEY, K.IF_CONTAMINATION)

    # the models know nothing of each other: the cores that one leaves idle between its passes work for the other
    with ThreadPoolExecutor(1) as beside:
        anomalies = beside.submit(inheritable_thread_target(spark)(isolate))
        rf = Pipeline(stages=[
            VectorAssembler(inputCols=zcols, outputCol="features"),
            # node-id caching (checkpointed every 10 iterations into the shared
            # folder) is MLlib's recommended setting for deep trees
            RandomForestRegressor(numTrees=n_trees, maxDepth=depth, featureSubsetStrategy="all",
                                  subsamplingRate=1.0, seed=seed, labelCol="label",
                                  cacheNodeIds=True, checkpointInterval=10),
        ]).fit(data.where(~F.col("held_out")))
        scored = rf.transform(data.where("held_out")).select("label", "prediction").persist()    # predicted once for both
        ev = RegressionEvaluator(labelCol="label", predictionCol="prediction")
        metrics = {"rmse": ev.setMetricName("rmse").evaluate(scored),
                   "r2": ev.setMetricName("r2").evaluate(scored)}
        scored.unpersist()
        iso = anomalies.result()
    data.unpersist()                     # the training matrix is not part of the bundle
    return Bundle(forest=rf, iforest=iso, dictionary=dictionary, scaler=scaler, features=cols,
                  version=K.MODEL_VERSION, created_at=as_of, metrics=metrics)


def metrics_frame(spark: SparkSession, bundle: Bundle | None) -> DataFrame:
    """E11 / J6 as a one-row table (empty when no model was trained)."""
    schema = "rmse double, r2 double"
    if bundle is None:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(bundle.metrics["rmse"], bundle.metrics["r2"])], schema)


def feature_importance(spark: SparkSession, bundle: Bundle | None) -> DataFrame:
    """Feature name -> importance, most important first (empty when no
    model was trained)."""
    if bundle is None:
        return spark.createDataFrame([], "feature string, importance double")
    imp = bundle.forest.stages[-1].featureImportances.toArray().tolist()
    # by Arrow: a few rows need no Python task
    rows = pa.table({"feature": bundle.features, "importance": [float(v) for v in imp]})
    return spark.createDataFrame(rows).orderBy(F.col("importance").desc(), "feature")


def forest_nodes(spark: SparkSession, bundle: Bundle | None) -> DataFrame:
    """The condition model as a node table (see ``trees``; empty when no model was trained)."""
    if bundle is None:
        return spark.createDataFrame([], trees.SCHEMA)
    return trees.forest_nodes(spark, bundle.forest.stages[-1])


def isolation_nodes(spark: SparkSession, bundle: Bundle | None) -> DataFrame:
    """The anomaly model as a node table (empty when no model was trained)."""
    if bundle is None:
        return spark.createDataFrame([], trees.SCHEMA)
    return trees.isolation_nodes(bundle.iforest)


def walked(features: DataFrame, bundle: Bundle | None) -> DataFrame:
    """Both models by their node tables alone: tool_code, condition_pred, score_samples (empty when no model was
    trained); the tools' codes are unique."""
    spark = features.sparkSession
    if bundle is None:
        return spark.createDataFrame([], "tool_code string, condition_pred double, score_samples double")
    data = prepare(features, bundle.dictionary, bundle.scaler, bundle.features)
    cols = [c + "_z" for c in bundle.features]
    deepest = bundle.iforest.nodes.agg(F.max("depth")).first()[0]
    pred = trees.walk(data, forest_nodes(spark, bundle), KEY, cols, bundle.forest.stages[-1].getMaxDepth(), inclusive=True)
    path = trees.walk(data, isolation_nodes(spark, bundle), KEY, cols, deepest, inclusive=False)
    c = isolation.avg_path(bundle.iforest.psi)
    return pred.withColumnRenamed("value", "condition_pred").join(
        path.select(KEY, (-F.pow(F.lit(2.0), -F.col("value") / F.lit(c))).alias("score_samples")), KEY)


def score(features: DataFrame, bundle: Bundle | None, as_of) -> DataFrame:
    """J9 + J11: predictions for every tool; empty when no model exists."""
    spark = features.sparkSession
    if bundle is None:
        from fleetkit.schemas import PREDICTIONS
        return spark.createDataFrame([], PREDICTIONS)
    data = prepare(features, bundle.dictionary, bundle.scaler, bundle.features)
    pred = bundle.forest.transform(data).withColumnRenamed("prediction", "condition_pred")
    both = isolation.decision(pred, bundle.iforest, KEY, carry=["condition_pred"])     # one pass, no join
    return fuse(both, as_of, bundle.version)


def anomaly_scores(features: DataFrame, bundle: Bundle | None) -> DataFrame:
    """Decision value and flag per tool (empty when no model was trained)."""
    if bundle is None:
        return features.sparkSession.createDataFrame([], "tool_code string, anomaly_score double, anomalous boolean")
    data = prepare(features, bundle.dictionary, bundle.scaler, bundle.features)
    return isolation.decision(data, bundle.iforest, KEY).withColumn("anomalous", F.col("anomaly_score") < 0)


def rf_scores(features: DataFrame, bundle: Bundle | None) -> DataFrame:
    """Hold-out predictions of the condition model (empty when no model was trained)."""
    if bundle is None:
        return features.sparkSession.createDataFrame([], "tool_code string, label double, prediction double")
    data = prepare(features, bundle.dictionary, bundle.scaler, bundle.features)
    return bundle.forest.transform(data.where(is_test())).select(KEY, "label", "prediction")


# ------------------------------------------------------------------ J16
PARTS = ("forest", "iforest_nodes", "dictionary", "scaler", "metadata")


def save(bundle: Bundle | None, path: str) -> None:
    """Writes all parts; without a model nothing is written."""
    if bundle is None:
        return
    spark = bundle.dictionary.sparkSession
    bundle.forest.write().overwrite().save(f"{path}/forest")
    bundle.iforest.nodes.write.mode("overwrite").parquet(f"{path}/iforest_nodes")
    bundle.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
    spark.createDataFrame([(c, m, s) for c, (m, s) in bundle.scaler.items()],
                          "feature string, mean double, sigma double").write.mode("overwrite").parquet(f"{path}/scaler")
    meta = spark.createDataFrame(
        [(bundle.version, bundle.features, bundle.iforest.psi, bundle.iforest.offset,
          bundle.metrics.get("rmse"), bundle.metrics.get("r2"))],
        "model_version string, feature_columns array<string>, psi int, offset double, rmse double, r2 double")
    meta.select("*", ts_lit(bundle.created_at).alias("created_at")).write.mode("overwrite").parquet(f"{path}/metadata")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str) -> Bundle | None:
    """A bundle only when all parts exist, else None."""
    if not all(_exists(spark, f"{path}/{p}") for p in PARTS):
        return None
    meta = spark.read.parquet(f"{path}/metadata").first()
    scaler = {r["feature"]: (r["mean"], r["sigma"]) for r in spark.read.parquet(f"{path}/scaler").collect()}
    iso = isolation.IsolationModel(nodes=spark.read.parquet(f"{path}/iforest_nodes"),
                                   features=[c + "_z" for c in meta["feature_columns"]],
                                   psi=meta["psi"], offset=meta["offset"])
    return Bundle(forest=PipelineModel.load(f"{path}/forest"), iforest=iso,
                  dictionary=spark.read.parquet(f"{path}/dictionary"), scaler=scaler,
                  features=list(meta["feature_columns"]), version=meta["model_version"],
                  created_at=meta["created_at"], metrics={"rmse": meta["rmse"], "r2": meta["r2"]})


def metadata_frame(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/metadata"):
        return spark.createDataFrame([], T.StructType([T.StructField("created_at", T.TimestampNTZType())]))
    return spark.read.parquet(f"{path}/metadata")
