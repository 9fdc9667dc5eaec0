"""Fitted trees as a table: exported forests (J5, J12) and a walk in DataFrame operations.

One row per node: tree, node, feature (-1 in a leaf), threshold, left and right (nodes of the same tree),
value (a leaf's answer), rows and gain (of the fit).  The table is bounded by the model, not by the
data: trees x nodes of a tree.  The walk joins every input row with the trees, each a row of arrays that its
node numbers index, and moves the pair one level per projection, so Spark, or any SQL engine with the
table, repeats what the library's vectorised scorers answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit.operators import isolation
from fleetkit.session import shared_path

SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, value double, rows double, "
          "gain double")


def forest_nodes(spark: SparkSession, model: RandomForestRegressionModel) -> DataFrame:
    """Node table of an MLlib regression forest, read from its saved form; a row goes left when its feature is
    at most the threshold (features are continuous)."""
    path = shared_path(spark, "forest-nodes")
    model.write().save(path)
    n = F.col("nodeData")
    leaf = n["leftChild"] < 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.when(leaf, -1).otherwise(n["split"]["featureIndex"]).alias("feature"),
        F.when(~leaf, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["prediction"].alias("value"),
        n["impurityStats"][0].alias("rows"), F.when(~leaf, n["gain"]).alias("gain"))


def isolation_nodes(model: isolation.IsolationModel) -> DataFrame:
    """Node table of an isolation forest; a row goes left below the threshold, and a leaf's value is its path
    length: depth plus the mean path of the rows that it still holds."""
    n = F.col("size").cast("double")
    held = (F.when(n <= 1, 0.0).when(n == 2, 1.0)
            .otherwise(F.lit(2.0) * (F.log(n - 1) + F.lit(isolation.EULER)) - F.lit(2.0) * (n - 1) / n))
    leaf = F.col("feature") < 0
    return model.nodes.select(
        "tree", "node", "feature", F.when(~leaf, F.col("threshold")).alias("threshold"), "left", "right",
        (F.col("depth") + held).alias("value"), n.alias("rows"), F.lit(None).cast("double").alias("gain"))


def walk(data: DataFrame, nodes: DataFrame, key: str, features: Sequence[str], levels: int, inclusive: bool) -> DataFrame:
    """Mean leaf value over all trees per row: (key, value).

    ``key`` is unique in ``data``; the nodes of a tree are numbered from 0 (the root) without gaps; ``levels`` is the
    depth of the deepest tree or more (a leaf stays where it is); ``inclusive`` sends a feature equal to the
    threshold left.  No rows or no trees give no rows."""
    inner = F.col("feature") >= 0
    node = F.struct("node", F.when(inner, F.col("feature")).otherwise(0).alias("feature"), "threshold",
                    F.when(inner, F.col("left")).otherwise(F.col("node")).alias("left"),
                    F.when(inner, F.col("right")).otherwise(F.col("node")).alias("right"),
                    F.when(~inner, F.col("value")).alias("value"))
    cols = ["feature", "threshold", "left", "right", "value"]
    trees = nodes.groupBy("tree").agg(F.sort_array(F.collect_list(node)).alias("n"))
    model = trees.agg(F.collect_list(F.struct(*[F.col(f"n.{c}").alias(c) for c in cols])).alias("_trees"))  # one row
    x = F.array(*[F.col(c).cast("double") for c in features])
    at = (data.select(key, x.alias("_x")).join(model)
          .select(key, "_x", F.size("_trees").alias("_n"), F.explode("_trees").alias("_t"))
          .select(key, "_x", "_n", *[F.col(f"_t.{c}").alias(f"_{c}") for c in cols], F.lit(0).alias("_at")))
    here = lambda c: F.get(F.col(f"_{c}"), F.col("_at"))
    v = F.get(F.col("_x"), here("feature"))
    left = v <= here("threshold") if inclusive else v < here("threshold")
    for _ in range(levels):
        at = at.withColumn("_at", F.when(left, here("left")).otherwise(here("right")))
    # rows short of a leaf are dropped after the sum: a filter before it would be pushed below all levels
    return (at.select(key, "_n", here("value").alias("_v")).groupBy(key)
            .agg((F.sum("_v") / F.max("_n")).alias("value")).where("value IS NOT NULL"))


def importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """J12 from the nodes: a feature's gain weighted by the rows that reach the split, as a share of its tree,
    averaged over the trees that split at all; features never used have 0."""
    split = nodes.where("feature >= 0").select("tree", "feature", (F.col("gain") * F.col("rows")).alias("_g"))
    per_tree = split.groupBy("tree").agg(F.sum("_g").alias("_all"))
    share = (split.join(per_tree, "tree").groupBy("feature")
             .agg(F.sum(F.when(F.col("_all") != 0, F.col("_g") / F.col("_all")).otherwise(0.0)).alias("_s")))
    total = share.agg(F.sum("_s").alias("_total"))
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "_f int, name string")
    part = share.join(total).select(                                  # one row
        "feature", F.when(F.col("_total") != 0, F.col("_s") / F.col("_total")).otherwise(0.0).alias("_share"))
    return names.join(part, F.col("_f") == F.col("feature"), "left").select(
        F.col("name").alias("feature"), F.coalesce("_share", F.lit(0.0)).alias("importance"))


def metrics(scored: DataFrame) -> DataFrame:
    """J6 / E11 in one aggregate over (label, prediction): n, rmse and r2 (null without rows; r2 also without spread)."""
    err = F.col("label") - F.col("prediction")
    sse, n = F.sum(err * err), F.count(F.lit(1))
    sst = F.var_pop("label") * n
    return scored.agg(n.alias("n"), F.sqrt(sse / F.when(n > 0, n)).alias("rmse"),
                      (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"))
