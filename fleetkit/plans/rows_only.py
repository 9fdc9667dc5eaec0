"""Registered queries over files, models and stateful streams; the file and
stream queries have a SQL oracle, the model queries none.  Each reads the given tables through the adapters; any
intermediate files go to the shared checkpoint folder
(``spark.checkpoint.dir``), in a fresh sub-folder per run."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit import constants as K
from fleetkit import schemas
from fleetkit.functions.dates import ts_lit
from fleetkit.operators import forest, isolation, ledger, trees
from fleetkit.plans import catalog
from fleetkit.plans.adapters_sql import with_adapters
from fleetkit.session import shared_path
from fleetkit.sources import files
from fleetkit.sources.testdata import load, shape_tool_events, shape_usage, tools
from fleetkit.streaming import streams

AS_OF = K.AS_OF
Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}
_BUNDLES: dict[tuple[str, str], forest.Bundle | None] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[key] = fn
        if sql is not None:
            ORACLES[key] = with_adapters(sql)
        return fn
    return deco


# ------------------------------------------------------------ files
#: A file keeps no empty cells: they come back as null.
FILED_INTAKE_SQL = """
filed AS (SELECT seq, nullif(tool_code, '') AS tool_code, nullif(tool_name, '') AS tool_name,
                 nullif(category, '') AS category, nullif(location, '') AS location, purchase_date, condition_score
          FROM intake)"""


@register("intake_csv", f"""{FILED_INTAKE_SQL}, {catalog.INTAKE_CLS.replace("FROM intake", "FROM filed")}
SELECT *, CASE WHEN reject_reason IS NULL THEN 'added' ELSE 'error' END AS outcome FROM cls""")
def q_intake_csv(spark, sf):
    """A8 export of the intake batch to CSV, A6 typed read-back (PERMISSIVE),
    then B1/B2 classification of the rows read from the file."""
    f = load(spark, sf)
    path = shared_path(spark, "intake-csv")
    # the arrival order travels with the rows (file splits are not read in order)
    files.export_csv(f.intake.select(*[c.name for c in schemas.INTAKE.fields]), path)
    back = files.read_intake_csv(spark, path, schemas.INTAKE)
    return ledger.classify_intake(back.drop(files.CORRUPT), f.tools)


BROKEN = "CASE WHEN seq % 23 = 0 THEN 'too_many_fields' WHEN seq % 23 = 1 THEN 'too_few_fields' " \
         "WHEN seq % 23 = 2 THEN 'bad_value:purchase_date,condition_score' END"


@register("intake_csv_rejects", f"""{FILED_INTAKE_SQL},
sound AS (SELECT * FROM filed WHERE {BROKEN} IS NULL), {catalog.INTAKE_CLS.replace("FROM intake", "FROM sound")}
SELECT seq, reject_reason FROM cls WHERE reject_reason IS NOT NULL
UNION ALL SELECT seq, 'malformed ' || {BROKEN} FROM filed WHERE {BROKEN} IS NOT NULL""")
def q_intake_csv_rejects(spark, sf):
    """A6 with a reject channel: every 23rd line of the batch's file has a surplus field, the next lacks its last
    ones, the third has a date and a number that do not parse; all are errors next to the rejects of B1/B2."""
    f = load(spark, sf)
    path, cols = shared_path(spark, "intake-broken"), [c.name for c in schemas.INTAKE.fields]
    line, k = F.to_csv(F.struct(*cols)), F.col("seq") % 23
    short = F.to_csv(F.struct(*cols[:4]))
    wrong = F.to_csv(F.struct(*cols[:5], F.lit("soon").alias("purchase_date"), F.lit("good").alias("condition_score")))
    files.write_lines(f.intake.select(F.when(k == 0, F.concat(line, F.lit(",surplus"))).when(k == 1, short)
                                      .when(k == 2, wrong).otherwise(line).alias("value")), path)
    back = files.with_malformed(files.read_intake_csv(spark, path, schemas.INTAKE, header=False), schemas.INTAKE)
    return (ledger.classify_intake(back, f.tools).where(F.col("reject_reason").isNotNull())
            .select("seq", "reject_reason"))


@register("export_csv", f"""
SELECT 'tools' AS export, {catalog.TOOL_OUT_SQL} FROM tools
UNION ALL BY NAME
SELECT 'usage' AS export, {catalog.USAGE_OUT} FROM usage_history""")
def q_export_csv(spark, sf):
    """Tools and usage exported as header CSV and read back typed."""
    f = load(spark, sf)
    folder = shared_path(spark, "exports")
    t = catalog.tool_out(f.tools)
    tp = files.export_dated(t, folder, "tools", AS_OF)
    up = files.export_dated(f.usage, folder, "usage", AS_OF)
    tb = files.read_export_csv(spark, tp, t.schema).select(F.lit("tools").alias("export"), "*")
    ub = files.read_export_csv(spark, up, f.usage.schema).select(F.lit("usage").alias("export"), "*")
    return tb.unionByName(ub, allowMissingColumns=True)


@register("predictions_append", f"""{catalog.PRED_SQL}
SELECT {catalog.PRED_OUT_SQL} FROM (SELECT * FROM predictions UNION ALL SELECT * FROM predictions)""")
def q_predictions_append(spark, sf):
    """B6 append (twice: no de-duplication) then A4 read-back order."""
    path = shared_path(spark, "predictions")
    pred = catalog.predictions(spark, sf)
    files.append_predictions(pred, path)
    files.append_predictions(pred, path)
    return catalog.pred_out(catalog.A.predictions_scan(files.read_predictions(spark, path)))


# ------------------------------------------------------------ models
def bundle(spark: SparkSession, sf: str) -> forest.Bundle | None:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUNDLES:
        _BUNDLES[key] = forest.train(catalog.features(spark, sf), AS_OF)
    return _BUNDLES[key]


@register("model_metrics")
def q_model_metrics(spark, sf):
    return forest.metrics_frame(spark, bundle(spark, sf))


@register("rf_scores")
def q_rf_scores(spark, sf):
    return forest.rf_scores(catalog.features(spark, sf), bundle(spark, sf))


@register("anomaly_scores")
def q_anomaly_scores(spark, sf):
    return forest.anomaly_scores(catalog.features(spark, sf), bundle(spark, sf))


@register("risk_ml")
def q_risk_ml(spark, sf):
    return forest.score(catalog.features(spark, sf), bundle(spark, sf), AS_OF).orderBy(
        F.col("confidence_score").desc(), "tool_code")


@register("feature_importance")
def q_feature_importance(spark, sf):
    return forest.feature_importance(spark, bundle(spark, sf))


@register("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """Save the bundle, load it back (all parts required), score with it."""
    path = shared_path(spark, "model")
    forest.save(bundle(spark, sf), path)
    return forest.score(catalog.features(spark, sf), forest.load(spark, path), AS_OF)


#: The hold-out of J4 in DuckDB.
HELD_OUT = (f"(('0x' || substr(md5('{K.SPLIT_SEED}:' || coalesce(tool_code, '')), 1, 15))::BIGINT % 10 "
            f"< {K.TEST_FRACTION_TENTHS})")


def near(a: str, b: str):
    return (F.abs(F.col(a) - F.col(b)) < 1e-9) | (F.col(a).isNull() & F.col(b).isNull())


@register("split_rows", f"SELECT tool_code, {HELD_OUT} AS held_out, 10.0::DOUBLE - condition_score AS label FROM tools")
def q_split_rows(spark, sf):
    """Which tools are held out, and the label of J5."""
    return catalog.features(spark, sf).select("tool_code", forest.is_test().alias("held_out"),
                                              (F.lit(10.0) - F.col("condition_score")).alias("label"))


@register("forest_nodes")
def q_forest_nodes(spark, sf):
    """The condition model as a node table."""
    return forest.forest_nodes(spark, bundle(spark, sf))


@register("isolation_nodes")
def q_isolation_nodes(spark, sf):
    """The anomaly model as a node table."""
    return forest.isolation_nodes(spark, bundle(spark, sf))


@register("scores_by_nodes", "SELECT tool_code, true AS same_prediction, true AS same_anomaly FROM tools")
def q_scores_by_nodes(spark, sf):
    """Every tool scored by joins over the node tables against the library's scorers; the offset of J7 is
    taken anew from the walked scores."""
    feats, b = catalog.features(spark, sf), bundle(spark, sf)
    data = forest.prepare(feats, b.dictionary, b.scaler, b.features)
    pred = b.forest.transform(data).select("tool_code", "prediction")
    flags = forest.anomaly_scores(feats, b).select("tool_code", "anomaly_score")
    walked = forest.walked(feats, b).checkpoint()                    # read for the offset and for the scores
    offset = isolation.exact_percentile(walked, "score_samples", K.IF_CONTAMINATION)
    mine = walked.select("tool_code", "condition_pred", (F.col("score_samples") - F.lit(offset)).alias("decision"))
    return mine.join(pred, "tool_code", "full").join(flags, "tool_code", "full").select(
        "tool_code", near("condition_pred", "prediction").alias("same_prediction"),
        near("decision", "anomaly_score").alias("same_anomaly"))


@register("importance_by_nodes", f"""
SELECT feature, true AS same, (SELECT count(*) FROM tools WHERE NOT {HELD_OUT}) AS train_rows
FROM (VALUES {", ".join(f"('{c}')" for c in K.FEATURE_COLUMNS)}) AS t(feature)""")
def q_importance_by_nodes(spark, sf):
    """Gains summed from the node table against the library's importances, beside the rows that were fitted."""
    b = bundle(spark, sf)
    mine = trees.importances(forest.forest_nodes(spark, b), b.features)
    lib = forest.feature_importance(spark, b).withColumnRenamed("importance", "lib")
    rows = catalog.features(spark, sf).where(~forest.is_test()).agg(F.count(F.lit(1)).alias("train_rows"))
    return (mine.join(lib, "feature", "full").join(rows)                             # one row
            .select("feature", near("importance", "lib").alias("same"), "train_rows"))


@register("metrics_by_rows", f"""
SELECT count(*) AS n, true AS same_rmse, true AS same_r2, round(avg(10.0::DOUBLE - condition_score), 6) AS mean_label
FROM tools WHERE {HELD_OUT}""")
def q_metrics_by_rows(spark, sf):
    """The hold-out's metrics summed over its predictions, these walked through the node table, against
    the evaluator's."""
    feats, b = catalog.features(spark, sf), bundle(spark, sf)
    scored = (forest.walked(feats.where(forest.is_test()), b).join(feats.select("tool_code", "condition_score"), "tool_code")
              .select((F.lit(10.0) - F.col("condition_score")).alias("label"), F.col("condition_pred").alias("prediction"))
              .checkpoint())                                         # read for the metrics and for the mean
    lib = forest.metrics_frame(spark, b).select(F.col("rmse").alias("lib_rmse"), F.col("r2").alias("lib_r2"))
    mean = scored.agg(catalog.r6(F.avg("label")).alias("mean_label"))
    both = trees.metrics(scored).join(lib).join(mean)                               # one row each
    return both.select("n", near("rmse", "lib_rmse").alias("same_rmse"), near("r2", "lib_r2").alias("same_r2"), "mean_label")


@register("predictions_by_model", f"""
SELECT 'none saved' AS model, 0::BIGINT AS predictions
UNION ALL SELECT 'too few rows', 0 UNION ALL SELECT 'saved', count(*) FROM tools""")
def q_predictions_by_model(spark, sf):
    """Predictions stay empty until a model is in the registry; too few tools train none."""
    from fleetkit.operators import registry
    feats, root = catalog.features(spark, sf), shared_path(spark, "by-model")
    few = feats.join(feats.select("tool_code").orderBy("tool_code").limit(K.MIN_TRAIN_ROWS), "tool_code")

    def counted(name, model):
        return forest.score(feats, model, AS_OF).agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("predictions"))
    out = [counted("none saved", registry.newest(spark, root))]
    registry.publish(forest.train(few, AS_OF), root)
    out.append(counted("too few rows", registry.newest(spark, root)))
    registry.publish(bundle(spark, sf), root)
    out.append(counted("saved", registry.newest(spark, root)))
    return functools.reduce(DataFrame.unionByName, out)


# ------------------------------------------------------------ streams (M1, M2)
@register("stream_ledger", catalog.USAGE_APPLY_SQL)
def q_stream_ledger(spark, sf):
    """M1: lineitem file stream -> usage rows -> foreachBatch per-tool
    deltas; returns the tools snapshot with all deltas applied."""
    root = shared_path(spark, "ledger")
    usage = shape_usage(streams.table_stream(spark, sf, "lineitem"))
    streams.ledger_stream(spark, usage, f"{root}/deltas", f"{root}/_checkpoint")
    return (streams.ledger_snapshot(spark, tools(spark, sf), f"{root}/deltas", AS_OF)
            .select("tool_code", catalog.r6("usage_hours").alias("usage_hours"), "updated_at"))


@register("stream_sessions", catalog.SESSIONS_SQL)
def q_stream_sessions(spark, sf):
    """M2: event file stream -> check-out/check-in pairing across micro-batches."""
    root = shared_path(spark, "sessions")
    ev = shape_tool_events(streams.table_stream(spark, sf, "events"))
    streams.session_batches(ev, root, f"{root}/_checkpoint")
    return streams.sessions_now(spark, root).withColumn("duration_hours", catalog.r6("duration_hours"))


#: Times of the published models: the newest moment of each history.
MODEL_TIMES_SQL = """
published AS (SELECT max(ts) AS created_at FROM tool_events UNION ALL SELECT max(checkout_time) FROM usage_history
              UNION ALL SELECT max(checkout_time) FROM recent_usage)"""


@register("retrain_due", f"""{MODEL_TIMES_SQL},
newest AS (SELECT max(created_at) AS newest_model FROM published)
SELECT newest_model + to_hours(h) AS as_of, newest_model, h > {K.RETRAIN_AFTER_HOURS} AS retrain
FROM newest, (VALUES (0), (24), (25), (72)) AS t(h)
UNION ALL SELECT {catalog.ASOF_TS}, newest_model, newest_model < {catalog.ASOF_TS} - INTERVAL {K.RETRAIN_AFTER_HOURS} HOUR FROM newest""")
def q_retrain_due(spark, sf):
    """A model is published per history table, stamped with that table's newest moment; the newest one in the
    registry decides whether to retrain, asked at four instants after it and at the tables' as-of time."""
    from fleetkit.operators import registry
    from fleetkit.operators.risk import retrain_due
    f, root = load(spark, sf), shared_path(spark, "models")
    stamps = [df.agg(F.max(c)).first()[0] for df, c in (
        (f.tool_events, "ts"), (f.usage, "checkout_time"), (f.recent_usage, "checkout_time"))]
    for stamp in stamps:
        registry.publish(replace(bundle(spark, sf), created_at=stamp), root)
    meta = registry.models(spark, root)
    asked = [max(stamps) + dt.timedelta(hours=h) for h in (0, 24, 25, 72)] + [AS_OF]
    rows = [retrain_due(meta, t).select(ts_lit(t).alias("as_of"), "newest_model", "retrain") for t in asked]
    return functools.reduce(DataFrame.unionByName, rows)


@register("model_reload_same", "SELECT tool_code, true AS same FROM tools")
def q_model_reload_same(spark, sf):
    """Every tool scored before saving and after loading the bundle."""
    path = shared_path(spark, "model-same")
    b, feats = bundle(spark, sf), catalog.features(spark, sf)
    forest.save(b, path)
    score = lambda m, name: forest.score(feats, m, AS_OF).select(
        "tool_code", F.col("confidence_score").alias(name))
    both = score(b, "before").join(score(forest.load(spark, path), "after"), "tool_code", "full")
    return both.select("tool_code", F.col("before").eqNullSafe(F.col("after")).alias("same"))
