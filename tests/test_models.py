"""Isolation forest properties and the model bundle round trip."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleet_rows import AS_OF, SF_SMALL
from fleetkit.operators import encode, forest, isolation, risk
from fleetkit.plans import catalog
from fleetkit.session import shared_path


def test_isolation_forest_flags_planted_outliers(spark):
    rng = np.random.default_rng(3)
    normal = rng.normal(0.0, 1.0, size=(2000, 3))
    rows = [(f"n{i}", *map(float, v)) for i, v in enumerate(normal)]
    rows += [(f"out{i}", 9.0 + i, -9.0, 9.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double")
    model = isolation.fit(df, "k", ["a", "b", "c"], n_trees=50, max_samples=256, seed=1)
    isolation.fit_offset(df, model, "k", 0.1)
    dec = {r.k: r.anomaly_score for r in isolation.decision(df, model, "k").collect()}
    assert all(dec[f"out{i}"] < 0 for i in range(5))
    neg = sum(v < 0 for v in dec.values()) / len(dec)
    assert 0.08 <= neg <= 0.12
    # every tree saw at most psi rows
    assert model.nodes.groupBy("tree").agg(F.max("size")).agg(F.max("max(size)")).first()[0] <= 256


def test_path_lengths_stable_under_repartition(spark):
    df = spark.createDataFrame([(f"k{i}", float(i % 17), float(i % 5)) for i in range(300)], "k string, a double, b double")
    model = isolation.fit(df, "k", ["a", "b"], n_trees=20, max_samples=64, seed=5)
    a = {r.k: r.mean_path for r in isolation.path_lengths(df, model, "k").collect()}
    model2 = isolation.fit(df.repartition(7), "k", ["a", "b"], n_trees=20, max_samples=64, seed=5)
    b = {r.k: r.mean_path for r in isolation.path_lengths(df.repartition(3), model2, "k").collect()}
    assert a == pytest.approx(b)


def test_train_score_save_load(spark):
    feats = catalog.features(spark, SF_SMALL)
    b = forest.train(feats, AS_OF, n_trees=10, depth=5, if_trees=20)
    assert b is not None and set(b.metrics) == {"rmse", "r2"}
    imp = forest.feature_importance(spark, b).collect()
    assert len(imp) == 17 and imp[0].importance >= imp[-1].importance
    p1 = {r.tool_code: r.confidence_score for r in forest.score(feats, b, AS_OF).collect()}
    path = shared_path(spark, "test-model")
    forest.save(b, path)
    loaded = forest.load(spark, path)
    p2 = {r.tool_code: r.confidence_score for r in forest.score(feats, loaded, AS_OF).collect()}
    assert p1.keys() == p2.keys() and all(abs(p1[k] - p2[k]) < 1e-9 for k in p1)
    assert forest.load(spark, shared_path(spark, "missing-model")) is None
    meta = forest.metadata_frame(spark, path)
    from fleetkit.operators.risk import retrain_due
    assert retrain_due(meta, AS_OF).first().retrain is False
    import datetime as dt
    assert retrain_due(meta, AS_OF + dt.timedelta(hours=25)).first().retrain is True


def test_too_little_data_trains_nothing(spark):
    feats = catalog.features(spark, SF_SMALL).limit(10)
    assert forest.train(feats, AS_OF) is None
    assert forest.score(feats, None, AS_OF).count() == 0


def test_target_leakage_and_exclusion(spark):
    feats = catalog.features(spark, SF_SMALL)
    leaky = forest.train(feats, AS_OF, n_trees=10, depth=5, if_trees=10)
    honest = forest.train(feats, AS_OF, n_trees=10, depth=5, if_trees=10, exclude=("condition_score",))
    assert leaky.metrics["r2"] > 0.9                      # the label is a function of a feature
    assert "condition_score" not in honest.features and len(honest.features) == 16
    assert honest.metrics["r2"] < leaky.metrics["r2"]


def test_exact_percentile_matches_numpy(spark):
    rng = np.random.default_rng(9)
    for n in (1, 2, 7, 1000, 20000):
        vals = rng.normal(size=n)
        df = spark.createDataFrame([(float(v),) for v in vals], "x double")
        for p in (0.0, 0.1, 0.5, 0.999, 1.0):
            assert isolation.exact_percentile(df, "x", p, accuracy=1000) == pytest.approx(
                float(np.percentile(vals, 100 * p)), abs=1e-12), (n, p)


def test_exact_percentile_with_heavy_ties(spark):
    vals = [1.0] * 3000 + [2.0] * 5 + [0.5] * 40
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for p in (0.0, 0.01, 0.013, 0.1, 0.5, 0.999, 1.0):
        assert isolation.exact_percentile(df, "x", p, accuracy=100) == pytest.approx(
            float(np.percentile(vals, 100 * p)), abs=1e-12), p


def test_exact_percentile_collects_no_more_than_its_bound(spark):
    rng = np.random.default_rng(3)
    mixed = np.concatenate([rng.normal(size=4000), np.full(3000, 0.25), np.full(2000, 0.5)])
    two = np.array([1.0] * 500 + [2.0] * 500)
    for vals in (mixed, two):
        df = spark.createDataFrame([(float(v),) for v in vals], "x double")
        for p in (0.0, 0.1, 0.5, 0.6, 1.0):
            assert isolation.exact_percentile(df, "x", p, accuracy=100, max_pairs=20) == pytest.approx(
                float(np.percentile(vals, 100 * p)), abs=1e-12), p


def test_without_a_model_every_result_is_empty(spark, tmp_path):
    feats = catalog.features(spark, SF_SMALL).limit(5)
    assert forest.rf_scores(feats, None).count() == forest.anomaly_scores(feats, None).count() == 0
    assert forest.feature_importance(spark, None).count() == forest.metrics_frame(spark, None).count() == 0
    forest.save(None, str(tmp_path / "none"))
    assert forest.load(spark, str(tmp_path / "none")) is None
    assert risk.retrain_due(forest.metadata_frame(spark, str(tmp_path / "none")), AS_OF).first().retrain


def test_retrain_keeps_the_codes(spark):
    feats = catalog.features(spark, SF_SMALL)
    old = forest.train(feats.where("status = 'available'"), AS_OF, n_trees=2, depth=2, if_trees=2)
    new = forest.train(feats, AS_OF, n_trees=2, depth=2, if_trees=2, dictionary=old.dictionary)
    assert sorted(map(tuple, new.dictionary.collect())) == sorted(map(tuple, old.dictionary.collect()))
    codes = {r.status: r.status_encoded for r in
             encode.encode(feats, new.dictionary).select("status", "status_encoded").distinct().collect()}
    assert codes == {"available": 0, "in_use": -1, "maintenance": -1}


def test_registry_newest_complete_model_wins(spark):
    import datetime as dt
    from dataclasses import replace

    from fleetkit.operators import registry
    root = shared_path(spark, "registry")
    assert registry.newest(spark, root) is None and risk.retrain_due(registry.models(spark, root), AS_OF).first().retrain
    b = forest.train(catalog.features(spark, SF_SMALL), AS_OF, n_trees=3, depth=3, if_trees=5)
    days = lambda n: AS_OF + dt.timedelta(days=n)
    registry.publish(replace(b, version="old", created_at=days(-9)), root)
    registry.publish(replace(b, version="good", created_at=days(-1)), root)
    registry.publish(replace(b, version="older", created_at=days(-5)), root)        # published late, made early
    broken = registry.publish(replace(b, version="broken", created_at=days(3)), root)
    fs, p = spark._jvm.org.apache.hadoop.fs, None
    p = fs.Path(f"{root}/models/{broken}/scaler")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    forest.save(replace(b, version="killed", created_at=days(9)), f"{root}/models/killed")      # never entered into the log
    assert registry.newest(spark, root).version == "good"
    meta = registry.models(spark, root)
    assert meta.count() == 3
    assert risk.retrain_due(meta, AS_OF).first().retrain is False
    assert risk.retrain_due(meta, days(1)).first().retrain is True
    assert registry.publish(None, root) is None


DESCENT = """
WITH RECURSIVE visit AS (
  SELECT k, x, tree, 0 AS node FROM data, (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT k, x, n.tree, CASE WHEN {left} THEN n."left" ELSE n."right" END
  FROM visit JOIN nodes n ON n.tree = visit.tree AND n.node = visit.node WHERE n.feature >= 0)
SELECT k, avg(n.value) AS value FROM visit JOIN nodes n ON n.tree = visit.tree AND n.node = visit.node AND n.feature < 0 GROUP BY k"""


def duck_walk(data, nodes, cols, inclusive):
    """The recursive descent in DuckDB over a node table."""
    import duckdb
    con = duckdb.connect()
    rows = data.select("tool_code", *cols).toPandas()
    frame = rows[["tool_code"]].rename(columns={"tool_code": "k"})
    frame["x"] = list(rows[list(cols)].to_numpy(dtype="float64"))
    con.register("data", frame)
    con.register("nodes", nodes.toPandas())
    v = "list_extract(x, n.feature + 1)"
    return dict(con.execute(DESCENT.format(left=f"{v} {'<=' if inclusive else '<'} n.threshold")).fetchall())


def test_node_tables_answer_like_the_models(spark):
    from fleetkit.operators import trees
    feats = catalog.features(spark, SF_SMALL)
    b = forest.train(feats, AS_OF, n_trees=8, depth=6, if_trees=12)
    data = forest.prepare(feats, b.dictionary, b.scaler, b.features)
    cols = [c + "_z" for c in b.features]
    grown, isolated = forest.forest_nodes(spark, b), forest.isolation_nodes(spark, b)
    pred = {r.tool_code: r.prediction for r in b.forest.transform(data).collect()}
    path = {r.tool_code: r.mean_path for r in isolation.path_lengths(data, b.iforest, "tool_code").collect()}
    assert duck_walk(data, grown, cols, True) == pytest.approx(pred, abs=1e-9)
    assert duck_walk(data, isolated, cols, False) == pytest.approx(path, abs=1e-9)
    walked = {r.tool_code: r for r in forest.walked(feats, b).collect()}
    assert {k: r.condition_pred for k, r in walked.items()} == pytest.approx(pred, abs=1e-9)
    c = isolation.avg_path(b.iforest.psi)
    assert {k: r.score_samples for k, r in walked.items()} == pytest.approx({k: -2 ** (-h / c) for k, h in path.items()}, abs=1e-9)
    lib = {r.feature: r.importance for r in forest.feature_importance(spark, b).collect()}
    assert {r.feature: r.importance for r in trees.importances(grown, b.features).collect()} == pytest.approx(lib, abs=1e-9)
    # more levels than the trees have change nothing; fewer leave rows short of a leaf, which then have no value
    deep = {r.tool_code: r.value for r in trees.walk(data, grown, "tool_code", cols, 9, True).collect()}
    assert deep == pytest.approx(pred, abs=1e-9)


def test_node_walk_ties_empty_inputs_and_single_leaves(spark):
    from fleetkit.operators import trees
    nodes = spark.createDataFrame([(0, 0, 0, 1.5, 1, 2, 9.0, 4.0, 0.5), (0, 1, -1, None, -1, -1, 10.0, 2.0, None),
                                   (0, 2, -1, None, -1, -1, 20.0, 2.0, None), (3, 0, -1, None, -1, -1, 1.0, 4.0, None)], trees.SCHEMA)
    data = spark.createDataFrame([("a", 1.0), ("b", 1.5), ("c", 2.0)], "k string, x double")
    walk = lambda inclusive: {r.k: r.value for r in trees.walk(data, nodes, "k", ["x"], 1, inclusive).collect()}
    assert walk(True) == {"a": 5.5, "b": 5.5, "c": 10.5} and walk(False) == {"a": 5.5, "b": 10.5, "c": 10.5}
    assert trees.walk(data.limit(0), nodes, "k", ["x"], 1, True).count() == 0
    assert trees.walk(data, nodes.limit(0), "k", ["x"], 1, True).count() == 0
    imp = {r.feature: r.importance for r in trees.importances(nodes, ["x", "unused"]).collect()}
    assert imp == {"x": 1.0, "unused": 0.0}
    assert {r.importance for r in trees.importances(nodes.where("tree = 3"), ["x", "unused"]).collect()} == {0.0}
    m = trees.metrics(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "label double, prediction double")).first()
    assert (m.n, m.rmse, m.r2) == (2, pytest.approx(0.5 ** 0.5), pytest.approx(0.5))
    none = trees.metrics(spark.createDataFrame([], "label double, prediction double")).first()
    flat = trees.metrics(spark.createDataFrame([(1.0, 2.0)], "label double, prediction double")).first()
    assert (none.n, none.rmse, none.r2) == (0, None, None) and flat.r2 is None
    assert forest.forest_nodes(spark, None).count() == forest.isolation_nodes(spark, None).count() == 0


def test_split_is_a_fifth_and_needs_no_session(spark):
    import hashlib
    keys = [f"T-{i}" for i in range(3000)]
    rows = spark.createDataFrame([(k,) for k in [*keys, None]], "tool_code string").select("tool_code", forest.is_test().alias("t")).collect()
    want = {k: int(hashlib.md5(f"42:{k or ''}".encode()).hexdigest()[:15], 16) % 10 < 2 for k in [*keys, None]}
    assert {r.tool_code: r.t for r in rows} == want
    assert 0.17 < sum(want.values()) / len(want) < 0.23


def test_trees_are_fitted_on_few_even_blocks(spark, monkeypatch):
    # MLlib's tasks each build the histograms of all nodes, so their number must not follow the shuffle's partitions;
    # dealt by status, nearly all partitions would be empty
    seen = []

    class Recorded(forest.Pipeline):
        def fit(self, data):
            seen.extend(r.n for r in data.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
            seen.append(data.rdd.getNumPartitions())
            return super().fit(data)

    rows = [(f"T-{i:04d}", 5.0 + i % 4, float(i % 7), ("on", "off")[i % 2], "c", "l", float(i % 11), float(i % 13)) for i in range(2000)]
    feats = spark.createDataFrame(rows, "tool_code string, condition_score double, usage_hours double, status string, "
                                        "category string, location string, days_since_purchase double, usage_count double")
    monkeypatch.setattr(forest, "Pipeline", Recorded)
    assert forest.train(feats.repartition(50, "tool_code"), AS_OF, n_trees=2, depth=2, if_trees=2) is not None
    *blocks, parts = seen
    assert parts == len(blocks) == 2 * spark.sparkContext.defaultParallelism
    assert max(blocks) < 3 * min(blocks)


def test_walk_joins_once_whatever_the_depth(spark):
    from fleetkit.operators import trees
    nodes = spark.createDataFrame([(0, 0, 0, 1.5, 1, 2, 9.0, 4.0, 0.5), (0, 1, -1, None, -1, -1, 10.0, 2.0, None),
                                   (0, 2, -1, None, -1, -1, 20.0, 2.0, None)], trees.SCHEMA)
    data = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), ("d", float("nan"))], "k string, x double")
    walked = trees.walk(data, nodes, "k", ["x"], 12, True)
    assert {r.k: r.value for r in walked.collect()} == {"a": 10.0, "b": 20.0, "c": 20.0, "d": 20.0}
    assert walked._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert trees.walk(data, nodes, "k", ["x"], 0, True).count() == 0                # short of a leaf: no value


def test_small_and_large_dictionaries_encode_alike(spark, monkeypatch):
    rows = [("a", "x", "s"), ("b", None, "s"), (None, "y", "t"), ("a", "z", "new")]
    df = spark.createDataFrame(rows, "category string, location string, status string")
    known = encode.fit_label_dictionary(df.where("status <> 'new'"))
    small = encode.encode(df, known)
    assert small._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 3
    monkeypatch.setattr(encode, "BROADCAST_BYTES", 0)
    large = encode.encode(df, known)
    assert "strategy=broadcast" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert {r.location: r.location_encoded for r in small.collect()} == {None: 0, "x": 1, "y": 2, "z": -1}


def test_nodes_are_walked_once_for_scores_and_for_metrics(spark):
    from fleetkit.plans import rows_only
    for query in (rows_only.q_scores_by_nodes, rows_only.q_metrics_by_rows):
        assert "explode" not in query(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()


FEATS = ("tool_code string, condition_score double, usage_hours double, status string, category string, location string, "
         "days_since_purchase double, usage_count double")


def test_too_few_tools_are_counted_without_their_statistics(spark):
    rows = [(f"T-{i}", 5.0, 1.0, "on", "c", "l", 1.0, 1.0) for i in range(10)]
    unread = F.raise_error(F.lit("a statistic was computed")).cast("double")
    feats = spark.createDataFrame(rows, FEATS).withColumn("usage_count", unread)
    assert forest.train(feats, AS_OF) is None


def test_the_hold_out_is_predicted_once_and_nothing_is_kept(spark, monkeypatch):
    kept = []

    class Judged(forest.RegressionEvaluator):
        def evaluate(self, data, params=None):
            kept.append(data.storageLevel.useMemory)
            return super().evaluate(data, params)

    monkeypatch.setattr(forest, "RegressionEvaluator", Judged)
    rows = [(f"K-{i:04d}", 5.0 + i % 4, float(i % 7), ("on", "off")[i % 2], "c", "l", float(i % 11), float(i % 13)) for i in range(300)]
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    before = held()
    b = forest.train(spark.createDataFrame(rows, FEATS), AS_OF, n_trees=2, depth=2, if_trees=2)
    assert kept == [True, True]             # both metrics
    b.iforest.nodes.unpersist(True)
    assert held() == before


MODEL_ROWS = [(f"K-{i:04d}", 5.0 + i % 4, float(i % 7), ("on", "off")[i % 2], "c", "l", float(i % 11), float(i % 13))
              for i in range(300)]


def test_the_matrix_is_sorted_before_it_is_kept(spark, monkeypatch):
    # the fit's passes over its data (sample, bins, one per level) filter what is kept; none encodes or sorts again
    seen = []

    class Recorded(forest.Pipeline):
        def fit(self, data):
            plan = data._jdf.queryExecution().optimizedPlan()
            while True:
                seen.append(plan.nodeName())
                if plan.children().isEmpty():
                    break
                plan = plan.children().head()
            seen.append(set(data.columns) & {"condition_score", "usage_count", "usage_hours"})
            return super().fit(data)

    monkeypatch.setattr(forest, "Pipeline", Recorded)
    assert forest.train(spark.createDataFrame(MODEL_ROWS, FEATS), AS_OF, n_trees=2, depth=2, if_trees=2) is not None
    *above, kept, unscaled = seen
    assert kept == "InMemoryRelation" and set(above) <= {"Filter", "Project"}
    assert unscaled == set()


def test_both_models_are_fitted_at_once(spark, monkeypatch):
    begun = threading.Event()

    class Waiting(forest.Pipeline):
        def fit(self, data):
            assert begun.wait(60), "the isolation forest waits for the other forest"
            return super().fit(data)

    fit = isolation.fit

    def fitted(*args, **kwargs):
        begun.set()
        return fit(*args, **kwargs)

    monkeypatch.setattr(forest, "Pipeline", Waiting)
    monkeypatch.setattr(isolation, "fit", fitted)
    b = forest.train(spark.createDataFrame(MODEL_ROWS, FEATS), AS_OF, n_trees=2, depth=2, if_trees=2)
    assert b.iforest.offset < 0


def test_a_failing_isolation_fit_fails_the_training(spark, monkeypatch):
    def fails(*args, **kwargs):
        raise ValueError("no isolation forest")
    monkeypatch.setattr(isolation, "fit_offset", fails)
    with pytest.raises(ValueError, match="no isolation forest"):
        forest.train(spark.createDataFrame(MODEL_ROWS, FEATS), AS_OF, n_trees=2, depth=2, if_trees=2)


def test_candidates_are_copied_for_their_trees_alone(spark):
    # 5,000 rows, 20 trees of 8: the copies that a tree draws, not a copy per tree of every candidate
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 97).cast("double").alias("x"))
    model = isolation.fit(df, "k", ["x"], n_trees=20, max_samples=8, seed=3)
    plan = model.nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(filter(" in plan
    assert model.nodes.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    p_any, p = 20 * 24 / 5000, 1 / 20
    drawn = (df.where(isolation._uniform(F.col("k"), F.lit(3), F.lit(-1)) < p_any)
             .select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("tree"))
             .where(isolation._uniform(F.col("k"), F.lit(3), F.col("tree")) < p)
             .groupBy("tree").agg(F.least(F.lit(8), F.count(F.lit(1))).cast("int").alias("size")))
    roots = model.nodes.where("node = 0").select("tree", "size")
    assert {tuple(r) for r in roots.collect()} == {tuple(r) for r in drawn.collect()}


def test_large_fits_get_whole_waves_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "FIT_BLOCK_ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    data = spark.range(100).select(F.col("id").cast("string").alias("tool_code"), F.lit(1.0).alias("label")).repartition(50)
    blocks = lambda n: forest.in_blocks(data, n).rdd.getNumPartitions()
    assert blocks(10 * 2 * cores) == 2 * cores
    assert blocks(10 * 2 * cores + 1) == 3 * cores


def test_importances_need_no_python_task(spark):
    b = forest.train(spark.createDataFrame(MODEL_ROWS, FEATS), AS_OF, n_trees=2, depth=2, if_trees=2)
    imp = forest.feature_importance(spark, b)
    assert "RDD" not in imp._jdf.queryExecution().optimizedPlan().toString()
    assert imp.dtypes == [("feature", "string"), ("importance", "double")]
    rows = [tuple(r) for r in imp.collect()]
    assert [f for f, _ in rows] == [f for f, _ in sorted(rows, key=lambda r: (-r[1], r[0]))] and len(rows) == len(b.features)


def test_isolation_leaves_are_their_own_children(spark):
    # tree 3 is a single leaf, tree 7 splits twice; the walk takes as many steps as a tree is deep
    nodes = spark.createDataFrame([(7, 0, 0, 1.5, 1, 2, 0, 5), (7, 1, -1, 0.0, -1, -1, 1, 1), (7, 2, 1, 0.5, 3, 4, 1, 4),
                                   (7, 3, -1, 0.0, -1, -1, 2, 1), (7, 4, -1, 0.0, -1, -1, 2, 3), (3, 0, -1, 0.0, -1, -1, 0, 2)],
                                  isolation.NODE_SCHEMA)
    model = isolation.IsolationModel(nodes=nodes, features=["x", "y"], psi=5)
    a = isolation._arrays(model)
    assert a["trees"] == [(0, 0), (1, 2)]
    assert a["child"].reshape(-1, 2).tolist() == [[0, 0], [3, 2], [2, 2], [5, 4], [4, 4], [5, 5]]      # right, left
    inf, nan = float("inf"), float("nan")
    data = spark.createDataFrame([("a", 1.0, 9.0), ("b", 1.5, 0.4), ("c", nan, 0.5), ("d", inf, nan), ("e", -inf, 0.0)],
                                 "k string, x double, y double")
    got = {r.k: r.mean_path for r in isolation.path_lengths(data, model, "k").collect()}
    deep = 2 + isolation.avg_path(3)
    assert got == {"a": 1.0, "b": 1.5, "c": (1 + deep) / 2, "d": (1 + deep) / 2, "e": 1.0}
