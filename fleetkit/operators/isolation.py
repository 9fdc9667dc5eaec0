"""Isolation forest (J7) on Spark — Liu, Ting & Zhou, "Isolation Forest",
ICDM 2008.  MLlib has no isolation forest.

Fit
  Each tree is grown from at most ``max_samples`` rows (psi).  The rows of a
  tree are chosen by hashing ``(key, seed, tree)``: a first hash filter keeps
  a candidate set whose expected size is independent of the table size, the
  candidates are replicated per tree and filtered again, and each tree's
  group (expected 3 * psi rows) keeps its psi smallest hash values — so every
  group handed to ``applyInPandas`` is small no matter how large the table,
  and the sample is deterministic under repartitioning.  One tree per group:
  random feature, random split between the node's min and max, height limit
  ceil(log2 psi).  The result is a node table (at most 2 psi - 1 rows per
  tree).

Score
  The node table is bounded (trees x (2 psi - 1) rows) and is broadcast as
  numpy arrays; ``mapInPandas`` walks all rows of an Arrow batch through the
  trees at once (vectorised).  Score s = 2^(-E[h] / c(psi)); the decision
  value is -s - offset, where offset is the ``contamination`` quantile of
  the training values (negative = anomalous), as in the common library
  convention.  The quantile is exact (numpy-style interpolation), found
  from a ``percentile_approx`` bracket plus one pass that collects only the
  values inside the bracket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EULER = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("depth", T.IntegerType()), T.StructField("size", T.IntegerType()),
])


def avg_path(n: float) -> float:
    """c(n): average path length of an unsuccessful BST search."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _uniform(*cols) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(2 ** 31)).cast("double") / F.lit(float(2 ** 31))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Grow one isolation tree on matrix x; returns node tuples."""
    nodes: list[list] = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth, int(idx.size)])
        if depth >= limit or idx.size <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        q = int(rng.choice(usable))
        p = float(rng.uniform(lo[q], hi[q]))
        go_left = sub[:, q] < p
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        nodes[me][0:4] = [q, p, left, right]
        return me

    build(np.arange(x.shape[0]), 0)
    return [tuple(n) for n in nodes]


@dataclass
class IsolationModel:
    nodes: DataFrame          # NODE_SCHEMA
    features: list[str]
    psi: int
    offset: float = 0.0


def fit(df: DataFrame, key: str, features: Sequence[str], n_trees: int = 100, max_samples: int = 256,
        seed: int = 42) -> IsolationModel:
    from fleetkit.session import ship_package
    ship_package(df.sparkSession)
    features = list(features)
    n = df.count()
    psi = int(min(max_samples, n))
    p_tree = min(1.0, 3.0 * psi / max(n, 1))
    p_any = min(1.0, n_trees * p_tree)
    limit = int(math.ceil(math.log2(max(psi, 2))))
    cand = df.select(key, *features).where(_uniform(F.col(key), F.lit(seed), F.lit(-1)) < F.lit(p_any))
    drawn = lambda t: _uniform(F.col(key), F.lit(seed), t)
    # a candidate is copied only for the trees that draw it, and a task grows several trees
    chosen = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: drawn(t) < F.lit(min(1.0, p_tree / p_any)))
    per_tree = (cand.select("*", F.explode(chosen).alias("tree")).withColumn("_u", drawn(F.col("tree")))
                .repartition(min(n_trees, 2 * df.sparkSession.sparkContext.defaultParallelism), "tree"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["_u", key], kind="mergesort").head(psi)   # at most psi rows per tree
        x = pdf[features].to_numpy(dtype="float64")
        rng = np.random.default_rng(seed * 100_003 + t)
        rows = _grow(x, rng, limit)
        out = pd.DataFrame(rows, columns=["feature", "threshold", "left", "right", "depth", "size"])
        out.insert(0, "node", np.arange(len(out), dtype="int32"))
        out.insert(0, "tree", t)
        return out.astype({"tree": "int32", "node": "int32", "feature": "int32", "left": "int32",
                           "right": "int32", "depth": "int32", "size": "int32"})

    nodes = per_tree.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    return IsolationModel(nodes=nodes, features=features, psi=psi)


def _arrays(model: IsolationModel):
    """Nodes of all trees as arrays: a row at node i goes on to child[2 i + 1] below the threshold and else to
    child[2 i]; a leaf is its own child, so a row that has arrived stays."""
    pdf = model.nodes.toPandas().sort_values(["tree", "node"])   # bounded: trees x (2 psi - 1)
    first = np.flatnonzero(~pdf["tree"].duplicated().to_numpy())
    off = np.repeat(first, np.diff([*first, len(pdf)]))
    inner = pdf["feature"].to_numpy() >= 0
    me = np.arange(len(pdf))
    child = np.column_stack([np.where(inner, pdf[side].to_numpy() + off, me) for side in ("right", "left")]).ravel()
    depth = pdf["depth"].to_numpy()
    adj = depth + np.array([avg_path(s) for s in pdf["size"].to_numpy()])
    return dict(feature=np.where(inner, pdf["feature"].to_numpy(), 0).astype("int64"),
                threshold=pdf["threshold"].to_numpy(dtype="float64"), child=child.astype("int64"), adj=adj,
                trees=[(int(r), int(d)) for r, d in zip(first, np.maximum.reduceat(depth, first))])


def path_lengths(df: DataFrame, model: IsolationModel, key: str, out_col: str = "mean_path",
                 carry: Sequence[str] = ()) -> DataFrame:
    """Mean isolation path length per row (vectorised over Arrow batches), with
    the columns of ``carry`` beside it."""
    from fleetkit.session import ship_package
    ship_package(df.sparkSession)
    arr = _arrays(model)
    bc = df.sparkSession.sparkContext.broadcast(arr)
    feats = model.features
    ids = [key, *carry]
    schema = T.StructType([*[df.schema[c] for c in ids], T.StructField(out_col, T.DoubleType())])

    def walk(batches):
        a = bc.value
        threshold, child, adj = a["threshold"], a["child"], a["adj"]
        for pdf in batches:
            n = len(pdf)
            x = pdf[feats].to_numpy(dtype="float64").ravel(order="F")        # one feature after the other
            column, rows = a["feature"] * n, np.arange(n)
            total = np.zeros(n)
            for root, deepest in a["trees"]:
                idx = np.full(n, root)
                for _ in range(deepest):
                    below = x.take(column.take(idx) + rows) < threshold.take(idx)
                    idx = child.take(2 * idx + below)
                total += adj.take(idx)
            yield pd.DataFrame({**{c: pdf[c].values for c in ids}, out_col: total / len(a["trees"])})

    return df.select(*ids, *feats).mapInPandas(walk, schema)


def raw_scores(df: DataFrame, model: IsolationModel, key: str, carry: Sequence[str] = ()) -> DataFrame:
    """score_samples = -2^(-E[h]/c(psi)) (higher = more normal)."""
    c = avg_path(model.psi)
    h = path_lengths(df, model, key, carry=carry)
    return h.select(key, *carry, (-F.pow(F.lit(2.0), -F.col("mean_path") / F.lit(c))).alias("score_samples"))


def exact_percentile(df: DataFrame, col: str, p: float, accuracy: int = 100_000,
                     max_pairs: int = 100_000) -> float:
    """Exact p-quantile with linear interpolation between order statistics
    (the usual numpy convention), without collecting the column; NaN for no
    values.

    ``percentile_approx`` has rank error at most n / accuracy, so its values
    2 / accuracy + 2 / n away from the wanted ranks bracket them.  The bracket
    is narrowed, each time within the rows of the last one, until it holds at
    most ``max_pairs`` distinct values; only these and their counts are
    collected, whatever the table size and however many ties there are."""
    import math
    part = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_v"))
    c = F.col("_v")
    inside = part.count()
    if inside == 0:
        return float("nan")
    pos = (inside - 1) * p
    first = int(math.floor(pos))
    last = min(first + 1, inside - 1)
    below, narrowed = 0, False
    while True:
        # few rows, or a bracket of many: look at no more values than the bound allows
        if inside <= max_pairs or narrowed:
            pairs = sorted(tuple(r) for r in part.groupBy("_v").count().limit(max_pairs + 1).collect())
            if len(pairs) <= max_pairs:
                break
        margin = 2.0 / accuracy + 2.0 / inside
        ends = [max(0.0, (first - below) / inside - margin), min(1.0, (last - below + 1) / inside + margin)]
        lo, hi = part.agg(F.percentile_approx("_v", ends, accuracy).alias("b")).first()["b"]
        st = part.agg(F.count_if(c < lo).alias("less"), F.count_if(c.between(lo, hi)).alias("n")).first()
        if lo == hi:
            return float(lo)
        if narrowed and st["n"] == inside:       # no narrower with this accuracy
            accuracy = min(accuracy * 10, 2**31 - 1)
        narrowed = True
        part, below, inside = part.where(c.between(lo, hi)), below + st["less"], st["n"]

    def nth(k: int) -> float:                  # k-th smallest (0-based) of all values
        k -= below
        for v, cnt in pairs:
            if k < cnt:
                return v
            k -= cnt
        return pairs[-1][0]

    return float(nth(first) + (nth(last) - nth(first)) * (pos - first))


def fit_offset(df: DataFrame, model: IsolationModel, key: str, contamination: float = 0.1) -> IsolationModel:
    """offset = the exact ``contamination`` quantile of the training scores.
    The scores are materialised once (checkpoint), so the vectorised tree
    walk runs once for the three small passes of ``exact_percentile``."""
    from fleetkit.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    scores = raw_scores(df, model, key).select("score_samples").checkpoint(eager=True)
    model.offset = exact_percentile(scores, "score_samples", contamination)
    return model


def decision(df: DataFrame, model: IsolationModel, key: str, carry: Sequence[str] = ()) -> DataFrame:
    """Signed decision value (negative = anomalous), with the columns of ``carry``."""
    return (raw_scores(df, model, key, carry)
            .select(key, *carry, (F.col("score_samples") - F.lit(model.offset)).alias("anomaly_score")))
