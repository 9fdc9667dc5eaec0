"""Embedding near-duplicates: an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit.llm.common import components, keep, prepare, table

#: Rows a cell is meant to hold, pivots of one label at most, pivots at most in all (broadcast).
CELL_ROWS, LABEL_PIVOTS, MAX_PIVOTS = 4096, 64, 20_000
#: Rows on each side of one block of a cell's join.
BLOCK = 2048
#: Slack of the pruning bounds, far above rounding and far below any distance that matters.
SLACK = 1e-7


def _matrix(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows brought to a largest component of 0.5 to 1 by a power of two: exact, and no norm over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, label, embedding) and, written, their distinct linkable
    vectors (rid, label, embedding, copies, head).  Null, zero and non-finite
    vectors, and null labels, link with nothing and are left out."""
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", e.cast("array<double>").alias("embedding"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = rows.where(F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0))
    reps = sound.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("head"))
    return rows, keep(reps.select(F.monotonically_increasing_id().alias("rid"), "*"), "vectors")


def _pivots(reps: DataFrame, cell_rows: int, seed: int) -> dict[tuple, np.ndarray]:
    """Unit pivots of each (label, dimension) with more rows than a cell, chosen
    by hash; the largest come first while MAX_PIVOTS lasts.  A label without
    pivots is one cell, joined block by block."""
    sizes = (reps.groupBy(F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > cell_rows).orderBy(F.desc("n"), "label", "dim").limit(MAX_PIVOTS).collect())
    want, left = [], MAX_PIVOTS
    for r in sizes:
        k = min(LABEL_PIVOTS, -(-r["n"] // cell_rows), left)
        left -= k
        if k > 1:
            want.append((r["label"], r["dim"], min(1.0, 2.0 * k / r["n"]), k))
    if not want:
        return {}
    spark = reps.sparkSession
    share = spark.createDataFrame([(a, b, c) for a, b, c, _ in want], "name string, dim int, share double")
    h = F.pmod(F.xxhash64("embedding", F.lit(seed)), F.lit(1 << 30))
    drawn = (reps.withColumn("dim", F.size("embedding")).withColumn("name", F.col("label").cast("string"))
             .join(F.broadcast(share), ["name", "dim"]).where(h < F.col("share") * (1 << 30))
             .select(F.col("name").alias("label"), "dim", "embedding", h.alias("h")).collect())        # about twice MAX_PIVOTS rows
    out, by = {}, {}
    for r in drawn:
        by.setdefault((r["label"], r["dim"]), []).append(r)
    for label, dim, _, k in want:
        mine = sorted(by.get((label, dim), []), key=lambda r: r["h"])[:k]
        if len(mine) > 1:
            out[(label, dim)] = np.unique(_unit(np.array([r["embedding"] for r in mine], float)), axis=0)
    return out


def assign(reps: DataFrame, pivots: dict[tuple, np.ndarray], radius: float) -> DataFrame:
    """(label, dim, cell, home, rid, copies, vec): each vector in the cell of its
    nearest pivot, and a copy in every cell that may hold a vector within
    ``radius``: by the triangle inequality the other pivot is at most 2 radii
    farther, and the plane between the two pivots at most one radius away."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (label, dim), g in b.groupby(["label", "dim"], sort=False):
                p = pivots.get((label, dim))
                if p is None or len(p) < 2:
                    yield g.assign(cell=0, home=True)[COLUMNS]
                    continue
                d = np.sqrt(np.maximum(2 - 2 * (_unit(_matrix(g["vec"])) @ p.T), 0))
                near = d.argmin(1)
                own = d[np.arange(len(d)), near][:, None]
                apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[near]
                plane = (d * d - own * own) / (2 * np.maximum(apart, 1e-300))
                there = (d - own <= 2 * radius + SLACK) & (plane <= radius + SLACK)
                there[np.arange(len(d)), near] = True
                row, cell = np.nonzero(there)
                yield g.iloc[row].assign(cell=cell, home=near[row] == cell)[COLUMNS]

    blob = reps.select("rid", F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"), "copies",
                       "embedding")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(vec=[np.asarray(e, "<f8").tobytes() for e in b["embedding"]]).drop(columns="embedding")

    packed = blob.mapInPandas(pack, "rid long, label string, dim int, copies long, vec binary")
    return packed.mapInPandas(
        place, "label string, dim int, cell int, home boolean, rid long, copies long, vec binary")


COLUMNS = ["label", "dim", "cell", "home", "rid", "copies", "vec"]


def join_cells(placed: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(rid, links, root): per block of a cell, the copies each home vector is
    linked with and the least rid of its linked neighbourhood in the block.

    A cell's rows are dealt to chunks of about ``block`` rows and each pair of
    chunks is joined on its own, so a crowded cell is many tasks of bounded
    size.  A vector's links are counted in its home cell only, which holds
    everything within the radius; pairs never leave a block."""
    key = ["label", "dim", "cell"]
    counted = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    dealt = placed.join(counted, key).withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(
        F.least(j, F.col("chunk")).alias("i"), F.greatest(j, F.col("chunk")).alias("j")))
    dealt = dealt.withColumn("pair", F.explode(others)).select(*COLUMNS, "chunk", "pair.i", "pair.j")

    def block_join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        x, y = pdf[pdf["chunk"] == i], pdf[pdf["chunk"] == j]
        if not len(x) or not len(y):
            return pd.DataFrame({"rid": [], "links": [], "root": []}).astype("int64")
        a, b = _scaled(_matrix(x["vec"])), _scaled(_matrix(y["vec"]))
        cosine = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        near = cosine >= threshold
        xr, yr = x["rid"].to_numpy(), y["rid"].to_numpy()
        near &= xr[:, None] != yr[None, :]
        xn = np.where(x["home"], near @ y["copies"].to_numpy(), 0)
        ids = np.concatenate([xr, yr]) if i != j else xr
        links = np.concatenate([xn, np.where(y["home"], near.T @ x["copies"].to_numpy(), 0)]) if i != j else xn
        r, c = np.nonzero(near)
        c = c + (len(xr) if i != j else 0)
        root = ids.copy()
        while True:                                   # least rid over the block's links
            before = root.copy()
            np.minimum.at(root, r, before[c])
            np.minimum.at(root, c, before[r])
            if (root == before).all():
                break
        some = (links > 0) | (root != ids)
        return pd.DataFrame({"rid": ids[some], "links": links[some], "root": root[some]})

    return dealt.groupBy(*key, "i", "j").applyInPandas(block_join, "rid long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, cell_rows: int = CELL_ROWS, block: int = BLOCK,
                    seed: int = 5) -> DataFrame:
    """Links of ``vectors`` (vec_id long, embedding array, label): one row per
    input row with n_links, component_id and kept.

    Vectors of equal, non-null labels and equal dimension link if their cosine
    in double precision is at least ``threshold``.  Exact copies are one vector
    with a count throughout.  Vectors that are null, zero or hold null or
    non-finite components link with nothing and stay.  Repeated vec_ids are
    rows of their own; a null vec_id can link but not name a component and is
    not kept; other columns are ignored; no rows give no rows."""
    prepare(vectors.sparkSession)
    rows, reps = distinct_vectors(vectors)
    radius = float(np.sqrt(max(2 - 2 * threshold, 0)))
    placed = assign(reps, _pivots(reps, cell_rows, seed), radius)
    found = keep(join_cells(keep(placed, "vector-cells"), threshold, block), "vector-links")
    roots = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    known = (reps.join(counts, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
             .withColumn("root", F.coalesce("root", "rid")))
    heads = known.groupBy("root").agg(F.min("head").alias("component"))
    known = known.join(heads, "root").select(
        "label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component")
    out = rows.join(known, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: links and components of all embeddings at cosine 0.98."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: The same by a plain self-join, for small tables; the components by reachability.
ORACLE_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
         (label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0) AS sound
  FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE a.sound AND b.sound AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM e
  UNION
  SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT e.vec_id AS vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM e JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
"""
