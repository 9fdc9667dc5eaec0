import numpy as np
import pytest

from fleetkit.llm import embedding_join as E

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, rid int"


def brute(rows, threshold=0.98):
    n = len(rows)
    ok = [r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
          for r in rows]
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        c = min(ids) if ids else None
        out.append((str(rows[i][0]), len(links[i]), c, rows[i][0] is not None and rows[i][0] == c))
    return sorted(out, key=str)


def got(df):
    return sorted(((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("cell_rows,block", [(4096, 2048), (30, 2048), (20, 7), (4096, 11)])
def test_clusters_against_brute_force(spark, cell_rows, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(360):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3 == 0), "k", 1))
    rows += [(500 + i, rows[0][1], 1, "k", 1) for i in range(20)] + [(400, [2 * x for x in rows[0][1]], 1, "k", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(E.near_duplicates(df, cell_rows=cell_rows, block=block)) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1, "k", 1), (2, [], 1, "k", 1), (3, [0.0, 0.0], 1, "k", 1), (4, [nan, 1.0], 1, "k", 1),
            (5, [inf, 1.0], 1, "k", 1), (6, [None, 1.0], 1, "k", 1), (7, [1.0, 0.0], None, "k", 1),
            (8, [1.0, 0.0], 1, "k", 1), (9, [1.0, 0.0], 1, "k", 1), (9, [1.0, 0.0], 1, "k", 1), (10, [3.0, 0.0], 1, "k", 1),
            (11, [1.0, 0.0, 0.0], 1, "k", 1), (None, [1.0, 0.01], 1, "k", 1), (12, [1.0, 0.0], 2, "k", 1),
            (13, [1.0, 0.0], None, "k", 1), (14, [-1.0, -0.0], 1, "k", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(E.near_duplicates(df)) == brute(rows)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert got(E.op9_embedding_dedup(spark, "/root/testdata/sf0.001")) == brute(rows)


@pytest.mark.parametrize("cell_rows", [E.CELL_ROWS, 2])
def test_extreme_magnitudes(spark, cell_rows):
    """The cosine does not depend on the scale: norms neither underflow nor overflow."""
    rows = [(1, [1e-200, 0.0], 1, "k", 1), (2, [0.5, 0.866], 1, "k", 1), (3, [0.0, 1e-170], 1, "k", 1), (4, [0.6, 0.8], 1, "k", 1),
            (5, [1e200, 0.0], 1, "k", 1), (6, [2e200, 1e190], 1, "k", 1), (7, [5e-324, 0.0], 1, "k", 1),
            (8, [-1.7e308, 1.7e308], 1, "k", 1), (9, [-1e-300, 1e-300], 1, "k", 1), (10, [-1e-250, 1e-260], 1, "k", 1)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    linked = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df, cell_rows=cell_rows).collect()}
    assert linked == {1: (3, 1), 5: (3, 1), 6: (3, 1), 7: (3, 1), 8: (1, 8), 9: (1, 8),
                      2: (1, 2), 3: (0, 3), 4: (1, 2), 10: (0, 10)}


def test_labels_of_any_type(spark):
    rows = [(i, [1.0, 0.01 * (i % 4)], "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    for cell_rows in (E.CELL_ROWS, 4):
        assert got(E.near_duplicates(df, cell_rows=cell_rows)) == brute([(*r, "k", 1) for r in rows])
