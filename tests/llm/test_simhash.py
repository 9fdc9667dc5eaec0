import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetkit.llm import simhash
from fleetkit.llm.common import components

SCHEMA = "doc_id long, text string, fp string, component_id string"   # the last two clash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(keys, fps):
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(keys)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            r = find(i)
            least[r] = min(least.get(r, k), k)
    return [least.get(find(i)) for i in range(len(keys))]


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", c) for r, f, c in
            zip(rows, fps, brute_components([r.doc_id for r in rows], fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert got == want


@pytest.mark.parametrize("cap", [64, 2])
def test_edge_rows_and_hot_buckets(spark, cap):
    base = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \t\n", "a", "A", "a b", base, base, base.upper(), base + " tail",
             base.replace("w20", "x"), "long " * 50_000, "é è ü"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(6, base, "x", "y"), (None, base, "x", "y")]
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = sorted(zip([str(r[0]) for r in rows], [f"{f:016x}" for f in fps],
                      brute_components([r[0] for r in rows], fps)))
    got = simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA), bucket_pairs=cap).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_empty(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("cap", [64, 3])
def test_links_keep_every_component(spark, cap):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set()
    for s in seeds:
        for _ in range(60):
            x = int(s)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, head long")
    made = simhash.links(df, 2, simhash.plan(df, 2), cap)
    bad = made.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count()
    roots = {r.node: r.root for r in components(made).collect()}
    groups = [roots.get(f, f) for f in signed]
    want = brute_components(list(range(len(fps))), fps)
    assert bad == 0
    assert len(set(zip(groups, want))) == len(set(groups)) == len(set(want))


def test_thresholds_follow_the_general_pigeonhole():
    cost, ts = simhash.allocate([[0, 5, 50], [0, 1, 2], [0, 9, 90]], 0)
    assert sum(ts) == 0 and cost == 7 and ts == [0, 1, -1]


@pytest.mark.parametrize("distance, cap", [(3, 64), (3, 1), (4, 64), (1, 1)])
def test_other_distances_against_brute_force(spark, distance, cap):
    rng = np.random.default_rng(distance)
    base = rng.integers(-2 ** 62, 2 ** 62, 8)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(5):
            x = int(b)
            for bit in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x ^= simhash._bit(int(bit))
            fps.add(x)
    fps = sorted(fps)
    got = simhash.rooted(spark.createDataFrame([(x,) for x in fps], "fp long"), distance, cap).collect()
    root = {r.fp: r.root for r in got}
    parts = {}
    for x in fps:
        near = [p for p in parts if any(((x ^ y) & (2 ** 64 - 1)).bit_count() <= distance for y in parts[p])]
        parts[x] = [x, *(y for p in near for y in parts.pop(p))]
    assert len(parts) < len(fps)
    assert sorted(sorted(v) for v in parts.values()) == sorted(
        sorted(x for x in fps if root[x] == r) for r in set(root.values()))
