import math
import tempfile
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetkit.llm import lm_scores as L
from fleetkit.llm.elias_fano import EliasFano, Trie, dequantise


def brute(rows, held, mu=L.MU):
    texts = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    uni, bi = Counter(), Counter()
    for t, h in zip(texts, held):
        if not h:
            uni.update(t)
            bi.update(zip([b"", *t], t))
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for (k, _), t, h in zip(rows, texts, held):
        score = sum(math.log10((bi[a, b] + mu * p1(b)) / (uni[a] + mu)) for a, b in zip([b"", *t], t))
        out.append((str(k), h, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), score))
    return sorted(out)


def same(got, want):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=2e-3)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    held = [crc32(str(k).encode()) % 5 == 1 for k, _ in rows]
    same(L.op7_lm_scoring(spark, "/root/testdata/sf0.001").collect(), brute(rows, held))


@pytest.mark.parametrize("tokens,split", [(2 << 20, 1 << 18), (50, 3)])
def test_edges(spark, tokens, split):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b A B é É"), (4, "a b a b"), (None, "x y"), (5, "the cat " * 20_000),
            (6, "unseen words a b"), (7, "a b c d e f a b")]
    df = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id long, text string, score string, codes int")
    got = L.score(df, F.col("doc_id") == 6, chunk_tokens=tokens, shard_pairs=1000, context_pairs=split).collect()
    same(got, brute(rows, [k == 6 for k, _ in rows]))
    assert L.score(df.limit(0), F.lit(False)).count() == 0
    none = L.score(df, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)


def test_elias_fano_elements_and_successors():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (1, 1 << 45), (2, 1 << 61), (1000, 10), (1000, 1 << 40), (5000, 5000), (300, 1 << 20)):
        v = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        if n == 300:
            v[100:250] = v[100]                     # a long run of one value
        ef = EliasFano(EliasFano.encode(v))
        assert (ef.at(np.arange(n)) == v).all()
        key = np.concatenate([v, v + np.uint64(1), rng.integers(0, 2 * top + 2, 500).astype(np.uint64)])
        lo = rng.integers(0, n + 1, len(key))
        hi = np.minimum(n, lo + rng.integers(0, n + 1, len(key)))
        at, hit = ef.find(key, lo, hi)
        want = [a + int(np.searchsorted(v[a:z], k)) for k, a, z in zip(key, lo, hi)]
        assert at.tolist() == want
        assert hit.tolist() == [i < z and v[i] == k for i, k, z in zip(want, key, hi)]


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 300 * 700, 4000))
    context, word = (keys // 700 * 1000).astype(np.uint64), (keys % 700).astype(np.uint64)
    log_p = -rng.random(len(keys)) * 20
    with tempfile.TemporaryDirectory() as d:
        trie = Trie.write(d, context, word, log_p)
        assert np.allclose(dequantise(trie.codes_of(context, word)), log_p, atol=1e-3)
        have = set(keys.tolist())
        ask = rng.integers(0, 320 * 800, 5000)
        c, w = ask // 800, ask % 800
        got = trie.codes_of((c * 1000).astype(np.uint64), w.astype(np.uint64)) > 0
        assert got.tolist() == [w1 < 700 and c1 * 700 + w1 in have for c1, w1 in zip(c.tolist(), w.tolist())]
