from zlib import crc32

import numpy as np

from fleetkit.llm import quality_knn as Q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = Q.op8_quality_classifier(spark, sf).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert np.mean([p for p, y in held if y == 1]) > 0.98


def test_score_against_brute_force():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "Of", "LOUD!!", "a|", "x9", "###"], rng.integers(1, 30))) for _ in range(200)]
    rates = [Q.term_rates(t, Q.Terms()) for t in texts]
    model = Q.fit(rates, np.arange(200) % 2)
    z = model.latent(rates).astype(float)
    for i, got in enumerate(model.score(rates)):
        cos = model.latent(rates[i:i + 1])[0] @ model.vectors.T
        near = cos >= np.sort(cos)[-Q.NEIGHBOURS]
        w = np.maximum(cos[near], 0).astype(float) ** 8
        assert abs(got - (w @ model.labels[near] + 0.5) / (w.sum() + 1)) < 0.05
    assert np.allclose(np.linalg.norm(z, axis=1)[:, None] ** 2, 1, atol=1e-3)


def test_word_axes_against_a_full_svd():
    rng = np.random.default_rng(2)
    topics = rng.dirichlet(np.full(300, 0.05), 6)
    texts = [" ".join(f"w{i}" for i in rng.choice(300, 60, p=topics[k % 6])) for k in range(240)]
    rates = [Q.term_rates(t, Q.Terms()) for t in texts]
    idf = np.linspace(1, 2, Q.WORDS).astype(np.float32)
    dense = np.zeros((240, Q.WORDS), np.float32)
    for i, (_, t, v) in enumerate(rates):
        np.add.at(dense[i], t, v)
    x = dense * idf
    axes = Q.word_axes(rates, idf)
    assert np.allclose(axes.T @ axes, np.eye(Q.DIMENSIONS), atol=1e-4)
    best = np.linalg.svd(x, full_matrices=False)[2][:6]
    assert np.linalg.norm(best @ axes, axis=1).min() > 0.99         # the leading axes are held


def test_labels_that_depend_on_vocabulary_alone(spark):
    """All words have one shape and rows one length; which words a text takes decides its label."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    common, good, bad = [word() for _ in range(300)], [word() for _ in range(60)], [word() for _ in range(60)]
    rows = []
    for i in range(1600):
        own = good if i % 2 else bad
        words = [*rng.choice(common, 70), *rng.choice(own, 30)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1600)], "doc_id long, quality int")
    got = [(r.score, r.doc_id % 2) for r in Q.classify(docs, labels).collect() if r.held_out]
    ones, zeros = [s for s, y in got if y], [s for s, y in got if not y]
    auc = np.mean([[a > b for b in zeros] for a in ones])
    assert len(got) > 300 and auc > 0.99
    assert np.mean([(s >= 0.5) == bool(y) for s, y in got]) > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "", 9), (None, "a b", 9), (3, "X " * 200_000, 9)],
                                 "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (99, 1)], "doc_id long, quality int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = Q.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert Q.classify(docs.limit(0), labels).count() == 0
