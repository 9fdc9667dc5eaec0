from collections import Counter

import numpy as np

import corpus_pipeline as C
from fleetkit.llm import mixing, quality_knn, secrets
from tests_llm_brute import brute_components, brute_fingerprint, brute_secrets


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    out = C.quality_stage(spark, docs, sf)
    judged = {r.doc_id: r.predicted for r in quality_knn.op8_quality_classifier(spark, sf).collect()}
    good = sorted(k for k, p in judged.items() if p == 1)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == good and good

    out = C.dedup_stage(spark, out, sf)
    groups = brute_components(good, [brute_fingerprint(rows[k].text) for k in good])
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(groups))

    # redacted: the base spans, and the runs that the method adds
    spans = {r.doc_id: r.spans for r in secrets.scan(out).collect()}
    out = C.keep(C.secret_stage(spark, out, sf), "test-secrets")
    clean = {r.doc_id: r for r in out.collect()}
    assert sorted(clean) == sorted(set(groups))
    for k, r in clean.items():
        assert not brute_secrets(r.text)
        assert r.n_chars == len(r.text)
        assert ("[secret]" in r.text) == bool(spans[k])
        if not spans[k]:
            assert r.text == rows[k].text
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans[k] if s["kind"] != "random"] == brute_secrets(rows[k].text)

    mixed = C.keep(C.mixing_stage(spark, out, sf), "test-mixed")
    size = Counter()
    for r in clean.values():
        size[r.source] += len(r.text.encode().split())
    order = sorted(size)
    want = dict(zip(order, mixing.targets([size[s] for s in order])))
    took = Counter()
    for r in mixed.collect():
        took[r.source] += len(r.text.encode().split())
        assert not Counter(r.text.encode().split()) - Counter(clean[r.doc_id].text.encode().split())
    assert mixed.columns == docs.columns
    assert all(abs(took[s] - want[s]) <= 2 * mixing.BLOCK_WORDS for s in order)

    from fleetkit.llm.tokens import WordBpe
    enc = WordBpe()
    texts = [r.text for r in mixed.select("text").collect()]
    packed = C.packing_stage(spark, mixed, sf).collect()
    ids = Counter(i for x in enc.encode(texts) for i in x.tolist()) + Counter({2: len(texts)})
    assert Counter(np.concatenate([np.frombuffer(r.ids, "<u4") for r in packed]).tolist()) == ids


def test_null_and_repeated_rows(spark):
    rows = [(None, "a b c d", "en", None, 7), (None, "a b c d", "en", None, 7), (3, None, None, "s", None),
            (2, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (None, "completely other words here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in C.dedup_stage(spark, docs.withColumn("rid", C.F.lit(1)), "").collect())
    assert got == [("2", "a b c d"), ("3", None), ("None", "completely other words here")]
    for _, stage in C.STAGES[1:]:
        assert stage(spark, docs.limit(0), "").count() == 0
