from collections import Counter

import numpy as np
import pytest

from fleetkit.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rid int"


def test_targets():
    assert M.targets([100, 100, 100]) == [50, 100, 150]
    got = M.targets([1, 100, 100])
    assert got[0] <= 3 and abs(sum(got) - 201) < 1e-9
    assert M.targets([10, 1000, 5]) == [pytest.approx(30), pytest.approx(970), 15]
    assert M.targets([]) == [] and M.targets([0, 0]) == [0, 0]


def test_permutation_and_counts():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(M.permute(np.arange(n), n, 5)) == list(range(n))
    quota = np.array([5, 0, 700, 123, 1])
    got = [M.shard_counts(quota, k, 100, 3) for k in range(9)]
    assert (sum(c for c, _ in got) == quota).all()
    assert [int(c.sum()) for c, _ in got] == [100] * 8 + [29]
    for k in range(1, 9):
        assert (got[k][1] == got[k - 1][1] + got[k - 1][0]).all()


def test_usage_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = M.usage(docs, shard_blocks=500).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.usage(docs, shard_blocks=500).collect()))
    size, took, want = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
        took[r.source] += r.taken
        want[r.source] = (r.source_size, r.target)
    assert {s: w[0] for s, w in want.items()} == dict(size)
    order = sorted(size)
    assert [want[s][1] for s in order] == pytest.approx(M.targets([size[s] for s in order]))
    assert all(abs(took[s] - want[s][1]) <= 2 * M.BLOCK_WORDS for s in order)
    assert {r.doc_id: r.size for r in got} == {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}


def test_edges_and_mixed_documents(spark):
    words = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    rows = [(1, words("a", 500), "en", "a", 0, "x", 1), (2, None, "en", "a", 0, "x", 1), (3, "", None, "b", 0, "x", 1),
            (4, words("b", 5000) + "\n\tend ", "en", "b", 0, "x", 1), (5, words("n", 100), None, None, 0, "x", 1),
            (5, words("n", 100), None, None, 0, "x", 1), (None, words("z", 40), "en", "z", 0, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    use = M.usage(docs).collect()
    assert len(use) == len(rows)
    by = {r.source: r for r in use}
    assert by["a"].target == 1500 and by["z"].target == 120 and by[None].target == 600
    assert sum(r.taken for r in use if r.source is None) == 600 and by["z"].taken == 120
    out = M.mixed_documents(docs).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    took = Counter()
    for r in out:
        took[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert took["a"] == 1500 and took[None] == 600 and took["z"] == 120
    texts = {t[1] for t in rows}
    assert all(r.text in texts for r in out if r.source != "b")
    assert M.usage(docs.limit(0)).count() == 0 and M.mixed_documents(docs.limit(0)).count() == 0


def test_sources_below_a_block_come_near_their_targets(spark):
    words = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    docs = spark.createDataFrame([(k, words(k, 5), "en", f"s{k:02}", 0, "x", 1) for k in range(30)]
                                 + [(99, words("y", 150), "en", "y", 0, "x", 1)], SCHEMA)
    got = M.usage(docs).collect()
    assert all(abs(r.taken - r.target) <= 2.5 and r.taken <= 3 * r.size for r in got), got
    assert abs(sum(r.taken for r in got) - 300) <= 10
    few = M.usage(docs.where("source <> 'y'")).collect()
    assert sorted(r.taken for r in few) == [2] * 10 + [5] * 10 + [8] * 10
    assert [M.block_length(n) for n in (0, 1, 127, 128, 4095, 4096, 10**9)] == [1, 1, 1, 2, 63, 64, 64]


def test_rows_without_ids_spread_over_the_windows(spark, monkeypatch):
    monkeypatch.setattr(M, "WINDOW_ROWS", 50)
    docs = spark.range(2000).selectExpr("cast(null as long) doc_id", "concat('t', id, ' u') text", "'en' lang", "'a' source")
    rows = M.keep(M.sized(docs), "mix-rows")
    _, spans = M.mix(rows)
    assert spans.agg({"words": "sum"}).first()[0] == 4000
    per = spans.join(rows.select("rid", "key"), "rid").selectExpr("pmod(xxhash64(cast(null as long), key, 7), 40) part").groupBy("part").count().collect()
    assert len(per) == 40 and max(r["count"] for r in per) < 200
    copies = M.usage(docs.selectExpr("doc_id", "'same text' text", "lang", "source")).collect()
    assert {r.taken for r in copies} <= {2} and len(copies) == 2000


def test_many_sources(spark, monkeypatch):
    words = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    rows = [(k, words(k, 1 + k * 37 % 9), f"s{k % 700:03}é" if k % 11 else f"s{k % 700:03}") for k in range(2000)]
    rows += [(5000 + k, words(k, 400), "hot") for k in range(40)] + [(None, words("n", 30), None), (1, None, "empty"), (2, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = M.usage(docs).collect()
    plain = {r.source: (r.source_size, r.target) for r in few}
    monkeypatch.setattr(M, "URNS", 50)
    many = M.usage(docs, shard_blocks=1000).collect()
    assert len(many) == len(rows)
    got = {r.source: (r.source_size, r.target) for r in many}
    assert got.keys() == plain.keys()
    assert all(got[s] == (plain[s][0], pytest.approx(plain[s][1], abs=1e-6)) for s in plain)
    took = lambda use: Counter({r.source: 0 for r in use}) + sum((Counter({r.source: r.taken}) for r in use), Counter())
    a, b = took(few), took(many)
    # the quotas are the same; only a short last block of a source may differ
    assert all(abs(a[s] - b[s]) <= 3 * M.block_length(plain[s][0]) for s in plain)
    assert all(abs(b[s] - plain[s][1]) <= 2 * M.block_length(plain[s][0]) + 1 for s in plain)
    assert all(r.taken <= 3 * r.size for r in many)
    assert sorted(map(str, many)) == sorted(map(str, M.usage(docs, shard_blocks=1000).collect()))
    out = M.mixed_documents(docs.withColumn("lang", docs.source)).groupBy("source").count().count()
    assert out == sum(v > 0 for v in b.values())


def test_sources_without_words_or_all_capped(spark, monkeypatch):
    monkeypatch.setattr(M, "URNS", 2)
    none = spark.createDataFrame([(k, "", f"s{k}") for k in range(9)], "doc_id long, text string, source string")
    assert [r.taken for r in M.usage(none).collect()] == [0] * 9
    one = spark.createDataFrame([(0, "a b c", "x"), *((k, None, f"s{k}") for k in range(1, 9))],
                                "doc_id long, text string, source string")
    assert sorted(r.taken for r in M.usage(one).collect()) == [0] * 8 + [3]
