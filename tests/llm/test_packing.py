import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fleetkit.llm import packing
from fleetkit.llm.tokens import WordBpe

SCHEMA = "doc_id long, text string, ids string, offset int"          # the last two clash


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, texts, library, window=4096):
    """Exact round trip of every document, and gapless windows without padding."""
    seqs, parts = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        total = sum(n for _, n in s)
        assert total <= window and total & (total - 1) == 0
    for key, text in texts.items():
        want = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        got = sorted(parts[key], key=lambda p: p[0])
        assert [p[0] for p in got] == [sum(len(q[1]) for q in got[:k]) for k in range(len(got))]
        assert np.concatenate([p[1] for p in got]).tolist() == want and got[0][2] == len(want)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3, "doc_id")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(packing.pack(docs, block_ids=20_000).collect(), texts, library)


def test_edges(spark, library):
    texts = [None, "", "   ", "it's we'll 'tis ''s !'s", "<|endoftext|> x <|startoftext|>", "ΑΣ Σ ΟΔΟΣ İ ﬁ ½ 漢字 é",
             "a\x1cb\x85c\xa0d\xade", "word " * 60_000, "</w> <</w>>", "12345 x9", "́a é", "a<|endoftext|>b", "<|endoftext|>" * 3 + "end"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    check(packing.pack(df).collect(), dict(enumerate(texts)), library)
    assert 49407 in WordBpe().encode(["x<|endoftext|>"])[0].tolist()        # the file's own special tokens
    twice = spark.createDataFrame([(1, "a b c", "x", 1)] * 2 + [(None, "a", "x", 1)], SCHEMA)
    assert sum(r.length for r in packing.pack(twice).collect()) == 4 + 4 + 2
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cached_encoder_equals_the_library(library):
    rng = np.random.default_rng(1)
    chars = list("aàßzS's!?.,-0129 \n\t<>|/wÀÖØöÿĀſƀɏ") + ["'t", "'re", "  "]
    texts = ["".join(rng.choice(chars, rng.integers(0, 60))) for _ in range(3000)]
    enc = WordBpe(cache=500)
    for k in range(0, 3000, 250):
        for t, got in zip(texts[k:k + 250], enc.encode(texts[k:k + 250])):
            assert got.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_block_against_lengths():
    rng = np.random.default_rng(2)
    m = packing.combinations(64, 3)
    for n in (0, 1, 5, 400, 3000):
        length = np.minimum(rng.lognormal(6.5, 1.2, n).astype(np.int64) + 1, 20_000)
        out, rest, made = packing.pack_block(np.arange(n), np.zeros(n, np.int64), length, m)
        got = np.zeros(made, int)
        for d, _, size, s, _ in out:
            np.add.at(got, s, size)
        assert (got == 4096).all() and got.sum() + rest[2].sum() == length.sum() and rest[2].sum() < 4096


def test_nnls_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    a, b = rng.random((30, 50)), rng.random(30)
    x = packing.nnls(a, b)
    g = a.T @ (a @ x - b)
    assert (x >= 0).all() and (g > -1e-6).all() and np.abs(g[x > 0]).max() < 1e-6


def test_query_digest(spark):
    rows = packing.op1_packing(spark, "/root/testdata/sf0.001").collect()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert zlib.crc32(np.array([2], "<u4").tobytes()) >= 0 and all(r.ids_crc32 >= 0 for r in rows)
