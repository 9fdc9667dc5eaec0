"""Language-model scores from an Elias-Fano n-gram trie in shards."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit.llm.common import keep, prepare, table
from fleetkit.llm.elias_fano import Trie, dequantise, quantise

#: Tokens of a chunk of documents, and n-grams of a shard of the trie, about.
CHUNK_TOKENS, SHARD_PAIRS = 1 << 20, 2 << 20
#: Words of a shard of the vocabulary, about.
SHARD_WORDS = 1 << 20
#: Pairs a context may have in one shard; a commoner context is split by its successors.
CONTEXT_PAIRS = 1 << 18
#: Weight of the unigram model against a context's own counts.
MU = 3000.0
#: The token that ends every text, and stands before it (no word is empty).
END = ""


def _zip(array: np.ndarray, kind: str) -> bytes:
    """Bytes of an integer array, byte planes apart, compressed."""
    import zstandard
    raw = np.ascontiguousarray(array, kind)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T if len(raw) else raw.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unzip(blob: bytes, kind: str) -> np.ndarray:
    import zstandard
    raw, size = zstandard.ZstdDecompressor().decompress(blob), np.dtype(kind).itemsize
    if not raw:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


CHUNKS = ("chunk long, ids array<long>, held array<boolean>, lengths binary, codes binary, "
          "words array<string>, turn binary, counts binary")


def chunks(docs: DataFrame, chunk_tokens: int, held) -> DataFrame:
    """``docs`` (doc_id, text) as rows of about ``chunk_tokens`` tokens: local
    codes of the tokens, the chunk's words, the words' turn by crc32 and how
    often each is a training token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0

        class Index(dict):
            def __missing__(self, word):
                self[word] = at = len(self)
                return at

        def fresh():
            index = Index()
            return index, index[END.encode()], [], [], [], [], 0

        index, end, ids, flags, lengths, parts, size = fresh()

        def emit() -> pa.RecordBatch:
            nonlocal made
            codes = np.concatenate(parts)
            length = np.array(lengths)
            train = np.repeat(~np.array(flags, bool), length)
            counts = np.bincount(codes[train], minlength=len(index))
            turn = np.argsort(np.fromiter(map(crc32, index), np.uint32, len(index)), kind="stable")
            row = [[base + made], [ids], [flags], [_zip(length, "<u4")], [_zip(codes, "<u4")],
                   [[w.decode() for w in index]], [_zip(turn, "<u4")], [_zip(counts, "<u4")]]
            made += 1
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(),
                     pa.list_(pa.string()), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(x, k) for x, k in zip(row, kinds)],
                                   ["chunk", "ids", "held", "lengths", "codes", "words", "turn", "counts"])

        for batch in batches:
            for key, out, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = text.encode().lower().split() if text else []
                parts.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                parts.append(np.array([end], np.uint32))
                ids.append(key)
                flags.append(bool(out))
                lengths.append(len(words) + 1)
                size += len(words) + 1
                if size >= chunk_tokens:
                    yield emit()
                    index, end, ids, flags, lengths, parts, size = fresh()
        if ids:
            yield emit()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(held, F.lit(False)), "text").mapInArrow(run, CHUNKS)


def word_replies(made: DataFrame, shards: int) -> DataFrame:
    """(chunk, shard, known, ids, counts): for the chunk's words of a shard (a
    range of crc32), in their turn, their global number and training count."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, words, turn, counts in zip(b["chunk"], b["words"], b["turn"], b["counts"]):
                turn = _unzip(turn, "<u4")
                words, counts = np.asarray(words, object)[turn], _unzip(counts, "<u4")[turn]
                of = np.fromiter((crc32(w.encode()) * shards >> 32 for w in words), np.int64, len(words))
                cuts = np.searchsorted(of, np.arange(shards + 1))
                rows = [(chunk, s, words[a:z].tolist(), _zip(counts[a:z], "<u4"))
                        for s, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
                yield pd.DataFrame(rows, columns=["chunk", "shard", "words", "counts"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        sizes = [len(w) for w in pdf["words"]]
        code, names = pd.factorize(np.concatenate([np.asarray(w, object) for w in pdf["words"]]))
        total = np.bincount(code, np.concatenate([_unzip(c, "<u4") for c in pdf["counts"]]), len(names)).astype(np.uint64)
        number = code.astype(np.uint64) * np.uint64(shards) + np.uint64(pdf["shard"].iloc[0])
        cuts = np.cumsum([0, *sizes])
        return pd.DataFrame({"chunk": pdf["chunk"], "shard": pdf["shard"], "known": int((total > 0).sum()),
                             "ids": [_zip(number[a:z], "<u8") for a, z in zip(cuts, cuts[1:])],
                             "counts": [_zip(total[code[a:z]], "<u8") for a, z in zip(cuts, cuts[1:])]})

    return (made.select("chunk", "words", "turn", "counts")
            .mapInPandas(send, "chunk long, shard long, words array<string>, counts binary")
            .groupBy("shard").applyInPandas(merge, "chunk long, shard long, known long, ids binary, counts binary"))


def _vocabulary(turn: bytes, replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Global numbers and training counts of a chunk's words, in code order."""
    order, replies = _unzip(turn, "<u4"), replies.sort_values("shard")
    number, count = np.zeros(len(order), np.uint64), np.zeros(len(order), np.uint64)
    number[order] = np.concatenate([_unzip(x, "<u8") for x in replies["ids"]])
    count[order] = np.concatenate([_unzip(x, "<u8") for x in replies["counts"]])
    return number, count


def _alone(context: np.ndarray, mu: float) -> np.ndarray:
    """Code of a successor seen once.  Answers are sent relative to it: most are."""
    return quantise(-np.log(context.astype(float) + mu)).astype(np.int64)


def _pairs(codes: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) pairs of a chunk, sorted, as codes; and of each
    token its pair.  The context of a text's first token is the end before it."""
    before = np.concatenate([[end], codes[:-1]]).astype(np.uint64)
    key, of = np.unique(before << np.uint64(32) | codes.astype(np.uint64), return_inverse=True)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), of, key


def _route(number: np.ndarray, count: np.ndarray, v: np.ndarray, w: np.ndarray, shards: int,
           context_pairs: int) -> np.ndarray:
    """Shard of each pair, -1 where training cannot have seen it.  A context
    commoner than ``context_pairs`` is split by its successors; the split depends
    on global counts alone, so equal pairs of all chunks meet."""
    splits = count[v] // np.uint64(context_pairs) + np.uint64(1)
    with np.errstate(over="ignore"):
        part = (number[w] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % splits
        h = (number[v] * np.uint64(0xD6E8FEB86659FD93) + part * np.uint64(0xA0761D6478BD642F))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    shard = ((h ^ (h >> np.uint64(32))) % np.uint64(shards)).astype(np.int64)
    return np.where((count[v] > 0) & (count[w] > 0), shard, -1)


def score(docs: DataFrame, held, mu: float = MU, chunk_tokens: int = CHUNK_TOKENS,
          shard_pairs: int = SHARD_PAIRS, context_pairs: int = CONTEXT_PAIRS) -> DataFrame:
    """Scores of ``docs`` (doc_id, text) under a bigram model learnt from the
    rows where Column ``held`` is not true.

    One row per input row: doc_id, held_out, n_tokens (words, A-Z lower-cased,
    and the end), n_known (tokens with a training count), train_tokens,
    base_score (add-half unigram log10 probability, summed) and score (the
    model's).  The model is p(w|v) = (c(vw) + mu p(w)) / (c(v) + mu), with p(w)
    the add-half unigram.  Texts become chunks of local codes; words and then
    distinct pairs of a chunk are sent to shards, which add up all training
    counts; each shard of pairs writes its part of the trie (contexts,
    pointers, successors in Elias-Fano levels, quantised log-probabilities)
    and answers each distinct pair once from the memory-mapped files.  A frequent word or
    pair is one entry per chunk, and a frequent context is split by its
    successors, so no shard follows one key.  Null and empty texts are the end
    alone; repeated rows count and score as rows of their own; null ids are
    trained on; other columns are ignored; no rows give no rows."""
    prepare(docs.sparkSession)
    made = keep(chunks(docs, chunk_tokens, held), "lm-chunks")
    n_words = made.agg(F.sum(F.size("words"))).first()[0] or 0
    word_shards = max(8, -(-n_words // SHARD_WORDS))
    words = keep(word_replies(made, word_shards), "lm-words")
    known = words.groupBy("shard").agg(F.max("known").alias("known")).agg(F.sum("known")).first()[0] or 0

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"train": [int(_unzip(c, "<u4").sum()) for c in b["counts"]],
                                "tokens": [int(_unzip(n, "<u4").sum()) for n in b["lengths"]]})

    sums = made.select("counts", "lengths").mapInPandas(measure, "train long, tokens long").agg(
        F.sum("train"), F.sum("tokens")).first()
    train_tokens, tokens = int(sums[0] or 0), int(sums[1] or 0)
    shards = max(8, -(-tokens // shard_pairs))

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c = left.iloc[0]
        number, count = _vocabulary(c["turn"], right)
        codes, length = _unzip(c["codes"], "<u4"), _unzip(c["lengths"], "<u4").astype(int)
        v, w, of, _ = _pairs(codes)
        train = np.repeat(~np.asarray(c["held"], bool), length)
        seen = np.bincount(of[train], minlength=len(v))
        shard = _route(number, count, v, w, shards, context_pairs)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = []
        for s, (a, z) in enumerate(zip(cuts, cuts[1:])):
            if z > a:
                at = order[a:z]
                rows.append((c["chunk"], s, _zip(number[v[at]], "<u8"), _zip(number[w[at]], "<u8"),
                             _zip(seen[at], "<u4"), _zip(count[v[at]], "<u8")))
        return pd.DataFrame(rows, columns=["chunk", "shard", "v", "w", "seen", "context"])

    asked = made.select("chunk", "held", "lengths", "codes", "turn").groupBy("chunk").cogroup(
        words.select("chunk", "shard", "ids", "counts").groupBy("chunk")).applyInPandas(
        send, "chunk long, shard long, v binary, w binary, seen binary, context binary")

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        v, w = (np.concatenate([_unzip(x, "<u8") for x in pdf[k]]) for k in ("v", "w"))
        seen = np.concatenate([_unzip(x, "<u4") for x in pdf["seen"]])
        context = np.concatenate([_unzip(x, "<u8") for x in pdf["context"]])
        cuts = np.cumsum([0, *(len(_unzip(x, "<u4")) for x in pdf["seen"])])
        order = np.lexsort((w, v))
        a, b = v[order], w[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        first = np.flatnonzero(new)
        c = np.add.reduceat(seen[order].astype(np.int64), first)
        some = c > 0
        at = first[some]
        log_q = np.log(c[some] / (context[order[at]].astype(float) + mu))
        with tempfile.TemporaryDirectory() as folder:            # the task's own; gone when it ends
            found = Trie.write(folder, a[at], b[at], log_q).codes_of(a[first], b[first])
        code = np.empty(len(v), np.int64)
        code[order] = found[np.cumsum(new) - 1]
        code = np.where(code > 0, 1 + _alone(context, mu) - code, 0)
        return pd.DataFrame({"chunk": pdf["chunk"], "shard": pdf["shard"],
                             "codes": [_zip(code[i:j], "<u4") for i, j in zip(cuts, cuts[1:])]})

    pairs = asked.groupBy("shard").applyInPandas(answer, "chunk long, shard long, codes binary")

    def finish(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c = left.iloc[0]
        of_words = right[right["kind"] == 0].rename(columns={"a": "ids", "b": "counts"})
        number, count = _vocabulary(c["turn"], of_words)
        codes, length = _unzip(c["codes"], "<u4"), _unzip(c["lengths"], "<u4").astype(int)
        v, w, of, _ = _pairs(codes)
        shard = _route(number, count, v, w, shards, context_pairs)
        code = np.zeros(len(v), np.int64)
        order = np.argsort(shard, kind="stable")[int((shard < 0).sum()):]
        replies = right[right["kind"] == 1].sort_values("shard")
        if len(replies):
            code[order] = np.concatenate([_unzip(x, "<u4") for x in replies["a"]])
            code = np.where(code > 0, 1 + _alone(count[v], mu) - code, 0)
        unigram = (count.astype(float) + 0.5) / (train_tokens + 0.5 * (known + 1))
        p = np.exp(dequantise(code)) + unigram[w] * (mu / (count[v].astype(float) + mu))
        starts = np.cumsum(length) - length
        add = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({"doc_id": pd.array(list(c["ids"]), "Int64"), "held_out": list(c["held"]), "n_tokens": length,
                             "n_known": add((count > 0)[codes].astype(np.int64)), "train_tokens": train_tokens,
                             "base_score": add(np.log10(unigram)[codes]), "score": add(np.log10(p)[of])})

    replies = words.select("chunk", F.lit(0).alias("kind"), "shard", F.col("ids").alias("a"), F.col("counts").alias("b")) \
        .union(pairs.select("chunk", F.lit(1), "shard", "codes", F.lit(None).cast("binary")))
    return made.select("chunk", "ids", "held", "lengths", "codes", "turn").groupBy("chunk").cogroup(
        replies.groupBy("chunk")).applyInPandas(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: scores of all whole documents; held out are the ids whose
    crc32 as text is 1 modulo 5."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), held)
