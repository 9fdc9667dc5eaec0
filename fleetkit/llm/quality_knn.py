"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text has two latent-semantic vectors: one of its hashed words, one of the shapes of its words (letter case,
digits, signs) with how often words repeat.  Each is idf-weighted, projected on the leading axes of a truncated SVD
over the labelled rows, and brought to unit length; joined with a weight between them they are one vector, whose cosine
votes.  The weight is the one that predicts the labelled rows best from their other neighbours."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit.llm.common import prepare, release, table

#: Hashed shapes and words, latent dimensions of each, neighbours that vote, votes the base rate counts for.
TERMS, WORDS, DIMENSIONS, NEIGHBOURS, PRIOR = 1024, 1 << 15, 32, 25, 1.0
#: Shares of the words in the cosine that are tried: words and shapes always both count.
SHARES = (0.2, 0.4, 0.6, 0.8)
#: Labelled documents the model is fitted on and votes with, at most (by hash).
FIT_ROWS = 4000
#: Documents whose cosines are computed together.
BLOCK = 256
CACHE = 150_000
REPEATED, SEEN = TERMS - 1, TERMS - 2
LETTERS, DIGITS, SAME = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(\W)\1+")


def shape(word: str) -> str:
    """The word with letters as x, Xx or X, digits as 9 and repeated signs as one and a +."""
    kind = lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "Xx" if m[0][0].isupper() else "x"
    return SAME.sub(r"\1+", DIGITS.sub("9", LETTERS.sub(kind, word)))[:32]


class Terms(dict):
    """Word -> hashed term of its shape and, times TERMS, of its small letters; forgets when it has CACHE words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = term = crc32(shape(word).encode()) % SEEN + TERMS * (crc32(word.lower().encode()) % WORDS)
        return term


#: Rates of a text: of shapes (all of them), of words (their terms, their rates).
Rates = tuple[np.ndarray, np.ndarray, np.ndarray]


def term_rates(text: str | None, terms: Terms) -> Rates:
    """Square roots of the rates of a text's terms: shapes of its words, words
    that repeat the one before, words seen before; and its words.  No words: zeros."""
    words = text.split() if text else []
    if not words:
        return np.zeros(TERMS, np.float32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    count = Counter(words)
    both = np.fromiter((terms[w] for w in count), np.int64, len(count))
    n = np.fromiter(count.values(), np.int64, len(count))
    out = np.bincount(both % TERMS, n, TERMS)
    out[REPEATED] = sum(map(eq, words, words[1:]))
    out[SEEN] = len(words) - len(count)
    return np.sqrt(out / len(words)).astype(np.float32), (both // TERMS).astype(np.int32), np.sqrt(n / len(words)).astype(np.float32)


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


@dataclass
class Voters:
    """Labelled latent vectors (rows of unit length) and how texts get there."""

    idf: np.ndarray
    axes: np.ndarray
    word_idf: np.ndarray
    word_axes: np.ndarray
    share: float
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, rates: list[Rates]) -> np.ndarray:
        """Shapes and words side by side, so that a cosine is (1 - share) x that of shapes + share x that of words."""
        shapes = np.array([r[0] for r in rates], np.float32).reshape(-1, TERMS)
        words = np.array([(v * self.word_idf[t]) @ self.word_axes[t] for _, t, v in rates], np.float32).reshape(-1, DIMENSIONS)
        return np.hstack([np.sqrt(1 - self.share) * _unit((shapes * self.idf) @ self.axes),
                          np.sqrt(self.share) * _unit(words)]).astype(np.float32)

    def vote(self, cosine: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest neighbours (ties with the last one
        vote too), drawn to the base rate; ``spare`` rows do not vote for themselves."""
        base, k = float(self.labels.mean()), min(NEIGHBOURS, len(self.labels))
        if spare is not None:
            cosine[np.arange(len(cosine)), spare] = -1
        last = np.partition(cosine, -k, axis=1)[:, -k][:, None]
        vote = np.where(cosine >= last, np.maximum(cosine, 0), 0).astype(np.float64) ** 8
        return (vote @ self.labels + PRIOR * base) / (vote.sum(1) + PRIOR)

    def score(self, rates: list[Rates]) -> np.ndarray:
        """Score of each text: its vote; without labelled rows 0.5."""
        out = np.full(len(rates), 0.5)
        for lo in range(0, len(rates) if len(self.labels) else 0, BLOCK):
            out[lo:lo + BLOCK] = self.vote(self.latent(rates[lo:lo + BLOCK]) @ self.vectors.T)
        return np.clip(out, 0, 1)


def word_axes(rates: list[Rates], idf: np.ndarray, seed: int = 1, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors of the idf-weighted word rates (randomised subspace iteration over the sparse rows)."""
    row = np.repeat(np.arange(len(rates)), [len(t) for _, t, _ in rates])
    term = np.concatenate([t for _, t, _ in rates]) if len(rates) else np.zeros(0, np.int32)
    value = (np.concatenate([v for *_, v in rates]) * idf[term]).astype(np.float32) if len(rates) else np.zeros(0, np.float32)
    by_term = np.argsort(term, kind="stable")

    def product(at: np.ndarray, other: np.ndarray, weight: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
        """Sums of weight x m[other] per ``at`` (ascending)."""
        out = np.zeros((n, m.shape[1]), np.float32)
        for lo in range(0, len(at), 200_000):
            a = at[lo:lo + 200_000]
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            out[a[first]] += np.add.reduceat(m[other[lo:lo + 200_000]] * weight[lo:lo + 200_000, None], first)
        return out

    q = np.random.default_rng(seed).normal(size=(WORDS, DIMENSIONS + 8)).astype(np.float32)
    if len(term):
        for _ in range(rounds):
            y = np.linalg.qr(product(row, term, value, q, len(rates)))[0]
            q, r = np.linalg.qr(product(term[by_term], row[by_term], value[by_term], y, WORDS))
        q = q @ np.linalg.svd(r)[0]
    out = np.zeros((WORDS, DIMENSIONS), np.float32)              # fewer rows than axes: the rest stays empty
    out[:, :min(DIMENSIONS, q.shape[1])] = q[:, :DIMENSIONS]
    return out


def fit(rates: list[Rates], labels: np.ndarray) -> Voters:
    """Latent axes of the idf-weighted rates, the labelled vectors on them, and the share of the words: the
    one of SHARES whose leave-one-out votes have the least log loss."""
    shapes = np.array([r[0] for r in rates], np.float32).reshape(-1, TERMS)
    idf = np.log((1 + len(rates)) / (1 + (shapes > 0).sum(0))) + 1
    weighted = shapes.astype(np.float64) * idf
    _, axes = np.linalg.eigh(weighted.T @ weighted)
    held = np.bincount(np.concatenate([np.unique(t) for _, t, _ in rates]), minlength=WORDS) if len(rates) else np.zeros(WORDS)
    word_idf = (np.log((1 + len(rates)) / (1 + held)) + 1).astype(np.float32)
    out = Voters(idf.astype(np.float32), np.ascontiguousarray(axes[:, ::-1][:, :DIMENSIONS], np.float32), word_idf,
                 word_axes(rates, word_idf), 0.5, np.zeros((0, 2 * DIMENSIONS), np.float32), labels.astype(np.float64))
    if not len(rates):
        return out
    both = out.latent(rates) * np.float32(np.sqrt(2))
    loss = {}
    for share in SHARES:
        z = both * np.repeat(np.sqrt([1 - share, share]), DIMENSIONS).astype(np.float32)
        p = np.concatenate([out.vote(z[lo:lo + BLOCK] @ z.T, np.arange(lo, min(lo + BLOCK, len(z)))) for lo in range(0, len(z), BLOCK)])
        p = np.clip(p, 1e-3, 1 - 1e-3)
        loss[share] = -np.mean(out.labels * np.log(p) + (1 - out.labels) * np.log(1 - p))
    best = replace(out, share=min(loss, key=loss.get))
    best.vectors = best.latent(rates)
    return best


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = 3) -> Voters:
    """Voters from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0..1).
    Repeated labels of a document are averaged, null ones ignored; the ``rows``
    documents with the least hash of their id are used."""
    known = (labels.where("doc_id is not null and label is not null")
             .groupBy("doc_id").agg(F.avg("label").alias("label"))
             .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"],
                                "rates": [[x.tobytes() for x in term_rates(t, terms)] for t in b["text"]]})

    picked = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")
              .mapInPandas(vectors, "doc_id long, label double, rates array<binary>")
              .groupBy("doc_id").agg(F.min("label").alias("label"), F.min("rates").alias("rates"))
              .orderBy("doc_id").collect())                              # `rows` rows at most
    kinds = (np.float32, np.int32, np.float32)
    rates = [tuple(np.frombuffer(x, k) for x, k in zip(r["rates"], kinds)) for r in picked]
    return fit(rates, np.array([r["label"] for r in picked], np.float64))


def scored(docs: DataFrame, voters: Voters, column: str = "score") -> DataFrame:
    """``docs`` with the score of column text; whole texts are read.  Null,
    empty and blank texts get the base rate of the labels."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        for batch in texts:
            parts = [voters.score([term_rates(t, terms) for t in batch.iloc[lo:lo + BLOCK]]) for lo in range(0, len(batch), BLOCK)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
        terms.clear()
        release()

    return docs.withColumn(column, score("text"))


def fold(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null ids: null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.7, **options) -> DataFrame:
    """``docs`` (doc_id, text, ...) with held_out, score and predicted (score >=
    ``cut``).  Learns from ``labels`` (doc_id, quality) outside the held-out
    fold.  Repeated rows score alike; null ids are never held out."""
    prepare(docs.sparkSession)
    known = labels.where(fold("doc_id", 4) != 2).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    out = scored(docs, train(docs, known, **options))
    return out.withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False))).withColumn(
        "predicted", (F.col("score") >= cut).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: quality score of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", "predicted")
