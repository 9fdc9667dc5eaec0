"""Mixing sources to target weights: fixed-length blocks, multinomial shards, index permutations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from fleetkit.llm.common import keep, prepare, table, with_row_key
from fleetkit.llm.quality_rules import SPACE

#: Words in a block and blocks in an output shard.
BLOCK_WORDS, SHARD_BLOCKS = 64, 65_536
#: A source of fewer words than this many whole blocks is cut into about so many shorter ones.
LEAST_BLOCKS = 64
#: No source is used more often than this.
MOST = 3
WEIGHTS = (1, 2, 3)
#: Sources that are drawn one by one in every shard.  Where there are more, those with fewer blocks in the mix
#: than its URNS-th part are drawn together, as one urn.
URNS = 10_000
#: Rows whose sizes are summed up in one window.
WINDOW_ROWS = 50_000

SLOTS = T.StructType([T.StructField(n, T.LongType()) for n in ("shard", "slot", "sid", "epoch", "block")])


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Share the sum of ``sizes`` by the repeating weights; what is above
    ``most`` times a size is reshared by weight until none is above."""
    n = len(sizes)
    weight = [weights[i % len(weights)] for i in range(n)]
    out, free, rest = [0.0] * n, set(range(n)), float(sum(sizes))
    while free:
        per = rest / sum(weight[i] for i in free)
        over = [i for i in free if per * weight[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = per * weight[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            rest -= out[i]
            free.discard(i)
    return out


def block_length(size: int, block_words: int = BLOCK_WORDS, least: int = LEAST_BLOCKS) -> int:
    """Words in a block of a source of ``size`` words: ``block_words``, or fewer (one at least) where that many
    would not fill ``least`` blocks, so that small sources too come near their targets."""
    return max(1, min(block_words, size // least))


def shard_counts(quota: np.ndarray, shard: int, shard_blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How many slots each source gets in one shard, and how many it had before.

    Multinomial draws given the quotas: the range of shards is halved until one
    is left, and each half's counts are drawn source by source (binomial with
    the source's share of what is open, held to what both halves can take).
    The draws of a range are seeded by the range, so every task that needs them
    makes the same ones and any shard is drawn alone."""
    total = int(quota.sum())
    lo, hi = 0, -(-total // shard_blocks)
    have, before = quota.astype(np.int64).copy(), np.zeros(len(quota), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        need, rest = (mid - lo) * shard_blocks, int(have.sum())
        left = np.zeros_like(have)
        for s in range(len(have)):
            mine = int(have[s])
            if mine and need:
                drawn = int(rng.binomial(need, min(1.0, mine / rest)))
                left[s] = min(max(drawn, need - (rest - mine)), mine, need)
                need -= int(left[s])
            rest -= mine
        if shard < mid:
            have, hi = left, mid
        else:
            before += left
            have, lo = have - left, mid
    return have, before


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at ``index``: four Feistel rounds
    over the next even number of bits, repeated while outside the range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def rounds(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(4):
            z = right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        return left << shift | right

    with np.errstate(over="ignore"):
        out = rounds(index.astype(np.uint64))
        while (bad := out >= n).any():
            out[bad] = rounds(out[bad])
    return out.astype(np.int64)


def slots(spark: SparkSession, blocks: list[int], quotas: list[int], seed: int = 7,
          shard_blocks: int = SHARD_BLOCKS, sids: list[int] | None = None) -> DataFrame:
    """(shard, slot, sid, epoch, block): the mix as block numbers.  The j-th
    slot of a source takes block permutation(j mod its blocks), so each pass
    over a source takes every block once.  ``sids``: the sources' numbers
    (from 0 on if not given)."""
    quota = np.array(quotas, np.int64)
    names = np.arange(len(quota)) if sids is None else np.array(sids, np.int64)
    shards = -(-int(quota.sum()) // shard_blocks) if len(quota) else 0

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                count, before = shard_counts(quota, shard, shard_blocks, seed)
                of = np.repeat(np.arange(len(quota)), count)
                j = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(before, count)
                n = np.array(blocks, np.int64)[of]
                block, epoch = np.zeros(len(of), np.int64), j // np.maximum(n, 1)
                first = np.cumsum(count) - count
                for s in np.flatnonzero(count):
                    # one permutation per source: later passes repeat its order
                    at = slice(first[s], first[s] + count[s])
                    block[at] = permute(j[at] % blocks[s], blocks[s], source_key(seed, int(names[s])))
                order = np.random.default_rng([seed, shard, 1]).permutation(len(of))
                yield pd.DataFrame({"shard": shard, "slot": np.arange(len(of)), "sid": names[of][order],
                                    "epoch": epoch[order], "block": block[order]})

    return spark.range(0, shards, 1, max(1, min(shards, 10_000))).mapInPandas(fill, SLOTS)


def source_key(seed: int, sid: int) -> int:
    """Key of a source's permutation (-1: the urn of the small sources)."""
    return (seed << 40) + sid + 1


def entries(small: DataFrame, seed: int, piece: int = SHARD_BLOCKS) -> DataFrame:
    """``small`` (sid, blocks, quota, first) -> (entry, sid, epoch, block): the
    blocks that the mix takes of each source, numbered from ``first`` on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, size = [], 0
        for b in batches:
            for sid, n, quota, first in zip(*(b[c].tolist() for c in ("sid", "blocks", "quota", "first"))):
                for lo in range(0, quota, piece):
                    j = np.arange(lo, min(quota, lo + piece))
                    ready.append((first + j, np.full(len(j), sid), j // n, permute(j % n, n, source_key(seed, sid))))
                    size += len(j)
                    if size >= piece:
                        yield pd.DataFrame(dict(zip(("entry", "sid", "epoch", "block"), map(np.concatenate, zip(*ready)))))
                        ready, size = [], 0
        if ready:
            yield pd.DataFrame(dict(zip(("entry", "sid", "epoch", "block"), map(np.concatenate, zip(*ready)))))

    return small.select("sid", "blocks", "quota", "first").mapInPandas(run, "entry long, sid long, epoch long, block long")


def numbered(df: DataFrame, order: list, name: str, total: str | None = None) -> DataFrame:
    """``df`` in the given order with sid, the row's number from 0 on, or with
    first, the sum of column ``total`` over the rows before it: sums per
    sorted partition, then inside each."""
    rows = keep(df.orderBy(*order).withColumn("m", F.monotonically_increasing_id()), name)
    part, amount = F.shiftright("m", 33), F.col(total) if total else F.lit(1)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)      # one row per partition
    sums = rows.groupBy(part.alias("part")).agg(F.sum(amount).alias("all"))
    sums = sums.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("part", part).join(sums, "part")
    if total is None:
        return rows.withColumn("sid", F.col("base") + F.col("m").bitwiseAND((1 << 33) - 1)).drop("part", "m", "base")
    inside = W.partitionBy("part").orderBy("m").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("first", F.col("base") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("part", "m", "base")


def source_table(per: DataFrame, weights: tuple[int, ...], most: int, block_words: int) -> DataFrame:
    """``per`` (source, size, n) with sid, target, block_words, blocks and
    quota, as ``targets`` and ``block_length`` have them, without a list on
    the driver: each round of resharing is one sum over the sources."""
    rows = numbered(per, [F.col("source").isNull(), "source"], "mix-ordered")
    kinds = F.array(*[F.lit(w) for w in weights])
    rows = keep(rows.withColumn("weight", F.get(kinds, F.pmod("sid", F.lit(len(weights))).cast("int")))
                .withColumn("most", F.col("size") * most), "mix-numbered")
    level, over = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("most")
        total, taken, free, count = rows.agg(
            F.sum("size"), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)),
            F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, F.lit(1)))).first()
        if not free or count == over:
            break
        level, over = (total - taken) / free, count
    size, n = F.col("size"), F.col("block_words")
    target = F.when(F.lit(not free) | (F.col("weight") * F.lit(level) > F.col("most")), F.col("most").cast("double")).otherwise(
        F.col("weight") * F.lit(level))
    rows = rows.withColumn("target", target).withColumn("block_words", F.greatest(F.lit(1), F.least(
        F.lit(block_words), F.floor(size / LEAST_BLOCKS))))
    rows = rows.withColumn("blocks", F.ceil(size / n))
    quota = F.when(size > 0, F.least(most * F.col("blocks"), F.bround(F.col("target") / size * F.col("blocks")))).otherwise(0)
    return keep(rows.withColumn("quota", quota.cast("long")), "mix-targets")


def slots_of_many(table: DataFrame, seed: int, shard_blocks: int) -> DataFrame:
    """``slots`` for a source_table of any length.  Sources above the URNS-th
    part of the mix, fewer than URNS, are drawn one by one; all others are one
    urn, whose slots are numbered by a permutation of its own and joined to
    the small sources' entries."""
    spark = table.sparkSession
    total = table.agg(F.sum("quota")).first()[0] or 0
    large = F.col("quota") * URNS > total
    big = table.where(large).select("sid", "blocks", "quota").orderBy("sid").collect()
    rest = total - sum(r["quota"] for r in big)
    made = keep(slots(spark, [*(r["blocks"] for r in big), rest], [*(r["quota"] for r in big), rest], seed, shard_blocks,
                      [*(r["sid"] for r in big), -1]), "mix-slots")
    small = numbered(table.where(~large & (F.col("quota") > 0)), ["sid"], "mix-small", "quota")
    found = entries(small, seed).withColumnRenamed("entry", "e").hint("merge")
    own = made.where("sid = -1").select("shard", "slot", F.col("block").alias("e")).hint("merge")
    return made.where("sid >= 0").union(own.join(found, "e").select("shard", "slot", "sid", "epoch", "block"))


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source) -> rid (row number), doc_id, source, size (words), key (hash of the text)."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda x: x != "")
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       "source", F.size(words).cast("long").alias("size"), F.xxhash64("text").alias("key"))


def mix(rows: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 7,
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Mix written ``rows`` (rid, doc_id, source, size, key) to their target weights.

    Returns the sources (source, sid, source_size, target) and the mix as
    spans: (shard, slot, epoch, rid, start, words), ``words`` words of row rid
    from its word ``start`` on.  A source's documents, in the order of a hash of
    doc_id and key (so rows without an id, or with a repeated one, spread over the
    windows like others), form one stream of words, cut into blocks of
    ``block_length`` words; documents without words take no part.
    Sources are ordered by code point, null last; any number of them is taken (at most URNS are listed and
    broadcast, see slots_of_many for more).  Sizes are summed in windows
    of about WINDOW_ROWS rows per source and then over those windows, so no
    source is ever in one task.  An empty table gives no spans."""
    spark = rows.sparkSession
    prepare(spark)
    per = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    found = per.limit(URNS + 1).collect()
    columns = ["source", "sid", "source_size", "target", "block_words"]
    if len(found) > URNS:
        each = source_table(per, weights, most, block_words)
        made, n = slots_of_many(each, seed, shard_blocks), each.agg(F.sum("n")).first()[0]
        sources = each.withColumnRenamed("size", "source_size").select(columns)
    else:
        found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
        size = [int(r["size"]) for r in found]
        want = targets(size, weights, most)
        length = [block_length(s, block_words) for s in size]
        blocks = [-(-s // k) for s, k in zip(size, length)]
        quota = [min(most * b, round(w / s * b)) if s else 0 for w, s, b in zip(want, size, blocks)]
        made, n = slots(spark, blocks, quota, seed, shard_blocks), sum(r["n"] for r in found)
        sources = F.broadcast(spark.createDataFrame(
            [(r["source"], k, *x) for k, (r, *x) in enumerate(zip(found, size, want, length))],
            "source string, sid long, source_size long, target double, block_words long"))
    parts = max(1, -(-n // WINDOW_ROWS))
    placed = (rows.where("size > 0").join(sources.select(F.col("source").alias("s"), "sid", "block_words"),
                                          F.col("source").eqNullSafe(F.col("s")))
              .select("sid", "block_words", "rid", "doc_id", "size", "key", F.xxhash64("doc_id", "key", F.lit(seed)).alias("h"))
              .withColumn("part", F.pmod("h", F.lit(parts))))
    w = W.partitionBy("sid", "part").orderBy("h", "doc_id", "key", "size", "rid")
    placed = placed.withColumn("end", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)))
    sums = placed.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("offset", F.sum("words").over(
        W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).drop("words")
    placed = placed.join(sums, ["sid", "part"]).select(
        "sid", "block_words", "rid", (F.col("offset") + F.col("end")).alias("end"), "size")
    start, end, b = F.col("end") - F.col("size"), F.col("end"), F.col("block_words")
    cut = placed.select("sid", "block_words", "rid", start.alias("from"), "end", F.explode(F.sequence(
        F.floor(start / b), F.floor((end - 1) / b))).alias("block"))
    lo, hi = F.greatest(F.col("from"), F.col("block") * b), F.least(F.col("end"), (F.col("block") + 1) * b)
    cut = cut.select("sid", "block", "rid", (lo - F.col("from")).alias("start"), (hi - lo).alias("words"))
    # the sizes of generated rows are guessed far too low for a broadcast to be safe
    return sources, made.hint("merge").join(cut.hint("merge"), ["sid", "block"]).select("shard", "slot", "epoch", "rid", "start", "words")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents (doc_id, text, lang, source, n_chars): one row per
    document and pass over its source, with the words that the pass takes (the
    text itself, unchanged, if it takes all of them).  Documents without words
    have nothing to take.  Other columns are ignored."""
    prepare(docs.sparkSession)
    rows = with_row_key(docs, ["doc_id", "text", "lang", "source"], "mix-texts")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda x: x != "")
    measured = keep(rows.select("rid", "doc_id", "source", F.size(words).cast("long").alias("size"),
                                F.xxhash64("text").alias("key")), "mix-rows")
    _, spans = mix(measured, **options)
    taken = spans.groupBy("rid", "epoch").agg(F.sort_array(F.collect_list(F.struct(
        F.col("start").cast("int").alias("start"), F.col("words").cast("int").alias("n")))).alias("spans"))
    whole = F.aggregate("spans", F.lit(0), lambda a, s: a + s["n"])
    cut = F.flatten(F.transform("spans", lambda s: F.slice(F.col("w"), s["start"] + 1, s["n"])))
    return (rows.join(taken, "rid").withColumn("w", words)     # words are cut after the shuffle
            .select("doc_id", F.when(whole == F.size("w"), F.col("text")).otherwise(F.array_join(cut, " "))
                    .alias("text"), "lang", "source")
            .withColumn("n_chars", F.length("text").cast("long")))


def usage(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source,
    size, source_size, target and taken (words the mix takes, repeats counted).
    Null texts have size 0; a null source is a source, the last; repeated rows
    are documents of their own; other columns are ignored."""
    prepare(docs.sparkSession)
    rows = keep(sized(docs), "mix-rows")
    sources, spans = mix(rows, **options)
    taken = spans.groupBy("rid").agg(F.sum("words").alias("taken"))
    named = sources.withColumnRenamed("source", "s").drop("block_words")
    return (rows.join(named, F.col("source").eqNullSafe(F.col("s"))).join(taken, "rid", "left")
            .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: what the mix of all documents takes of each."""
    return usage(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
