"""SimHash near-duplicate detection by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit.llm.common import components, keep, prepare, release, table

BITS = 64
#: Hash seed of the contract.
SEED = 42
#: Words hashed at a time, so a very long text needs bounded memory.
SLICE = 1 << 18
#: Largest bucket whose pairs are verified one by one; larger ones go through centres.
BUCKET_PAIRS = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is set if over half of the shingles' XXH64 have it.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+`` (what bytes.split()
    cuts), shingles keep repeats.  Fewer words than a shingle: the whole
    sequence is the only shingle.  No word, or null: 0."""
    import xxhash

    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones, total = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for start in range(0, total, SLICE):
        part = words[start:min(start + SLICE, total) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        digest = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
        bits = np.unpackbits(digest.astype("<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` (text, ...) with fp, the fingerprint as a signed long, instead of the text."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64))
        release()

    return docs.withColumn("fp", fp("text")).drop("text")


# -- plan: bit groups and thresholds ---------------------------------------------------------

def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 matrix of how many have both bits
    set, over all of them; one partial matrix leaves each task."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy().astype("<i8").view(np.uint8), bitorder="little")
            bits = bits.reshape(-1, BITS).astype(np.float32)
            both, n = both + bits.T @ bits, n + len(bits)
        i, j = np.triu_indices(BITS)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1),
                            "n": np.append(both[i, j], n).astype(np.int64)})

    rows = (fps.select("fp").mapInPandas(partial, "i int, j int, n long")
            .groupBy("i", "j").agg(F.sum("n").alias("n")).collect())        # 2,081 rows at most
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            n = int(r["n"])
        else:
            both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    return n, both


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Split the bits into ``m`` groups of nearly equal width, greedily putting
    bits together that agree (or disagree) most often."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        group = [max(free, key=lambda b: corr[b, free].sum())]
        while len(group) < width:
            rest = [b for b in free if b not in group]
            group.append(max(rest, key=lambda b: corr[b, group].sum()))
        free = [b for b in free if b not in group]
        groups.append(sorted(group))
    return groups


def projected(group: list[int]):
    """The bits of one group of column fp, the others cleared."""
    mask = sum(1 << b for b in group)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 that sum to ``total`` at least cost, by dynamic
    programming over the groups; ``costs[i][t + 1]`` is group i's cost at t."""
    best = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, extra in enumerate(row, -1):
                if s + t not in nxt or c + extra < nxt[s + t][0]:
                    nxt[s + t] = (c + extra, [*ts, t])
        best = nxt
    return best[total]


def plan(fps: DataFrame, distance: int, group_counts: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """Bit groups with their thresholds.

    By the general pigeonhole principle two fingerprints within ``distance``
    agree within t_i bits in some group i, if the t_i sum to distance - m + 1
    (t_i = -1 skips a group).  Candidates at t = 0 are counted over all
    fingerprints (sum of squared bucket sizes); at t > 0 they are estimated
    from the bits' rates.  The plan with the least estimated work is taken; the
    choice changes the work, never the links."""
    n, both = bit_statistics(fps)
    options = {m: correlated_groups(n, both, m) for m in group_counts if m <= distance + 1 or m <= BITS}
    keyed = [F.struct(F.lit(f"{m}.{i}").alias("g"), projected(g).alias("v"))
             for m, groups in options.items() for i, g in enumerate(groups)]
    pairs = {r["g"]: float(r["pairs"]) for r in
             fps.select(F.explode(F.array(*keyed)).alias("k")).groupBy("k.g", "k.v").count()
             .groupBy("g").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()}
    rate = np.diag(both) / max(n, 1)
    differ = 2 * rate * (1 - rate)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m, groups in options.items():
        costs = []
        for i, g in enumerate(groups):
            odds = float((differ[g] / np.maximum(1 - differ[g], 0.5)).sum())
            row, ball, seen = [0.0], 0.0, 0.0
            for t in range(distance + 1):
                ball += float(np.prod([(len(g) - k) / (k + 1) for k in range(t)]))
                seen += pairs.get(f"{m}.{i}", 0.0) * float(np.prod([odds / (k + 1) for k in range(t)]))
                row.append(n * ball + seen if t <= 1 else float("inf"))   # probes stay shallow
            costs.append(row)
        if (made := allocate(costs, distance - m + 1))[0] < (best or (float("inf"),))[0]:
            best = (made[0], list(zip(groups, made[1])))
    return best[1]


# -- probe and verify ------------------------------------------------------------------------

def _buckets(fps: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(g, v, fp, member): every fingerprint in its own bucket of each used
    group, and as a prober in the buckets one bit away where t = 1."""
    keys = []
    for i, (group, t) in enumerate(chosen):
        if t < 0:
            continue
        own = projected(group)
        keys.append(F.struct(F.lit(i).alias("g"), own.alias("v"), F.lit(True).alias("member")))
        if t == 1:
            keys += [F.struct(F.lit(i).alias("g"), own.bitwiseXOR(F.lit(_bit(b))).alias("v"),
                              F.lit(False).alias("member")) for b in group]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.g", "k.v", "fp", "k.member")


def _bit(b: int) -> int:
    return (1 << b) - (1 << 64) if b == 63 else 1 << b


def links(fps: DataFrame, distance: int, chosen: list[tuple[list[int], int]],
          bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Verified links (a, b) that connect every pair of distinct fingerprints
    at ``distance`` or fewer differing bits.

    Buckets of up to ``bucket_pairs`` rows are verified pair by pair.  A larger
    bucket never emits its pairs: its fingerprints go through *centres*
    instead.  Two fingerprints are within 2r bits exactly if some centre is
    within r bits of both (odd distances: r+1 and r, by flipping one side), so
    sharing a centre replaces the pair and costs a fixed number of rows each."""
    keyed = _buckets(fps, chosen)
    sizes = keyed.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"), F.count_if("member").alias("m"))
    sized = keep(keyed.join(sizes.where("n > 1 and m > 0"), ["g", "v"]), "simhash-buckets")
    cold = (sized.where(F.col("n") <= bucket_pairs).groupBy("g", "v")
            .agg(F.collect_list("fp").alias("fps"), F.collect_list("member").alias("members")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = [], []
            for xs, ms in zip(batch["fps"], batch["members"]):
                x, m = np.asarray(xs, np.int64), np.asarray(ms, bool)
                i, j = np.triu_indices(len(x), 1)
                near = (np.bitwise_count((x[i] ^ x[j]).view(np.uint64)) <= distance) & (m[i] | m[j])
                left.append(x[i[near]])
                right.append(x[j[near]])
            yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    pairs = cold.select("fps", "members").mapInPandas(verify, "a long, b long")
    hot = sized.where(F.col("n") > bucket_pairs).select("fp").distinct()
    return pairs.where("a <> b").union(_through_centres(hot, distance))


def _through_centres(hot: DataFrame, distance: int) -> DataFrame:
    """Links among ``hot`` fingerprints: star edges of everyone who shares a centre."""
    if distance > 2:
        # centres within ``up`` bits of one side and ``down`` of the other: everyone around a centre is linked
        # with the least fingerprint near it
        up, down = -(-distance // 2), distance // 2
        step = F.array(F.lit(0).cast("long"), *(F.lit(_bit(b)) for b in range(BITS)))
        around = hot.select("fp", F.col("fp").alias("c"))
        for _ in range(up):
            around = around.select("fp", "c", F.explode(step).alias("flip")).select(
                "fp", F.col("c").bitwiseXOR(F.col("flip")).alias("c")).distinct()
        close = F.bit_count(F.col("fp").bitwiseXOR(F.col("c"))) <= down
        met = around.groupBy("c").agg(F.min(F.when(close, F.col("fp"))).alias("a"), F.collect_set("fp").alias("fps"))
        return met.where("a is not null").select("a", F.explode("fps").alias("b")).where("a <> b").distinct()
    if distance == 0:
        return hot.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    flips = [F.lit(0).cast("long"), *(F.lit(_bit(b)) for b in range(BITS))]
    near = hot.select("fp", F.explode(F.array(*flips)).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("c"))
    if distance == 1:                       # the centre itself must be one of the two
        return near.join(hot.select(F.col("fp").alias("c")), "c", "left_semi").select(
            F.col("fp").alias("a"), F.col("c").alias("b"))
    # a centre has at most 65 fingerprints around it
    met = near.groupBy("c").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2,
                   bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id long, text string).

    Returns one row per input row: doc_id, fingerprint (16 lowercase hex
    digits), component_id (smallest doc_id reachable over links of at most
    ``distance`` differing bits, itself included).  Null, empty and blank texts
    have fingerprint zero and are linked like any other; a null doc_id is
    grouped but never names a group; repeated rows stay repeated; other columns
    are ignored.  Empty input: no rows.  Exact copies are one fingerprint from
    the first step on, so a large group of copies costs one row."""
    prepare(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = keep(with_fingerprint(ids, shingle), "simhash-docs")
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("head"))
    groups = rooted(fps, distance, bucket_pairs)
    heads = groups.groupBy("root").agg(F.min("head").alias("component_id"))
    return marked.join(groups.join(heads, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def rooted(fps: DataFrame, distance: int = 2, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Distinct fingerprints (fp, ...) with root, the same for all of a component."""
    fps = keep(fps, "simhash-fps")
    if fps.isEmpty():
        return fps.withColumn("root", F.col("fp"))
    found = components(links(fps, distance, plan(fps, distance), bucket_pairs))
    return fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: SimHash groups of all whole documents, 3-word shingles, 2 bits."""
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 2)
