"""Quality rules: robust multivariate outliers among document statistics.

Everything here is DataFrame functions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetkit.llm.common import keep, prepare, table

SPACE = r"[\x20\x09-\x0D]+"
#: Transformed statistics with the spread that stands in for a group's own where
#: that is smaller, so that one odd character rejects nothing.  From a center of
#: 0, symbols and marks reject alone beyond 2% of the characters, duplicate
#: lines and repeated words beyond 20%.
STATISTICS = {"word_length": 0.01, "symbols": 0.208, "dup_lines": 0.208, "repeats": 0.088, "capitals": 0.05,
              "marks": 0.208}
P = len(STATISTICS)
# Quantiles of the chi-squared distribution with 6 degrees of freedom.
CHI2_CUT = 27.856                             # 0.9999
#: Medians of the chi-squared distribution with 1 to 6 degrees of freedom.
CHI2_HALF = [0.455, 1.386, 2.366, 3.357, 4.351, 5.348]
#: Resolution of the quantiles of ln(1 + squared distance).
STEP = 0.002


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, first ones included."""

    def windows(w: Column) -> Column:
        n = F.greatest(F.size(w) - 2, F.lit(0))
        return F.sort_array(F.transform(F.slice(w, F.lit(1), n), lambda x, i: F.struct(
            F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def again(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    return _let(words, lambda w: _let(windows(w), lambda s: _let(again(s), covered))).cast("long")


def base_statistics(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source) with counts over
    the whole text: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, and what the method needs beside them."""
    only = lambda chars: F.length(F.regexp_replace("text", f"[^{chars}]+", "")).cast("long")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source",
                      F.coalesce("text", F.lit("")).alias("text"))
    out = out.select(
        "doc_id", "lang", "source",
        _let(F.filter(F.split("text", SPACE), lambda x: x != ""), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        only(r"#*$%&|<>").alias("n_symbols"), only("A-Z").alias("n_capitals"), only("!?").alias("n_marks"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long")
                                       .alias("dup"))).alias("lines"))
    n, again = F.col("w.n_words"), F.col("w.n_repeat_words")
    return out.select(
        "doc_id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"), again.alias("n_repeat_words"),
        ((n < 50) | (100 * again > 50 * n)).alias("base_failed"),
        F.col("lines.n").alias("n_lines"), "n_capitals", "n_marks")


def _vector() -> Column:
    """The transformed statistics: logarithms of lengths and rates, a square-root arcsine of the share."""
    rate = lambda c, of, per=100: F.log1p(per * F.col(c) / F.greatest(F.col(of), F.lit(1)))
    share = F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1))
    return F.array(F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
                   rate("n_symbols", "word_chars"), rate("n_dup_lines", "n_lines", 10),
                   F.asin(F.sqrt(F.least(share, F.lit(1.0)))), rate("n_capitals", "word_chars"),
                   rate("n_marks", "word_chars"))


def _quantile(df: DataFrame, key: list[str], value: Column, q: float) -> DataFrame:
    """The q-quantile of ``value`` per key, exact to STEP: counts per step are
    combined before the shuffle, so a hot key is a few thousand rows."""
    bins = df.groupBy(*key, F.floor(value / STEP).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*key)
    ranked = bins.withColumn("below", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return (ranked.where(F.col("below") >= F.ceil(q * F.col("all"))).groupBy(*key)
            .agg(((F.min("bin") + 1) * STEP).alias("q")))


def _inverse(matrix: Column) -> Column:
    """Inverse of a positive definite matrix (array of arrays), by sweeping each pivot."""

    def sweep(m: Column, k: Column) -> Column:
        d = m[k][k]
        return F.transform(m, lambda row, i: F.transform(row, lambda x, j: F.when(
            (i == k) & (j == k), -1 / d).when((i == k) | (j == k), x / d).otherwise(x - m[i][k] * m[k][j] / d)))

    swept = F.aggregate(F.sequence(F.lit(0), F.lit(P - 1)), matrix, sweep)
    return F.transform(swept, lambda row: F.transform(row, lambda x: -x))


def _floored(cov: Column) -> Column:
    """Inverse of a covariance whose variances are raised to the least spreads where they are smaller."""
    least = F.array(*[F.lit(v * v) for v in STATISTICS.values()])
    return _inverse(F.transform(cov, lambda row, i: F.transform(row, lambda x, j: F.when(
        i == j, F.greatest(x, least[i])).otherwise(x))))


def _estimate(df: DataFrame) -> DataFrame:
    """Per group: center, covariance and its inverse (see _floored) of the given rows."""
    x = [F.col("x")[i] for i in range(P)]
    sums = [F.avg(x[i]).alias(f"m{i}") for i in range(P)]
    sums += [F.avg(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i, P)]
    cov = [[F.col(f"s{min(i, j)}_{max(i, j)}") - F.col(f"m{i}") * F.col(f"m{j}") for j in range(P)] for i in range(P)]
    return df.groupBy("g").agg(*sums).select(
        "g", F.array(*[f"m{i}" for i in range(P)]).alias("center"), F.array(*[F.array(*r) for r in cov]).alias("cov")
    ).withColumn("inverse", _floored(F.col("cov")))


def _distance(df: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds ln(1 + squared Mahalanobis distance) as d."""
    z = [F.col("x")[i] - F.col("center")[i] for i in range(P)]
    d2 = sum((1 if i == j else 2) * z[i] * z[j] * F.col("inverse")[i][j] for i in range(P) for j in range(i, P))
    return df.join(estimate, "g").withColumn("d", F.log1p(F.greatest(d2, F.lit(0.0)))).drop("center", "cov", "inverse")


def outliers(stats: DataFrame, share: float = 0.75, steps: int = 4, least: int = 100,
             cut: float = CHI2_CUT) -> DataFrame:
    """``stats`` (of base_statistics) plus distance2 and kept.

    Per language and source the minimum-covariance-determinant estimate is
    sought over the documents that pass the base rules: start from the
    ``share`` nearest to the medians, then ``steps`` concentration steps (mean
    and covariance of the nearest ``share``, distances anew).  The covariance
    is scaled, up or down, so that the median distance is that of the
    chi-squared distribution over the statistics that vary in the group (more
    than the least spreads); then only the others get the least spread.  A
    document beyond the 0.9999 quantile over all statistics is rejected.  Groups of fewer than
    ``least`` documents use their language's estimate, languages of fewer all
    documents'.  Null languages and sources are groups of their own.  Medians
    and shares come from counts per fixed step, covariances from sums, both
    combined before they are shuffled."""
    marked = stats.withColumn("x", _vector()).withColumn("by_lang", F.to_json(F.struct("lang"))) \
        .withColumn("by_both", F.to_json(F.struct("lang", "source")))
    sound = marked.where(~F.col("base_failed"))
    of = lambda key: sound.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{key}"))
    marked = marked.join(of("by_both"), "by_both", "left").join(of("by_lang"), "by_lang", "left").withColumn(
        "g", F.when(F.col("n_by_both") >= least, F.col("by_both"))
        .when(F.col("n_by_lang") >= least, F.col("by_lang")).otherwise(F.lit("all")))
    marked = keep(marked.drop("by_both", "by_lang", "n_by_both", "n_by_lang"), "rules-vectors")
    # a document also counts for the wider groups that small groups fall back to
    levels = [F.lit("all"), F.to_json(F.struct("lang")), F.to_json(F.struct("lang", "source"))]
    used = marked.select("g").distinct()
    sound = keep(marked.where(~F.col("base_failed")).select("x", F.explode(F.array(*levels)).alias("g"))
                 .join(used, "g", "left_semi"), "rules-sound")

    each = sound.select("g", F.posexplode("x").alias("i", "v"))
    median = _quantile(each, ["g", "i"], F.col("v"), 0.5)
    spread = _quantile(each.join(median, ["g", "i"]), ["g", "i"], F.abs(F.col("v") - F.col("q")), 0.5)
    floors = F.array(*[F.lit(v) for v in STATISTICS.values()])
    start = (median.join(spread.withColumnRenamed("q", "mad"), ["g", "i"])
             .withColumn("s", F.greatest(1.4826 * F.col("mad"), floors[F.col("i")]))
             .groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "q", "s"))).alias("e")))
    estimate = keep(start.select(
        "g", F.transform("e", lambda e: e["q"]).alias("center"),
        F.transform("e", lambda e, i: F.transform(F.sequence(F.lit(0), F.lit(P - 1)), lambda j: F.when(
            i == j, 1 / (e["s"] * e["s"])).otherwise(F.lit(0.0)))).alias("inverse")), "rules-start")
    for _ in range(steps):
        near = _distance(sound, estimate)
        limit = _quantile(near, ["g"], F.col("d"), share)
        estimate = keep(_estimate(near.join(limit, "g").where(F.col("d") <= F.col("q"))), "rules-step")
    near = _distance(sound, estimate)
    cov = F.col("cov")
    varying = sum((cov[i][i] > v * v).cast("int") for i, v in enumerate(STATISTICS.values()))
    half = F.array(*[F.lit(v) for v in CHI2_HALF])
    middle = _quantile(near, ["g"], F.col("d"), 0.5).withColumnRenamed("q", "middle")
    final = estimate.join(middle, "g").withColumn("varying", varying).withColumn(
        "scale", F.when(F.col("varying") > 0, F.expm1("middle") / F.get(half, F.col("varying") - 1)).otherwise(F.lit(1.0)))
    final = keep(final.select("g", "center", _floored(F.transform(cov, lambda row: F.transform(
        row, lambda x: x * F.col("scale")))).alias("inverse")), "rules-final")
    left = marked.join(final, "g", "left")
    z = [F.col("x")[i] - F.col("center")[i] for i in range(P)]
    d2 = sum((1 if i == j else 2) * z[i] * z[j] * F.col("inverse")[i][j] for i in range(P) for j in range(i, P))
    return (left.withColumn("distance2", d2)
            .withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cut))
            .drop("x", "g", "center", "inverse"))


def judge(docs: DataFrame, **options) -> DataFrame:
    """Base counts, distance and verdict of every row of ``docs`` (doc_id, text,
    lang, source).  Null texts count as empty and fail the base rules; repeated
    rows are judged alike; other columns are ignored; no rows give no rows."""
    prepare(docs.sparkSession)
    return outliers(keep(base_statistics(docs), "rules-stats"), **options)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdict of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", "distance2")
