"""Secret scan: fixed patterns, and a battery of randomness tests on token-like runs.

Everything here is DataFrame functions; no Python runs on the executors."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetkit.llm.common import keep, prepare, table, with_row_key

# The base patterns of the contract.  A maximal run of the last
# two is a match only from its least length on, so the length is in the pattern.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
ASSIGN_LEAST = 6
KINDS = [*PATTERNS, "random"]
#: Parts of the assign keywords, to skip texts without one before the pattern runs.
KEYWORDS = ("passw", "secret", "token", "api")
#: Token-like runs that the battery tests.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
# Alphabets of the encodings, in the order they are tried.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Digits alone are no encoding: order, card and invoice numbers are as random as a secret of that length.
ENCODINGS = {"hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "lower": LOWER, "upper": UPPER,
             "base32": UPPER + "234567", "base36": LOWER + DIGITS, "BASE36": UPPER + DIGITS,
             "base62": UPPER + LOWER + DIGITS}
#: Signs of base64 (+ / or - _) and its padding: at their places nothing is tested.
SIGNS = r"[+/_=-]+"
#: The text alternative.  Chances of the class (digit, small, capital letter) after each class:
NEXT = [[0.8, 0.1, 0.1], [0.04, 0.84, 0.12], [0.04, 0.5, 0.46]]
#: letters a to z in texts of Latin script, percent:
FREQUENCY = [8.0, 1.6, 3.2, 4.0, 14.0, 1.8, 2.1, 3.8, 7.4, 0.35, 0.7, 4.4, 2.6, 7.4, 6.8, 2.4, 0.4, 6.6, 6.9, 7.6, 3.6,
             1.3, 1.4, 0.25, 1.3, 0.6]
#: chance of a vowel after a consonant and after a vowel:
VOWELS, VOWEL_NEXT = "aeiouy", (0.52, 0.15)
#: chances that a digit is the one before or its neighbour, a zero, or any.
DIGIT_NEXT = (0.5, 0.2, 0.3)
#: A run whose combined randomness test is below this does not look random.
LEVEL = 0.001
#: Share of false discoveries allowed among the added spans, and the resolution of ln p.
FDR, STEP, FLOOR = 0.001, 0.05, -400.0


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _hits(kind: str, pattern: str, asked: Column | None = None) -> Column:
    """Matches of a pattern with the length of the text before each, since the match before."""
    none = F.array().cast("array<struct<kind:string,k:int,gap:int,text:string>>")
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    if asked is not None:
        found = F.when(asked, found).otherwise(F.array().cast("array<string>"))
    return _let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(
        _let(F.split("text", pattern, -1), lambda p: F.transform(m, lambda x, k: F.struct(
            F.lit(kind).alias("kind"), k.cast("int").alias("k"), F.length(F.get(p, k)).alias("gap"), x.alias("text"))))))


def _matches(rows: DataFrame) -> DataFrame:
    """``rows`` (rid, doc_id, text) -> (rid, doc_id, hits), written: the only pass over the texts."""
    any_word = _let(F.lower("text"), lambda low: F.array(*[F.contains(low, F.lit(w)) for w in KEYWORDS]))
    return rows.select("rid", "doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "rid", "doc_id", F.concat(
            _hits("assign", PATTERNS["assign"], F.array_contains(any_word, True)),
            _hits("access", PATTERNS["access"], F.contains("text", F.lit("AKIA"))),
            _hits("hex", PATTERNS["hex"]), _hits("random", RUN)).alias("hits"))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic approximation, error below 0.0002)."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(700.0))))


def _text_ln_p(text: Column, encoding: Column) -> Column:
    """ln of the combined p-value of the battery's three tests under text.

    Each test is the likelihood ratio of a uniformly random string against text:
    of the classes of characters given the one before (runs), of the letter or
    digit given its class (frequencies), and of vowels and digits given the one
    before (serial).  They are conditional on each other, so under text their
    product exceeds 1 / p with a chance of p at most (Markov's inequality).  The
    encoding is chosen from the run: p is multiplied by the number of encodings.
    Without small letters, capitals are read as small ones: text may be all capitals."""
    listed = lambda v: F.array(*[F.lit(float(x)) for x in v])
    freq = [x / sum(FREQUENCY) for x in FREQUENCY]
    vowel = sum(f for f, c in zip(freq, LOWER) if c in VOWELS)
    # per letter: ln frequency; and the serial ratio after a consonant or vowel
    ln_freq = listed(log(f) for f in freq)
    serial = listed(log(vowel / VOWEL_NEXT[p] if c in VOWELS else (1 - vowel) / (1 - VOWEL_NEXT[p]))
                    for p in (0, 1) for c in LOWER)
    is_vowel = listed(c in VOWELS for c in LOWER)
    ln_next = listed(log(x) for row in NEXT for x in row)
    counts = {k: [sum(c in s for c in a) for s in (DIGITS, LOWER, UPPER)] for k, a in ENCODINGS.items()}
    by = lambda f: F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), listed(f(v)))])[encoding]
    near, zero, any_ = DIGIT_NEXT

    def digit(x: Column, y: Column) -> Column:
        apart = F.abs(x - y)
        return log(0.1) - F.log(F.when(apart.isin(0, 1, 9), near / 3).otherwise(0.0) + F.when(y == 0, zero).otherwise(0.0)
                                + any_ / 10)

    def total(s: Column) -> Column:
        at, share, size = s["at"], s["share"], s["size"]

        def step(y: Column, i: Column) -> Column:
            x = F.when(i > 0, F.get(at, i - 1)).otherwise(F.lit(-1))
            kind = lambda v: F.when(v < 10, 0).when(v < 36, 1).otherwise(2)
            letter = lambda v: F.when(v < 36, v - 10).otherwise(v - 36)
            runs = F.when(x < 0, 0.0).otherwise(F.get(share, kind(y)) - F.get(ln_next, 3 * kind(x) + kind(y)))
            same = (x >= 0) & (kind(x) == kind(y))
            of_letter = (-F.get(size, kind(y)) - F.get(ln_freq, letter(y)) + F.when(same, F.get(
                serial, (26 * F.get(is_vowel, letter(x))).cast("int") + letter(y))).otherwise(0.0))
            of_digit = F.when(same, digit(x, y)).otherwise(0.0)
            return F.when(y < 0, 0.0).otherwise(runs + F.when(y < 10, of_digit).otherwise(of_letter))

        return F.aggregate(F.transform(at, step), F.lit(0.0), lambda acc, x: acc + x)

    small = text.rlike("[a-z]")
    # all capitals: the text is read as small letters, and so are the encoding's capitals
    read = lambda v: F.when(small, v).otherwise(F.array(F.get(v, 0), F.get(v, 2), F.lit(0.0)))
    return log(len(ENCODINGS)) - _let(F.struct(
        F.transform(F.split(F.when(small, text).otherwise(F.lower(text)), ""),
                    lambda c: F.instr(F.lit(DIGITS + LOWER + UPPER), c) - 1).alias("at"),
        read(by(lambda v: [log(x / sum(v)) if x else 0.0 for x in v])).alias("share"),
        read(by(lambda v: [log(x) if x else 0.0 for x in v])).alias("size")), total)


def battery(runs: DataFrame, text: str = "text") -> DataFrame:
    """Adds encoding, p_random and ln_p to rows with a token-like run.

    The encoding is the smallest alphabet that holds the run's letters and
    digits.  Signs are left out before the tests: base64, its url-safe form and
    a base62 run with a sign are all uniform over their letters and digits.
    p_random combines, under a uniformly random string, chi-squared uniformity
    over the alphabet (exact mean and variance), a runs test of the character
    classes and the lag-1 serial correlation (smallest of three, times three).
    ln_p combines the three tests under text (see _text_ln_p): this is what
    the false-discovery step works on."""
    out = runs.withColumn("core", F.regexp_replace(text, SIGNS, "")).withColumn("n", F.length("core"))
    named = F.lit(None).cast("string")
    for name, letters in reversed(sorted(ENCODINGS.items(), key=lambda kv: len(kv[1]))):
        named = F.when(F.col("core").rlike(f"^[{letters}]+$"), F.lit(name)).otherwise(named)
    out = out.withColumn("encoding", F.when((F.col("n") > 1) & F.col("core").rlike("[A-Za-z]"), named))
    out = out.withColumn("alphabet", F.create_map(*[F.lit(x) for kv in ENCODINGS.items() for x in kv])[F.col("encoding")])
    # written, so that nothing below works the encoding out again for every character
    known = keep(out.where("encoding is not null"), "secret-runs")
    n, a = F.col("n").cast("double"), F.length("alphabet").cast("double")
    chars = F.split("core", "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(
        F.length("core") - F.length(F.replace(F.col("core"), c, F.lit(""))), F.lit(2.0)))
    chi = ((a / n) * squares - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    # classes: digits, small letters, capitals
    members = [F.length(F.regexp_replace("core", f"[^{c}]+", "")).cast("double") for c in ("0-9", "a-z", "A-Z")]
    changes = F.size(F.regexp_extract_all("core", F.lit(r"[0-9]+|[a-z]+|[A-Z]+"), F.lit(0))).cast("double") - 1
    same = sum(m * (m - 1) for m in members) / (n * (n - 1))
    runs_z = (changes - (n - 1) * (1 - same)) / F.sqrt(F.greatest((n - 1) * same * (1 - same), F.lit(0.25)))
    at = F.transform(chars, lambda c: F.instr(F.col("alphabet"), c).cast("double"))

    def serial(v: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        centred = _let(total(v) / n, lambda mean: F.transform(v, lambda x: x - mean))
        return _let(centred, lambda d: total(F.transform(d, lambda x, i: x * F.coalesce(F.get(d, i + 1), F.lit(0.0))))
                    / F.greatest(total(F.transform(d, lambda x: x * x)), F.lit(1e-9)))

    known = known.withColumn("chi_z", chi).withColumn("runs_z", runs_z) \
        .withColumn("serial_z", _let(at, serial) * F.sqrt(n))
    least = F.least(_tail(F.col("chi_z")), 2 * _tail(F.abs("runs_z")), 2 * _tail(F.abs("serial_z")))
    return known.withColumn("p_random", F.least(3 * least, F.lit(1.0))) \
        .withColumn("ln_p", F.least(_text_ln_p(F.col(text), F.col("encoding")), F.lit(0.0))).drop(
        "core", "alphabet", "chi_z", "runs_z", "serial_z")


def discoveries(tested: DataFrame, fdr: float = FDR, level: float = LEVEL) -> DataFrame:
    """Runs that look random and pass the weighted Benjamini-Hochberg step-up
    over all tested runs; a run's weight is its share of the mean length.  The
    step-up works on counts per step of ln p, so it is a few thousand rows."""
    mean = F.broadcast(tested.agg(F.avg("n").alias("mean"), F.count(F.lit(1)).alias("m")))
    weighed = tested.join(mean, F.lit(True))                 # one row of totals
    weighed = weighed.withColumn("bin", F.ceil(F.greatest(
        F.col("ln_p") - F.log(F.col("n") / F.col("mean")), F.lit(FLOOR)) / STEP))
    bins = weighed.groupBy("bin", "m").agg(F.count(F.lit(1)).alias("c"))
    ranked = bins.withColumn("below", F.sum("c").over(W.orderBy("bin")))
    limit = ranked.where(F.col("bin") * STEP <= F.log(F.lit(fdr) * F.col("below") / F.col("m"))).agg(
        F.max("bin").alias("limit"))
    return weighed.join(F.broadcast(limit), F.col("bin") <= F.col("limit")).where(F.col("p_random") >= level).drop(
        "mean", "m", "bin", "limit")


def find(rows: DataFrame, fdr: float = FDR, level: float = LEVEL) -> tuple[DataFrame, DataFrame]:
    """``rows`` (rid, doc_id, text) -> the rows' ids (rid, doc_id) and the spans
    (rid, kind, start, end), code points with the end exclusive."""
    seen = keep(_matches(rows), "secret-matches")
    each = seen.select("rid", F.explode("hits").alias("h")).select("rid", "h.*")
    ends = W.partitionBy("rid", "kind").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("text")).over(ends).cast("long"))
    each = each.withColumn("start", F.col("end") - F.length("text"))
    value = F.length(F.regexp_extract("text", PATTERNS["assign"], 1))
    each = keep(each.where((F.col("kind") != "assign") | (value >= ASSIGN_LEAST))
                .select("rid", "kind", "start", "end", F.when(F.col("kind") == "random", F.col("text")).alias("text")),
                "secret-spans")
    added = discoveries(battery(each.where("kind = 'random'")), fdr, level)
    cols = ["rid", "kind", "start", "end"]
    spans = each.where("kind <> 'random'").select(cols).union(added.select(cols))
    # a run inside a base span adds nothing
    random = F.col("kind") == "random"
    before = W.partitionBy("rid").orderBy("start", random).rowsBetween(W.unboundedPreceding, -1)
    held = F.coalesce(F.max(F.when(~random, F.col("end"))).over(before) >= F.col("end"), F.lit(False))
    spans = spans.withColumn("held", random & held).where("not held").select(cols)
    return seen.select("rid", "doc_id"), spans


def scan(docs: DataFrame, fdr: float = FDR, level: float = LEVEL) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text): doc_id, spans (array of
    start, order of the kind, end, kind; by start, then kind).

    Base kinds are found by their patterns, leftmost and non-overlapping;
    kind random are added runs (see battery and discoveries).  Null and empty
    texts have no spans; repeated rows are scanned alike; other columns are
    ignored; no rows give no rows."""
    prepare(docs.sparkSession)
    ids, spans = find(docs.select(F.monotonically_increasing_id().alias("rid"),
                                  F.col("doc_id").cast("long").alias("doc_id"), "text"), fdr, level)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    lists = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(
        "start", order.alias("order"), "end", "kind"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    return ids.join(lists, "rid", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with every span, and what
    overlaps it, replaced by one ``mark``; documents stay, n_chars follows."""
    prepare(docs.sparkSession)
    rows = with_row_key(docs, ["doc_id", "text", "lang", "source", "n_chars"], "secret-texts")
    _, spans = find(rows.select("rid", "doc_id", "text"), **options)
    w = W.partitionBy("rid").orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") < F.col("far"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    merged = (spans.withColumn("far", far).withColumn("island", island).groupBy("rid", "island")
              .agg(F.min("start").alias("s"), F.max("end").alias("e")))
    lists = merged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(
        F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")))).alias("cut"))
    before = F.transform("cut", lambda x, i: F.substring(
        F.col("text"), F.coalesce(F.get(F.col("cut"), i - 1)["e"], F.lit(0)) + 1,
        x["s"] - F.coalesce(F.get(F.col("cut"), i - 1)["e"], F.lit(0))))
    after = F.substring(F.col("text"), F.element_at("cut", -1)["e"] + 1, F.length("text"))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(
        F.array_join(F.concat(before, F.array(after)), mark))
    return (rows.join(lists, "rid", "left").withColumn("new", text)
            .select("doc_id", F.col("new").alias("text"), "lang", "source",
                    F.when(F.col("cut").isNull(), F.col("n_chars")).otherwise(F.length("new")).cast("long")
                    .alias("n_chars")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts, digest and spans of every whole document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda keep_all: F.array_join(F.transform(
        F.col("spans") if keep_all else F.filter("spans", lambda s: s["kind"] != "random"),
        lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in PATTERNS],
                        F.sha2(said(False), 256).alias("base_sha256"), said(True).alias("spans"))
