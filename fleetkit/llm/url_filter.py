"""URL filter: rules of host and path first, gradient-boosted trees on lexical features for the rest.

Everything here is DataFrame functions and Spark's own (JVM) tree learner."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetkit.llm.common import keep, prepare, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules of the contract, action and host with path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
FEATURES = ("length", "host_length", "depth", "labels", "digit_ratio", "entropy", "params", "hyphens", "secure",
            "extension", "fragment", "suffix1_rate", "suffix1_seen", "suffix2_rate", "suffix2_seen")
#: Labelled rows the trees are fitted on, at most (a hashed sample); suffix statistics use all of them.
TRAIN_ROWS = 20_000
#: Labelled rows that a suffix's block rate is shrunk by.
PRIOR = 20.0
#: Parts of the labelled urls (by hash); a row that is fitted on gets the suffix statistics of the other parts.
FOLDS = 5


def split_url(url: str = "url") -> list[Column]:
    """Columns host and path; both empty for null and where ``://`` is missing."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)"))
    rest = F.coalesce(rest, F.lit(""))
    return [F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path")]


def rule_columns(rules=RULES) -> list[Column]:
    """rule and action of the longest rule that fits columns host and path, else null."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):        # the longest is asked first
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return [rule.alias("rule"), action.alias("action")]


def lexical(url: str = "url") -> list[Column]:
    """Lexical features of the whole url (null: empty), host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    shares = F.transform(F.array_distinct(F.split(u, "")), lambda c: F.when(
        c == "", F.lit(0.0)).otherwise((F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n))
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))
    kept = lambda chars, of: F.length(F.regexp_replace(of, f"[^{chars}]+", ""))
    columns = {"length": F.length(u), "host_length": F.length("host"),
               "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
               "labels": F.size(F.split("host", r"\.")), "digit_ratio": kept("0-9", u) / n, "entropy": entropy,
               "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
               "hyphens": kept(r"\-", F.col("host")), "secure": u.startswith("https://"),
               "extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$"), "fragment": u.contains("#")}
    return [c.cast("double").alias(k) for k, c in columns.items()]


def features(urls: DataFrame, labelled: DataFrame, out_of_fold: bool = False) -> DataFrame:
    """``urls`` (url, host, path, ...) with every feature; the last one and two
    labels of the host get their shrunk block rate and count over all of
    ``labelled`` (url, host, label), or, ``out_of_fold``, over those outside
    the url's own fold, so that no row's label enters its own features."""
    suffix = lambda k: F.substring_index("host", ".", -k)
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    out = urls.select("*", *lexical(), fold.alias("fold"))
    for k in (1, 2):
        key = [f"suffix{k}", "fold"] if out_of_fold else [f"suffix{k}"]
        stat = labelled.select(suffix(k).alias(f"suffix{k}"), fold.alias("fold"), "label").groupBy(*key).agg(
            F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n"))
        ones, n = F.col("ones"), F.col("n")
        if out_of_fold:                             # a window of FOLDS rows at most
            of = W.partitionBy(f"suffix{k}")
            ones, n = F.sum("ones").over(of) - ones, F.sum("n").over(of) - n
        stat = stat.select(*key, ((ones + PRIOR / 2) / (n + PRIOR)).alias(f"suffix{k}_rate"),
                           F.log1p(n).alias(f"suffix{k}_seen"))
        out = (out.withColumn(f"suffix{k}", suffix(k)).join(stat, key, "left").drop(f"suffix{k}")
               .fillna({f"suffix{k}_rate": 0.5, f"suffix{k}_seen": 0.0}))
    return out.drop("fold")


def training_rows(some: DataFrame, known: DataFrame) -> DataFrame:
    """label and features of the rows ``some`` of ``known``: each once with its
    suffix statistics (out of fold) and once as if its suffix had never been
    seen, so that a url of an unknown suffix is judged by its other features
    and, where these say nothing, by the share of blocked labels."""
    rows = features(some, known, out_of_fold=True).select("label", *FEATURES)
    unseen = {"suffix1_rate": 0.5, "suffix1_seen": 0.0, "suffix2_rate": 0.5, "suffix2_seen": 0.0}
    return rows.union(rows.select("label", *[F.lit(unseen[c]).alias(c) if c in unseen else c for c in FEATURES]))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, train_rows: int = TRAIN_ROWS,
          threshold: float = 0.5, seed: int = 11) -> DataFrame:
    """Verdicts for ``pages`` (page_id, url): host, path, rule, score, verdict.

    ``labelled`` (url, label: 1 is block) trains the trees; without it the urls
    that a rule decides do.  At most about ``train_rows`` of them, chosen by the
    url's hash, are fitted on (see training_rows).  With one class or none to learn from, that
    class (else allow) is the verdict.  Null urls have an empty host and path
    and are scored as empty text; repeated rows are judged alike; other columns
    are ignored; no rows give no rows."""
    prepare(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").select("*", *split_url())
    base = keep(base.select("*", *rule_columns(rules)), "url-rules")
    if labelled is None:
        known = base.where("action is not null").select(
            "url", "host", "path", (F.col("action") == "block").cast("double").alias("label"))
    else:
        known = labelled.where("label is not null").select(
            "url", F.col("label").cast("double").alias("label")).select("*", *split_url())
    rows, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, rows):
        score = base.withColumn("score", F.lit(1.0 if rows and ones else 0.0))
    else:
        some = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, train_rows / rows))
        full = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        train = keep(training_rows(known.where(some), known), "url-train")
        seen = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if seen[1] in (0, seen[0]):                     # a very small sample of one class
            train = keep(training_rows(known, known), "url-train")
        model = GBTClassifier(labelCol="label", maxIter=12, maxDepth=4, stepSize=0.2, seed=seed).fit(
            full.transform(train))
        score = model.transform(full.transform(features(base, known))).withColumn(
            "score", vector_to_array("probability")[1])
    verdict = F.coalesce("action", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return score.select("page_id", "url", "host", "path", "rule", "score", verdict.alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: host, path, rule and verdict of every page's url."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict")
