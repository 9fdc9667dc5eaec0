"""Source divergence audit: how far each source's terms lie from the other sources of its language.

Terms are counted once per task (a dictionary per task, emptied when it is
full), summed per (lang, term, source) behind one exchange by (lang, term), and
kept if they occur in ``min_docs`` documents of the language.  Each count
becomes a whole number p = 1 + floor(10^9 (count + 1) / (N + V)), and two
distributions are compared by the sum of f(p, q) = floor((p - q)^2 / q) over all V kept
terms.  Most terms are absent from most sources, so that sum is taken apart:

    sum f(p, q) = V f(p0, q0)                              both absent
                + sum over terms of a [f(p, q0) - f(p0, q0)]
                + sum over terms of b [f(p0, q) - f(p0, q0)]
                + sum over terms of both [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

where p0 and q0 stand for a count of zero.  The middle lines come from a
histogram of counts per source.  The last one comes from a frequent-pattern
tree: each kept term is a row of its nonzero counts in source order, rows
with a common start share a path, and a node holds how many rows run through
it.  Each node meets each of its ancestors once, whatever its multiplicity.
The sums add up over trees, so a task starts a new tree when one is full.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetkit.llm.common import keep, prepare, release, table

#: A term occurs in at least so many documents of its language.
MIN_DOCS = 3
#: Ranks of the part ``term``.
TOP_TERMS = 200
#: Fixed value: probabilities are whole numbers of this unit.
UNIT = 1_000_000_000
#: Entries of a task's dictionary, and nodes of a task's trees, before they are passed on.
DICTIONARY, NODES = 300_000, 300_000
# Fixed value: bytes of a term stay (A-Z as a-z), all others separate terms.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text."""
    return text.translate(LETTERS).split()


def _counted(batches, dictionary: int):
    """(lang, source, text) -> partial (lang, source, term, n, docs); the term '' marks the group itself."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def out():
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1)),
                 pa.array([b"", *terms], pa.binary()).cast(pa.string()),
                 pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in terms)], pa.int64())],
                ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text").cast(pa.binary())):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            found = tokens(text.as_py())
            before = len(n)
            n.update(found)
            docs.update(set(found))
            size += len(n) - before
            if size > dictionary:
                yield from out()
                counts, size = {}, 0
    yield from out()
    counts.clear()
    release()


def counted(docs: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """(lang, term, source) -> n, docs: summed over all tasks behind one exchange by (lang, term)."""
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    part = text.mapInArrow(partial(_counted, dictionary=dictionary),
                           "lang string, source string, term string, n long, docs long")
    return (part.repartition("lang", "term").groupBy("lang", "term", "source")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def whole(count: Column, n: Column, v: Column) -> Column:
    """p of a count among n of v terms; 1 where there are no terms at all."""
    wide = F.lit(UNIT).cast("decimal(38,0)") * (count + 1).cast("decimal(20,0)")
    return F.when(v > 0, 1 + F.floor(F.call_function("div", wide, F.greatest(n + v, F.lit(1))).cast("long"))).otherwise(F.lit(1))


def apart(p: Column, q: Column) -> Column:
    """f(p, q); below 10^18, as p and q are about UNIT at most."""
    return F.call_function("div", (p - q) * (p - q), q)


class Tree:
    """Frequent-pattern tree of one language's term rows."""

    def __init__(self):
        self.children: dict[tuple[int, int, int], int] = {}
        self.parent, self.source, self.p, self.p0, self.rows = [], [], [], [], []

    def insert(self, items) -> None:
        """A row of (source, p, p0) in source order."""
        at = -1
        for source, p, p0 in items:
            node = self.children.get((at, source, p))
            if node is None:
                node = self.children[at, source, p] = len(self.parent)
                self.parent.append(at)
                self.source.append(source)
                self.p.append(p)
                self.p0.append(p0)
                self.rows.append(0)
            self.rows[node] += 1
            at = node

    def corrections(self):
        """(a, b, sum of corrections of a against b), over all nodes and their ancestors, in both directions."""
        parent, source, p, p0, rows = (np.array(x, np.int64) for x in (
            self.parent, self.source, self.p, self.p0, self.rows))
        f = lambda x, y: (x - y) ** 2 // y
        total: dict[tuple[int, int], int] = {}
        node, up = np.arange(len(parent)), parent
        while len(node := node[up >= 0]):                # the k-th ancestor of every node that has one
            up = up[up >= 0]
            for a, b in ((node, up), (up, node)):
                value = rows[node] * (f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
                order = np.lexsort((source[b], source[a]))
                s, t, value = source[a][order], source[b][order], value[order]
                first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])])
                for x, y, z in zip(s[first].tolist(), t[first].tolist(), np.add.reduceat(value, first).tolist()):
                    total[x, y] = total.get((x, y), 0) + z
            up = parent[up]
        return total


def _trees(batches, nodes: int):
    """Rows (lang, term, sid, p, p0), sorted by lang, term, sid, -> (lang, a, b, value)."""
    lang = term = None
    tree, row = Tree(), []

    def out():
        total = tree.corrections()
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(total), pa.string()), pa.array([a for a, _ in total], pa.int64()),
             pa.array([b for _, b in total], pa.int64()), pa.array(list(total.values()), pa.int64())],
            ["lang", "a", "b", "value"])

    for batch in batches:
        for now, word, *item in zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "sid", "p", "p0"))):
            if (now, word) != (lang, term):
                tree.insert(row)
                row = []
                if now != lang or len(tree.parent) > nodes:
                    yield from out()
                    tree = Tree()
                lang, term = now, word
            row.append(item)
    tree.insert(row)
    yield from out()
    tree = None
    release()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, dictionary: int = DICTIONARY,
          nodes: int = NODES) -> DataFrame:
    """Divergence of every source of ``docs`` (text, lang, source) from the others and from its language.

    Returns lang, source, part, item, value, rank (see the module; part 'pair':
    item is another source, 'term': a term that the source has more of than its
    language).  Null text, lang and source are read as ''.  Repeated rows count
    as documents of their own, further columns are not read.  No documents: no
    rows; a language without kept terms gives pairs of value 0.  Equal values
    rank by item.  A table of groups (one row per lang and source) is joined
    as Spark sees fit; it is never collected."""
    prepare(docs.sparkSession)
    counts = counted(docs, dictionary)
    rows = keep(counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("has"))
        .where((F.col("term") == "") | (F.col("docs") >= min_docs)), "audit-terms")
    kept = rows.where("term <> ''")
    # groups: N per source, V and N per language, and a number per source in source order
    n = kept.select("lang", F.explode("has").alias("h")).groupBy("lang", "h.source").agg(F.sum("h.n").alias("n"))
    all_ = rows.where("term = ''").select("lang", F.explode("has.source").alias("source"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    v, group_n = F.coalesce("v", F.lit(0)).cast("long"), F.coalesce("n", F.lit(0)).cast("long")
    groups = keep(
        all_.join(n, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", group_n.alias("group_n"), v.alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"),
                F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long").alias("sid"))
        .withColumn("p0", whole(F.lit(0), F.col("group_n"), F.col("v"))), "audit-groups")
    items = keep(
        kept.select("lang", "term", "total", F.explode("has").alias("h")).select("lang", "term", "total", "h.source", "h.n")
        .join(groups, ["lang", "source"])
        .select("lang", "source", "sid", "term", "p0", whole(F.col("n"), F.col("group_n"), F.col("v")).alias("p"),
                whole(F.col("total"), F.col("lang_n"), F.col("v")).alias("q")), "audit-items")

    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(
        W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))
    terms = ranked(items.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    ).where(F.col("rank") <= top_terms)

    wide = lambda c: c.cast("decimal(38,0)")
    g = groups.select("lang", F.col("sid").alias("other"), F.col("p0").alias("o0"))
    p, p0, o0 = F.col("p"), F.col("p0"), F.col("o0")
    absent = (groups.select("lang", "sid", "p0", "v").join(g, "lang").where("sid <> other")
              .select("lang", F.col("sid").alias("a"), F.col("other").alias("b"), (wide(F.col("v")) * wide(apart(p0, o0))).alias("value")))
    histogram = items.groupBy("lang", "sid", "p", "p0").agg(F.count(F.lit(1)).alias("h"))
    met = histogram.join(g, "lang").where("sid <> other")
    either = met.select("lang", F.explode(F.array(
        F.struct(F.col("sid").alias("a"), F.col("other").alias("b"),
                 (wide(F.col("h")) * wide(apart(p, o0) - apart(p0, o0))).alias("value")),
        F.struct(F.col("other").alias("a"), F.col("sid").alias("b"),
                 (wide(F.col("h")) * wide(apart(o0, p) - apart(o0, p0))).alias("value")))).alias("x")).select("lang", "x.*")
    both = (items.select("lang", "term", "sid", "p", "p0").repartition("lang", "term")
            .sortWithinPartitions("lang", "term", "sid").mapInArrow(partial(_trees, nodes=nodes), "lang string, a long, b long, value long")
            .withColumn("value", wide(F.col("value"))))
    summed = absent.union(either).union(both).groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    name = groups.select("lang", "sid", "source")
    pairs = ranked(summed.join(name.withColumnRenamed("sid", "a"), ["lang", "a"])
                   .join(name.select("lang", F.col("sid").alias("b"), F.col("source").alias("item")), ["lang", "b"])
                   .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pairs.unionByName(terms)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``documents``."""
    return audit(table(spark, sf_dir, "documents"))


# Upper-case letters and their small forms, and the term pattern.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
tok AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM tok GROUP BY ALL HAVING count(DISTINCT id) >= 3),
ln AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(total) AS HUGEINT) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS c FROM tok GROUP BY ALL),
gc AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.c, 0) AS HUGEINT) AS c, k.total
       FROM grp g JOIN kept k ON g.lang = k.lang
       LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gn AS (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS n FROM gc GROUP BY ALL),
p AS (SELECT gc.lang, gc.source, gc.term, gc.c, 1 + (1000000000 * (gc.c + 1)) // (gn.n + ln.v) AS p,
             1 + (1000000000 * (gc.total + 1)) // (ln.n + ln.v) AS q
      FROM gc JOIN gn ON gc.lang = gn.lang AND gc.source = gn.source JOIN ln ON gc.lang = ln.lang),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
          FROM p WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""
