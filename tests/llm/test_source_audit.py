import re
from collections import Counter, defaultdict

import duckdb
import pytest

from fleetkit.llm import source_audit as A

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, item string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {chr(c): chr(c + 32) for c in range(0x41, 0x5B)}


def brute(rows, min_docs=3, top=200):
    """The contract, term by term and pair by pair."""
    docs = [((lang or ""), (source or ""), TERM.findall("".join(SMALL.get(c, c) for c in text or "")))
            for _, text, lang, source, *_ in rows]
    seen, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        seen[lang].update(set(words))
        count[lang, source].update(words)
    f = lambda p, q: (p - q) ** 2 // q
    out = set()
    for lang in {x for x, _ in count}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        groups = [s for x, s in count if x == lang]
        p = {}
        for s in [*groups, None]:
            c = sum((count[lang, x] for x in groups), Counter()) if s is None else count[lang, s]
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10 ** 9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        for s in groups:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if count[lang, s][t] and p[s][t] > p[None][t]]
            for part, values, last in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:last]
                out |= {(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(order)}
    return out


def as_set(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


ROWS = [
    (1, "The cat. the CAT sat", "en", "a", 0, 9, "x"), (2, "cat dog the", "en", "b", 0, 9, "x"),
    (3, "the cat's dog, the dog", "en", "b", 0, 9, "x"), (3, "the cat's dog, the dog", "en", "b", 0, 9, "x"),
    (4, None, "en", "empty", 0, 9, "x"), (5, "dog K é É ÉTÉ", "en", None, 0, 9, "x"), (6, "été É ÉTÉ", "en", "", 0, 9, "x"),
    (7, "one word", None, "a", 0, 9, "x"), (8, "x", None, "b", 0, 9, "x"), (None, "dog " * 5000, "en", "long", 0, 9, "x"),
    (9, "alone", "fr", "a", 0, 9, "x"), (10, "été\x00x ete1ete", "en", "a", 0, 9, "x"),
]


@pytest.mark.parametrize("limit", [A.DICTIONARY, 2])
def test_cases_against_brute_force(spark, limit):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    want = brute(ROWS)
    assert as_set(A.audit(docs, dictionary=limit, nodes=limit)) == want and {x[2] for x in want} == {"pair", "term"}
    assert as_set(A.audit(docs, min_docs=1, top_terms=2)) == brute(ROWS, 1, 2)
    assert ("", "a", "pair", "b", 0, 1) in want                        # a language without kept terms
    assert A.audit(docs.limit(0)).count() == 0


def test_tables(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = as_set(A.op11_source_audit(spark, path))
    assert got == brute(rows)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    assert got == set(duckdb.sql(A.ORACLE_SQL).fetchall())


def test_tree_shares_paths():
    rows = [[(1, 9, 2), (2, 5, 2)], [(1, 9, 2), (2, 5, 2)], [(1, 9, 2), (3, 4, 1)], [], [(2, 5, 2)]]
    tree = A.Tree()
    for row in rows:
        tree.insert(row)
    assert len(tree.parent) == 4 and sorted(tree.rows) == [1, 1, 2, 3]
    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for row in rows:
        for a, p, p0 in row:
            for b, q, q0 in row:
                if a != b:
                    want[a, b] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    assert tree.corrections() == dict(want)
