import re

import numpy as np
from pyspark.sql import functions as F

from fleetkit.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, source string, kept string, x int"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words))


def test_base_counts(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text) < 9000]
    texts = [r.text for r in rows] + [None, "", "a", "a b", "a b c a b c", "a a a a", "x\n\nx\n \n x\nx\r", "é ü 😀😀 |<>",
                                      "a b c d a b c d a b", "$%\x0b&\x1c#", "\x85\n\x85\nw", "\u2028\nx\n\u2028\n\u2029",
                                      " \n\x0b\n\x0c\r\n"]
    df = spark.createDataFrame([(i, t, "en", "s", "k", 1) for i, t in enumerate(texts)], SCHEMA)
    for r in Q.base_statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == \
            brute(texts[r.doc_id]), texts[r.doc_id]


def test_inverse(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(Q.P, Q.P))
    a = a @ a.T + np.eye(Q.P)
    got = spark.createDataFrame([(a.tolist(),)], "m array<array<double>>").select(Q._inverse(F.col("m"))).first()[0]
    assert np.allclose(np.array(got) @ a, np.eye(Q.P))


def test_outliers_go_and_clean_ones_stay(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    rows = []
    for i in range(400):
        words = [word() for _ in range(int(rng.integers(60, 300)))]
        if i % 10 == 0:
            words = [[w.upper() + "!!" for w in words], [w + "###" for w in words]][i // 10 % 2]
        rows.append((i, " ".join(words), "en" if i % 3 else None, "s" if i % 5 else None, "k", 1))
    rows += [(None, None, None, None, None, None), (7, "word " * 70_000, "en", "s", "k", 1), rows[0]]
    got = Q.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id % 10 != 0) for r in got if r.doc_id != 7)
    assert Q.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_duplicate_lines_and_repeated_words_reject_alone(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(600):
        lines = [line(8) for _ in range(int(rng.integers(10, 30)))]
        if i % 50 == 0:                     # nearly all lines are copies of one of two words
            lines = [line(40), line(40)] + ["ab cd"] * 6
        elif i % 50 == 1:                   # two fifths of the words in repeated windows, no repeated line
            again = line(16)
            lines = [again, again + " " + line(24), line(24)]
        elif i % 50 == 2:                   # one odd character
            lines[0] = "!" + lines[0] + "#"
        rows.append((i, "\n".join(lines), "en", "s", "k", 1))
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not any(got[i].kept for i in got if i % 50 < 2)
    assert all(got[i].kept for i in got if i % 50 == 2)
    assert sum(not got[i].kept for i in got if i % 50 > 2) <= 3
