import re

import pytest

from fleetkit.llm import license_scan as L

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, labels string, rid int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(0x41, 0x5B)}


def brute(text):
    """Base columns, word by word."""
    words = WORD.findall((text or "").translate(SMALL))
    at = [(i, label) for p, label in L.PHRASES.items() for q in [p.split()]
          for i in range(len(words)) if words[i:i + len(q)] == q]
    starts = [i for i, _ in at]
    return (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), texts[r.doc_id][:200]
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1
        assert r.labels.split(",") == sorted(set(r.labels.split(",")))


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", 0, "z", 1) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(L.scan(df).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == list(range(len(texts)))
    return got


CASES = [
    ("Released under the MIT License.", "mit"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3"),
    ("see https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),             # the phrase stays, the longer name is added
    ("dual: the MIT license or the Apache License 2.0", "apache-2,mit"),
    ("GNU Lesser General Public License version 2.1", "lgpl-2.1"),         # holds the names of gpl and lgpl
    ("GNU Affero General Public License", "agpl-3"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("Mozilla Public License 2.0", "mpl-2"),
    ("veröffentlicht unter der MIT Lizenz, mit Lizenz", ""),
    ("Er kam mit dem Hund. A license plate, a public domain name, cc by mail.", "cc-by"),
    ("GPL3 only, or LGPL2.1; APL 2.0", "apache-2,gpl-3,lgpl-2.1"),
    ("under the\n\nmit-license apache license version 2", "apache-2,mit"),
    ("under the mitt license; under them it license", ""),
    ("", ""), (None, ""), (" .,;", ""), ("MIT", ""), (" under\u0085 the mit license", "mit"),
]


def test_labels_and_suppression(spark):
    got = scanned(spark, [t for t, _ in CASES])
    check(got, dict(enumerate(t for t, _ in CASES)))
    assert [(t, r.labels) for (t, _), r in zip(CASES, got)] == CASES
    strong = {t: r.score for (t, _), r in zip(CASES, got)}
    assert strong["Mozilla Public License 2.0"] == 0.6 and strong["SPDX-License-Identifier: BSD-3-Clause"] == 1.0 and strong[""] == 0.0


def test_every_rule_is_gated_and_matches_bounded_text(spark):
    assert len(L.RULES) > 300 and len({r["pattern"] for r in L.RULES}) > 300
    for r in L.RULES:
        assert re.compile(r["pattern"]) and not re.search(r"(?<!\\)\.[*+]|\\S[*+]\)[*+]", r["pattern"])
    assert [r["id"] for r in L.RULES] == list(range(len(L.RULES)))


def test_long_text_repeated_rows_and_no_rows(spark):
    long = "under the mit license " * 20_000 + "word " * 50_000 + "CC-BY-NC " * 3
    got = scanned(spark, [long, "x" * 500_000, "cc by nc cc by nc", "cc by nc cc by nc"])
    check(got, {0: long, 1: "x" * 500_000, 2: "cc by nc cc by nc", 3: "cc by nc cc by nc"})
    assert got[0].n_base == 20_003 and got[0].labels == "cc-by-nc,mit"
    twice = spark.createDataFrame([(None, "cc by nc", "", "", 0, "", 1)] * 2, SCHEMA)
    assert [(r.doc_id, r.n_base) for r in L.scan(twice).collect()] == [(None, 1)] * 2
    assert L.scan(twice.limit(0)).count() == 0


@pytest.mark.parametrize("size", ["sf0.01"])
def test_documents(spark, size):
    path = f"/root/testdata/{size}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = L.op13_license_scan(spark, path).collect()
    assert len(got) == len(texts)
    check(got, texts)
    line = re.compile("license|cc by", re.I)
    assert {r.doc_id for r in got if r.labels} == {i for i, t in texts.items() if line.search(t)}
