import html
import re

import pytest

from fleetkit.llm.html_text import extract, main_text

BODY = "Long enough, with commas, so that it scores as prose and not as a menu entry at all."


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("plain &amp; simple", "plain & simple"),
    (f"<div><p>{BODY}</p><p>Two&nbsp; &eacute; &#x41;&lt;b&gt;\n x</p></div>", f"{BODY}\nTwo é A<b> x"),
    (f"<article><h1>T</h1><p><b>{BODY}<br><p>Next<p>Third</article><footer>f</footer>", f"T\n{BODY}\nNext\nThird"),
    (f"<body><header><h1>Site</h1></header><nav><a href=/>x</a></nav><main><article><p>{BODY}</p></article>"
     f"<aside>side, side, side</aside></main><div class='ad'>Buy, buy, buy, {BODY}</div></body>", BODY),
    (f"<article><p>{BODY}</p><section id='comments'><p>{BODY} {BODY}</p></section></article>", BODY),
    (f"<div class='content'><p>{BODY}</p></div><div class='comment-list'><p>{BODY}, {BODY}</p></div>", BODY),
    (f"<div class='cookie-notice'><p>{BODY}{BODY}</p></div><div id=c><p>{BODY}</p></div>", BODY),
    (f"<article><p>{BODY}</p><ul class=x><li><a href=1>one</a></li><li><a href=2>two</a></li></ul>"
     f"<ul><li>kept item</li></ul></article>", f"{BODY}\nkept item"),
    (f"<article><p>{BODY}</p><script>var a = '</p><p>no</p>';</script><style>p</style><!-- <p>no</p> -->"
     f"<form><label>no</label><input value=no></form></article>", BODY),
    (f"<article><section><p>{BODY}</p></section><section><p>short</p></section></article>", f"{BODY}\nshort"),
    (f"<div><p>{BODY}</p><p>cut &am", f"{BODY}\ncut &am"),
    (f"<div><p>{BODY}</p><p>open tag <a href='x", f"{BODY}\nopen tag"),
    (f"<p>{BODY}</p><p>1 < 2 and a<b>c</b></p>", f"{BODY}\n1 < 2 and ac"),
    (f"<div hidden><p>{BODY}</p></div><div><p>seen, text</p></div>", "seen, text"),
])
def test_pages(page, want):
    assert main_text(page) == want


def test_table_against_its_template(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract(rows).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id].text == "\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_edges(spark):
    deep = "<div>" * 3000 + f"<p>{BODY}</p>"
    df = spark.createDataFrame([(1, None, None, "t"), (None, "u", deep, "t"), (1, "u", "<p>" + "x, " * 300_000, "t"),
                                (1, "u", "<p>" + "x, " * 300_000, "t")], "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert [r.n_chars for r in got] == [0, len(BODY), 899_999, 899_999]
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div id='page' class='no-sidebar'",
                                     "div class='hidden-print'", "section class='social-science'", "div class=commentary"])
def test_names_do_not_drop_the_article(wrapper):
    end = f"</{wrapper.split()[0]}>"
    for inner in (f"<article><p>{BODY}</p><p>{BODY}</p></article>", f"<p>{BODY}</p><p>{BODY}</p>"):
        page = f"<body><nav>x</nav><{wrapper}>{inner}<div class=ad><p>Buy</p></div>{end}<div class=ad>Buy</div></body>"
        assert main_text(page).split("\n")[:2] == [BODY, BODY], page
        assert main_text(f"<body><{wrapper}>{inner}{end}<footer>f</footer></body>") == f"{BODY}\n{BODY}"


def test_short_sections_headings_and_references_stay():
    five, refs = f"<p>{BODY}</p>" * 5, "<ul><li><a href=1>A cited work with a long title, 2020</a></li>" \
        "<li><a href=2>Another cited work with a long title</a></li></ul>"
    page = f"<body><nav>x</nav><div id=c><h1>T</h1><div>{five}</div><div><p>Short.</p><p>End.</p></div></div></body>"
    assert main_text(page) == "\n".join(["T"] + [BODY] * 5 + ["Short.", "End."])
    assert main_text(f"<body><h1>T</h1><div>{five}</div><p>Copyright</p></body>") == "\n".join(["T"] + [BODY] * 5)
    assert "A cited work with a long title, 2020\nAnother" in main_text(f"<article>{five}{refs}</article>")


def test_parts_of_an_article_stay():
    links = "<ul><li><a href=1>Intro</a></li><li><a href=2>Usage</a></li></ul>"
    assert main_text(f"<article><p>{BODY}</p>{links}<p>{BODY}</p></article>") == f"{BODY}\nIntro\nUsage\n{BODY}"
    assert main_text(f"<article>{links}<p>{BODY}</p><p>{BODY}</p>{links}</article>") == f"{BODY}\n{BODY}"
    parts = f"<section class=social><p>{BODY}</p></section><div class=widget-comparison><p>{BODY}</p></div>"
    around = "<div class=share>Share this</div><div class=cookie-notice><p>" + BODY * 2 + "</p></div>"
    assert main_text(f"<article><p>{BODY}</p>{parts}{around}</article>") == "\n".join([BODY] * 3)
    assert main_text(f"<article><div class=entry-header><h1>T</h1></div><p>{BODY}</p></article>") == f"T\n{BODY}"
    two = f"<article><p>{BODY} {BODY}</p><p>{BODY}</p></article><article><p>Short one.</p></article>"
    teaser = "<article><p><a href=x>Another page</a></p></article>"
    assert main_text(f"<main>{two}{teaser}</main>") == f"{BODY} {BODY}\n{BODY}\nShort one."


def test_depth_costs_no_more_than_length():
    import time
    n = 40_000
    pages = {f"{BODY}\n" * n: f"<div><p>{BODY}" * n, f"{BODY}\n": "<div>" * n + "<li></li>" * n + BODY,
             f"{BODY}\n ": "<i><div>" + "<b>" * n + "</i>" * n + BODY, f"{BODY}\n  ": BODY + "<a " * n,
             "": "<div>" * n + "<a href=x>t</a>" * n}
    for want, page in pages.items():
        begun = time.process_time()
        got = main_text(page)
        assert time.process_time() - begun < 20          # the quadratic version took minutes
        assert got == want.strip(), page[:40]


def test_points_reach_far_ancestors():
    """Paragraphs 70 wrappers deep: together they outweigh any single one of them in their common container."""
    deep = "<div>" * 70 + f"<p>{BODY}</p>" + "</div>" * 70
    assert main_text(f"<body><div>{deep * 400}</div><div class=x><p>{BODY}</p></div></body>").count(BODY) >= 400
