"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit.llm.common import prepare, table

# Element classes of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = set("p pre blockquote li dd dt td th figcaption caption summary address".split()) | HEADINGS
BLOCKS = PARAGRAPHS | set("""html body article main section div header footer nav aside form fieldset ul ol dl menu
    table thead tbody tfoot tr figure details dialog hgroup center hr search""".split())
#: Elements that never hold article text.
DROPPED = set("""head nav aside footer form fieldset menu dialog search button select option optgroup datalist
    label legend output progress meter object applet audio video canvas map picture""".split()) | RAW
#: Words of a class or id that mark boilerplate, and longer stems that mark it inside a compound.
BOILERPLATE = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos
    promotion promoted banner banners sidebar sidebars aside rail menu menus submenu nav navs navbar navigation
    breadcrumb breadcrumbs header masthead topbar footer footers comment comments commentary reply replies respond
    responses disqus cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay lightbox
    newsletter subscribe subscription signup login share sharing sharebar social related recommended recommendations
    widget widgets pagination pager toolbar skip hidden outbrain taboola popover toast""".split())
#: Those that parts of an article bear as well: inside one they count only for elements without prose or a heading.
AMBIGUOUS = set("header masthead social share sharing widget widgets rail commentary skip toolbar".split())
#: Words that make a class or id one of layout.
MODIFIERS = {"has", "no", "with", "without", "print"}
STEMS = ("advert", "comment", "cookie", "footer", "sidebar", "sponsor", "navbar", "breadcrumb", "newsletter", "disqus")
ROLES = set("""navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form
    toolbar tablist""".split())
#: Elements whose class or id is not looked at.
ROOTS = {"html", "body", "main", "article"}
#: Characters per link below which a list of links is a menu; references have more.
MENU = 25
#: Unlinked characters outside named elements that make a page's main text.
PROSE = 80
#: From this level on all ancestors get the same share of a paragraph's points.
FAR = 64
#: Start tags that end an open element of the second kind, up to the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TOKEN = re.compile(r"""<(?:
    !--(?P<comment>) | (?P<bogus>[!?]|/(?![a-zA-Z]))
  | (?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))*+)>)""",
                   re.X)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _boilerplate(tag: str, attrs: str, inside_article: bool) -> bool:
    """Whether an element is hidden or of a kind that holds no article text."""
    if tag in DROPPED or tag == "header" and not inside_article:
        return True
    if not attrs.strip() or tag in ROOTS:
        return False
    got = {}
    for m in ATTR.finditer(attrs):
        got.setdefault(m[1].lower(), unescape((m[2] or "").strip("\"'")))
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or got.get("role", "").lower() in ROLES:
        return True
    if "display:none" in got.get("style", "").replace(" ", "").lower():
        return True
    return False


def _named(tag: str, attrs: str) -> int:
    """2 if a class or id names boilerplate, 1 if only by a word that articles use too, else 0; layout modifiers
    (has-sidebar) name nothing."""
    if tag in ROOTS or not attrs.strip():
        return 0
    got = {}
    for m in ATTR.finditer(attrs):
        got.setdefault(m[1].lower(), unescape((m[2] or "").strip("\"'")))
    found = 0
    for name in f"{got.get('class', '')} {got.get('id', '')}".split():
        words = WORDS.findall(CAMEL.sub(" ", name).lower())
        if MODIFIERS & set(words):
            continue
        for w in words:
            if w in BOILERPLATE or any(s in w for s in STEMS):
                found = max(found, 1 if w in AMBIGUOUS else 2)
    return found


class _Page:
    """Nodes in page order with the blocks of text they hold."""

    def __init__(self, html: str):
        self.tag, self.parent, self.last, self.drop = ["#page"], [-1], [0], [False]
        self.named = [0]
        self.blocks: list[tuple[int, str, int]] = []       # node, text, characters inside links
        self._open, self._text, self._linked = [0], [], 0
        self._depths: dict[str, list[int]] = defaultdict(list)      # where each tag is open, the innermost last
        self._blocks = [0]                                           # where the open blocks are
        self._read(html)
        while len(self._open) > 1:
            self._pop()
        self._flush()
        self.last[0] = len(self.tag)
        self.links = self.summed_up([int(tag == "a") for tag in self.tag])

    def summed_up(self, own: list) -> list:
        """Per node the sum over the nodes below it."""
        below = [0] * len(own)
        for k in range(len(own) - 1, 0, -1):
            below[self.parent[k]] += below[k] + own[k]
        return below

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        closed = html.rfind(">") + 1                                 # no tag ends behind it
        while at < n:
            m = TOKEN.search(html, at, closed)
            if m is None:
                cut = re.compile(r"<[a-zA-Z/!?]").search(html, at)   # a tag that never ends holds no text
                self._say(html[at:cut.start() if cut else n])
                return
            self._say(html[at:m.start()])
            at = m.end()
            if m["comment"] is not None:
                end = re.compile(r"--!?>").search(html, at)
                at = end.end() if end else n
            elif m["bogus"] is not None:
                at = html.find(">", at) + 1 or n
            elif m["end"]:
                self._close(m["name"].lower())
            else:
                at = self._start(m["name"].lower(), m["attrs"], html, at)

    def _say(self, text: str) -> None:
        if text and not self.drop[self._open[-1]]:
            text = unescape(text)
            self._text.append(text)
            if self._depths["a"]:
                self._linked += len(text.strip())

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._open[self._blocks[-1]], text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _push(self, k: int) -> None:
        self._depths[self.tag[k]].append(len(self._open))
        if self.tag[k] in BLOCKS:
            self._blocks.append(len(self._open))
        self._open.append(k)

    def _pop(self) -> None:
        k = self._open[-1]
        if self.tag[k] in BLOCKS:
            self._flush()
            self._blocks.pop()
        self._depths[self.tag[k]].pop()
        self.last[k] = len(self.tag)
        self._open.pop()

    def _close(self, name: str) -> None:
        if name == "br" and not self.drop[self._open[-1]]:
            self._text.append(" ")
        depth = self._depths[name][-1] if self._depths[name] else 0
        if depth and (name in BLOCKS or depth > self._blocks[-1]):       # an inline end tag stays inside its block
            while len(self._open) > depth:
                self._pop()

    def _start(self, name: str, attrs: str, html: str, at: int) -> int:
        if name in BLOCKS and any(self.tag[k] == "p" for k in self._open[-8:]):
            self._close("p")
        if name in CLOSES:
            ends, stop = CLOSES[name]
            while True:
                depth = max((self._depths[t][-1] for t in ends | stop if self._depths[t]), default=0)
                if self.tag[self._open[depth]] not in ends:
                    break
                while len(self._open) > depth:
                    self._pop()
        elif name in HEADINGS and self.tag[self._open[-1]] in HEADINGS:
            self._pop()
        if name in BLOCKS:
            self._flush()
        up = self._open[-1]
        if name in VOID:
            if name in ("br", "wbr", "img", "hr") and not self.drop[up]:
                self._text.append("" if name == "wbr" else " ")
            return at
        inside = bool(self._depths["article"] or self._depths["main"])
        self.tag.append(name)
        self.parent.append(up)
        self.last.append(len(self.tag))
        self.drop.append(self.drop[up] or _boilerplate(name, attrs, inside))
        self.named.append(_named(name, attrs))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            return end.end() if end else len(html)
        self._push(len(self.tag) - 1)
        if attrs.endswith("/") and name in ("svg", "math", "path"):
            self._pop()
        return at


def _drop_named(page: _Page) -> None:
    """Takes out the blocks of elements that a class or id names as boilerplate,
    unless they hold an <article> or <main>, or most of the page's unlinked
    paragraph text while hardly any (PROSE, or a twentieth) is outside.  Inside
    an <article> or <main> an ambiguous name (AMBIGUOUS) takes out only elements
    that have neither a heading nor PROSE characters of mostly unlinked text."""
    n = len(page.tag)
    if not any(page.named):
        return
    # the outermost named element that does not hold the article
    holds = [False] * n
    for k in range(1, n):
        if page.tag[k] in ("article", "main") and not page.drop[k]:
            up = page.parent[k]
            while up >= 0 and not holds[up]:
                holds[up] = True
                up = page.parent[up]
    inside = [False] * n
    for k in range(1, n):
        inside[k] = inside[page.parent[k]] or page.tag[k] in ("article", "main")
    own, link_of, heads = [0] * n, [0] * n, [0] * n
    for node, text, link in page.blocks:
        own[node] += len(text)
        link_of[node] += link
        heads[node] += page.tag[node] in HEADINGS
    chars, linked, heads = ([x + y for x, y in zip(v, page.summed_up(v))] for v in (own, link_of, heads))
    top = [0] * n
    for k in range(1, n):
        part = page.named[k] == 1 and inside[k] and linked[k] < 0.25 * chars[k] and (
            heads[k] or chars[k] - linked[k] >= PROSE)
        top[k] = top[page.parent[k]] or (k if page.named[k] and not holds[k] and not part else 0)
    unlinked = Counter()
    for node, text, link in page.blocks:
        if page.tag[node] not in HEADINGS:
            unlinked[top[node]] += len(text) - link
    # with prose outside, or an article that has paragraphs of its own, the names are right
    whole = sum(unlinked.values())
    article = any(inside[b[0]] and not top[b[0]] and page.tag[b[0]] not in HEADINGS for b in page.blocks)
    wrong = {k for k in unlinked if k and not article and 2 * unlinked[k] > whole and unlinked[0] < max(PROSE, unlinked[k] / 20)}
    page.blocks = [b for b in page.blocks if not top[b[0]] or top[b[0]] in wrong]


def _amid_paragraphs(page: _Page, chars: list[int]) -> set[int]:
    """Lists whose neighbours with text, before and behind, are paragraphs of the same <article>."""
    held, kids = [False] * len(page.tag), defaultdict(list)
    for k in range(1, len(page.tag)):
        held[k] = held[page.parent[k]] or page.tag[k] == "article"
        if chars[k] and held[k]:
            kids[page.parent[k]].append(k)
    return {mid for row in kids.values() for left, mid, right in zip(row, row[1:], row[2:])
            if page.tag[mid] in ("ul", "ol", "dl") and page.tag[left] == page.tag[right] == "p"}


def main_text(html: str | None) -> str:
    """The article of a page, blocks joined by one newline.

    Each paragraph earns 1 point, 1 per comma and up to 3 for its length, less
    its share of link text; its container gets all of it, the next half, the
    k-th above a 3k-th (from the 64th on the same share).  A container's score is again discounted by its link
    density.  The best one is kept (lifted to the <article> or <main> around
    it) with the siblings that score a fifth of it, or are prose themselves, and
    else the unlinked ones beside it in their container, headings included.
    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
    and reader comments are never scored or kept, nor are lists of short links
    inside the article, unless they stand between two of its paragraphs.  Further
    <article>s of a <main> stay if mostly unlinked.  The work is linear in the
    page, however deeply its tags are nested.  Null, empty or textless pages give an empty string."""
    if not html:
        return ""
    page = _Page(html)
    _drop_named(page)
    if not page.blocks:
        return ""
    n = len(page.tag)
    score, far, chars, linked = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    for node, text, link in page.blocks:
        chars[node] += len(text)
        linked[node] += link
        tag = page.tag[node]
        if tag in HEADINGS:
            continue
        points = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - link / len(text))
        k = page.parent[node] if tag in PARAGRAPHS else node
        level = 0
        while k >= 0 and level < FAR:
            score[k] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            k, level = page.parent[k], level + 1
        if k >= 0:
            far[k] += points / (3 * FAR)
    chars, linked, far = ([x + y for x, y in zip(v, page.summed_up(v))] for v in (chars, linked, far))
    score = [s + f for s, f in zip(score, far)]
    density = [linked[k] / chars[k] if chars[k] else 0.0 for k in range(n)]
    score = [s * (1 - d) for s, d in zip(score, density)]
    best = max(range(n), key=lambda k: (score[k], chars[k], -k))
    k = best
    while k >= 0:
        if page.tag[k] == "article" or page.tag[k] == "main" and page.tag[best] != "article":
            best = k
        k = page.parent[k]
    kept, up = [best], page.parent[best]
    beside = [k for k in range(1, n) if page.parent[k] == up and k != best and chars[k]]
    for k in beside:
        prose = page.tag[k] == "p" and density[k] < 0.25 and chars[k] > 80 and page.tag[best] not in ROOTS
        further = page.tag[k] == page.tag[best] == "article" and page.tag[up] == "main" and density[k] < 0.25
        if score[k] >= max(10.0, 0.2 * score[best]) or prose or further:
            kept.append(k)
    if page.tag[best] not in ROOTS:
        # other parts of the article: all in a container of its own, on the page itself those among the kept ones,
        # and the headings right before them
        outer = up < 0 or page.tag[up] in ("#page", "html", "body")
        first, last, before = min(kept), max(kept), [k for k in beside if k < min(kept)]
        while outer and before and page.tag[before[-1]] in HEADINGS:
            first = before.pop()
        have = set(kept)
        kept += [k for k in beside if k not in have and density[k] < 0.25 and (not outer or first <= k <= last)]
    have, amid = set(kept), _amid_paragraphs(page, chars)
    menus = [k for k in range(1, n) if page.links[k] > 1 and density[k] > 0.8
             and page.tag[k] in ("ul", "ol", "dl", "div", "section", "table") and k not in have and k not in amid
             and linked[k] < MENU * page.links[k]]
    cut = [0] * (n + 1)
    for group, step in ((kept, 1), (menus, -n)):
        for k in group:
            cut[k] += step
            cut[page.last[k]] -= step
    for k in range(1, n + 1):
        cut[k] += cut[k - 1]
    return "\n".join(text for node, text, _ in page.blocks if cut[node] > 0)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, text, n_chars (code points).

    One row per input row, so repeated and null keys pass through; a null html
    gives an empty text; other columns are ignored; whole pages are read."""
    prepare(pages.sparkSession)

    @F.pandas_udf("string")
    def text(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in htmls:
            yield pd.Series([main_text(h) for h in batch], dtype="object")

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text("html").alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
