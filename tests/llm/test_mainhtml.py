import re
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from karst.llm import mainhtml as M
from karst.llm.mainhtml import extract, main_text

LONG = "A sentence of the article that goes on for a while, as sentences do. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><a href="/">Home</a></nav><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
<article><h1>Head</h1><p>One &amp; two&nbsp;three<p title="a>b">Text with <a href="x">a link</a> and <b>bold<br>{LONG}</p>
<aside>More</aside><div class="ad">Buy</div><form><p>Sign up</p></form><!-- <p>no</p> --><ul><li>item</li></ul>
<section id="comments"><article class="comment"><p>{LONG}</p></article></section></article>
<div class="sidebar">{LONG}</div><footer>&copy; x</footer>"""


def test_marked_article():
    assert main_text(PAGE) == "\n".join(["Head", "One & two three", "Text with a link and bold", LONG.strip(), "item"])


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<p>", ""), ("<nav>x</nav>", ""), ("just text", "just text"), ("<p>a<p>b</p>c", "a\nb\nc"),
    ("<article><p>cut off &amp", "cut off &"), ("<article><p>x &am", "x &am"), ("<article>a<script>if (a<b) x</article>", "a"),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"), ("<ARTICLE><P>A</P></ARTICLE>", "A"), ('<article><p hidden>no</p><p style="display:none">no</p>yes</article>', "yes"),
    ("<article>&lt;p&gt; &#233;&#x1F600;</article>", "<p> é😀"), ('<main><div class="related"><article>x</article></div><article>y y</article></main>', "y y"),
])
def test_small_pages(page, want):
    assert main_text(page) == want


def test_surge_and_dive_without_marks():
    page = f'<div><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div><div><p>{LONG}</p><p>short</p><p>{LONG}</p></div><div><a href=3>x</a></div><div><a>y</a></div><div><a>z</a></div><div class="comments"><p>{LONG}</p></div><footer>{LONG}</footer>'
    assert main_text(page) == "\n".join([LONG.strip(), "short", LONG.strip()])


def test_named_holder():
    page = f'<div id="top">Brand name of the site</div><div class="post-content"><p>Short.</p><div class="cookiebar">Cookies</div><p>{LONG}</p><p>End.</p></div><div>Other words of the site that nobody reads</div>'
    assert main_text(page) == "\n".join(["Short.", LONG.strip(), "End."])


@pytest.mark.parametrize(("page", "want"), [
    (f"<main><h1>Title</h1><p>Lead.</p><article><p>{LONG}</p></article><p>Close.</p></main><p>out</p>", ["Title", "Lead.", LONG.strip(), "Close."]),
    (f"<main><article><p>{LONG}</p></article><article><p>{LONG}</p></article></main>", [LONG.strip()] * 2),
    (f"<article><p>{LONG}</p></article><div>x</div><article><p>Two</p><nav>n</nav></article>", [LONG.strip(), "Two"]),
    (f'<div class="post"><h1>Title</h1><p>Lead.</p><div class="content"><p>{LONG}</p></div><p>Close.</p></div><div>out</div>', ["Title", "Lead.", LONG.strip(), "Close."]),
    (f'<div class="entry"><p>{LONG}</p><p>One</p></div><div>out</div><div class="entry"><p>{LONG}</p><p>Two</p></div>', [LONG.strip(), "One", LONG.strip(), "Two"]),
])
def test_all_holders(page, want):
    assert main_text(page) == "\n".join(want)


def test_two_surges():
    gap = "".join(f"<div><a>{i}</a></div>" for i in range(6))
    assert main_text(f"<div><p>{LONG}</p></div>{gap}<div><p>{LONG}</p></div>{gap}<p>tail</p>") == "\n".join([LONG.strip()] * 2)


class Slow(HTMLParser):
    """Lines of a page by the library's parser, with word lists of its own: text, code points outside short links, chrome, menu, and whether an article is around."""

    LINES = {"html", "head", "body", "title", "nav", "ul", "li", "div", "article", "h1", "p", "br", "footer", "section", "aside", "header"}
    EMPTY = {"br", "meta", "img", "link", "input", "hr"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.parts, self.lines = [], [], []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = lambda ps: " ".join("".join(ps).split())
        for chrome in (False, True):
            mine = [p for p in self.parts if p[1] == chrome]
            if text(p[0] for p in mine):
                menu = any(p[4] for p in mine)
                self.lines.append((text(p[0] for p in mine), 0 if menu else len(text(p[0] for p in mine if not p[2] or len(p[0]) >= 80)), chrome, menu, any(p[3] for p in mine)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in self.LINES:
            self.flush()
        if tag in self.EMPTY:
            return
        if tag in self.LINES and self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        self.stack.append((tag, tag in ("footer", "aside", "header") or dict(attrs).get("class") == "ad"))

    def handle_endtag(self, tag):
        if tag in self.LINES:
            self.flush()
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = [t for t, _ in self.stack]
        if not {"script", "style", "title"} & set(tags):
            self.parts.append((data, any(c for _, c in self.stack), "a" in tags, "article" in tags, "nav" in tags))


def slow_text(page, surge=86, width=3):
    """The same by brute force: every window summed for itself, every line looked at with all windows before and after."""
    lines = Slow(page).lines
    marked = any(inside and not chrome for _, _, chrome, _, inside in lines)
    w = [0 if chrome or marked and not inside else plain for _, plain, chrome, _, inside in lines]
    window = []
    for i in range(len(w)):
        window.append(0)
        for j in range(i, min(len(w), i + width)):
            if lines[j][2]:
                break
            window[-1] += w[j]
    found = []
    for i in range(len(w)):
        if window[i] and (not i or not window[i - 1]):
            b = i
            while b < len(w) and window[b]:
                b += 1
            a = next(j for j in range(i, b) if w[j])
            found.append((max(window[a:b]), sum(w[a:b]), -a, b))
    high = [f for f in found if f[0] > (0 if marked else surge)] or [max(found, key=lambda f: f[1:3])] if found else []
    keep = {i for _, _, a, b in high for i in range(-a, b)}
    if marked and keep:  # one article a page in these tables
        keep = {i for i, x in enumerate(lines) if x[4]}
    return "\n".join(x[0] for i, x in enumerate(lines) if i in keep and not x[2] and not x[3] and (marked or w[i]))


@pytest.fixture(scope="module")
def pages():
    return [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]


def test_all_pages_as_by_brute_force(pages):
    assert len(pages) == 250 and all(main_text(p) == slow_text(p) for p in pages)


def test_windows_find_the_article_without_its_mark(pages):
    """On each page the windows alone make the result: with the mark taken away it is the same."""
    plain = [re.sub(r"(</?)article\b", r"\1div", p) for p in pages]
    decided = sum(main_text(b) == main_text(a) == slow_text(b) != "" for a, b in zip(pages, plain))
    assert decided == len(pages)


def test_windows_drop_what_the_rules_keep(pages):
    """The menu of every page is left out by its density: no rule of elements says that it isn't the article's."""
    for p in pages:
        p = re.sub(r"(</?)(?:article|nav)\b", r"\1div", p)
        clear = [x for x in M.lines(p) if not x.chrome]
        kept = M.kept_lines(M.lines(p))
        assert not any(x.chrome or x.menu for x in clear) and len(kept) < len(clear) and {x for x in clear if x not in kept} == {x for x in clear if not x.plain}


@pytest.mark.parametrize(("page", "want"), [
    (f"<article><p>{LONG}</p><p class='notice-of-motion'>Motion</p><section id='related-work'><p>Work</p></section><h2 id='comment-on-results'>Results</h2></article>", [LONG.strip(), "Motion", "Work", "Results"]),
    (f"<article><p>{LONG}</p><div class='ad-slot-2'>buy</div><div id='cookiebar'>c</div><div class='x social-share'>s</div><div class='relatedPosts'>r</div><section class='comments-area'>{LONG}</section></article>", [LONG.strip()]),
    (f"<div><p>{LONG}</p><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><p>The end.</p></div><div><a>m</a></div><p>out</p>", [LONG.strip(), "The end."]),
    (f"<p><a href=1>{LONG}</a></p><p>tiny</p>", [LONG.strip(), "tiny"]),
    (f"<div><p>{LONG}</p></div><footer>f</footer><div><p>short</p></div>", [LONG.strip()]),
    (f"<article><a>1</a></article><article><a>2</a></article><article><p>{LONG}</p><p><a>source</a></p><nav><a>up</a></nav></article><div>{LONG}</div>", [LONG.strip(), "source"]),
    ("<div><a>a</a></div><div><a>b</a></div>", [""]),
])
def test_what_windows_and_marks_keep(page, want):
    assert main_text(page) == "\n".join(want)


def test_long_page():
    assert len(main_text("<article>" + "<p>word</p>" * 50000 + "</article>").split("\n")) == 50000
    assert main_text("<" * 50000 + "<article>x") .endswith("x")


def test_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "k"), (2, None, None, None), (2, None, None, None)], "page_id long, url string, html string, n_chars string")
    out = extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    assert len(rows) == 3 and all(r.n_chars == len(r.text) for r in rows) and rows[1].text == ""
    assert extract(df.limit(0)).collect() == []
    assert extract(df.withColumn("score", F.lit(1))).columns[:3] == ["page_id", "url", "score"]
