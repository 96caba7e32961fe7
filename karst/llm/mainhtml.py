"""Main text of web pages by line-block distribution.

1. Markup is stripped by one scan over the tags.  Every block element starts a
   new line; scripts, styles and the like leave nothing.
2. Each line has a weight, the code points of its text that are not in short links:
   menus are made of those.  Lines that no density tells from an article (footers,
   asides, forms, adverts, notices and comments, by element, role, class and id) are
   apart: windows end at them, and they are never kept.
3. Weights are summed over windows of ``WINDOW`` lines.  A surge is a line where the
   window rises from zero and, before it falls to zero again, above ``SURGE``; the
   dive is where it falls.  Lines between surges and their dives are the text.  If no
   window rises that high, the heaviest run of windows above zero is.
4. Where a page marks its article (``article``, ``main``, role main, itemprop
   articleBody, or holders by their names with most of the text), the mark narrows
   what windows see to its lines, and widens what they find: a marked element that a
   run of windows reaches is kept whole.  Without a mark a surge reaches out to the
   weighty lines of the elements that hold its lines.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.common import arrow_map

WINDOW, SURGE = 3, 86
#: Code points from which a link is text and no entry of a menu.
LINK = 80

#: Elements that begin and end a line.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text up to their end tag.
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes svg math object canvas audio video title".split())
#: Elements that are not the article's own text, whatever their density.
CHROME = frozenset("header footer aside form dialog head button select option label fieldset search".split())
#: Elements and roles whose text weighs as that of links.
MENUS, MENU_ROLES = frozenset("nav menu".split()), frozenset("navigation menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("banner contentinfo complementary search form dialog alert alertdialog toolbar".split())
#: Words of class and id values that tell the same.
WORDS = frozenset("ad ads adv advert advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login register sidebar rail widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended recommendations comment comments commentlist respond replies reply disqus discussion pagination pager paginator copyright disclaimer hidden skip donate paywall".split())
OUTER_WORDS = frozenset({"header"})
#: Beginnings of such words that are often run together with others.
STEMS = re.compile(r"(?:^|[^a-z])(?:cookie|advert|comment|sidebar|side-bar|navbar|newsletter|breadcrumb|disqus)", re.I)
#: Words that may stand beside them in a name without making it another one, as in ad-slot but not in notice-of-motion.
NEUTRAL = frozenset("area bar block body bottom box button buttons center container content div element fixed foot footer form head header holder inner item items layer left leaderboard link links list main message mid middle module outer page panel policy post posts right row section site slot space sticky text title top unit view widget wrap wrapper zone".split())
#: Elements that hold lines, rather than being one.
CONTAINERS = frozenset("div section article main td th center table body details summary figure".split())
#: Words of class and id values of an element that holds the article, where nothing marks it better.
HOLDERS = frozenset("article content post entry story main text".split())

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}


class _Open:
    """An open element: what holds inside it, and the number of the element that holds its lines (0 for the page)."""

    __slots__ = ("tag", "chrome", "link", "menu", "inside", "held")

    def __init__(self, tag: str, chrome: bool, link: bool, menu: bool, inside: frozenset[int], held: int):
        self.tag, self.chrome, self.link, self.menu, self.inside, self.held = tag, chrome, link, menu, inside, held


class Line(NamedTuple):
    """A line of a page.

    ``plain`` counts code points outside short links, ``chrome`` says that it is no
    article's and ``menu`` that it stands in a menu.  ``inside`` has the marked elements
    around it: a mark is a positive number, or negative if the element stands inside
    chrome; it is odd for a marked article and even for an element that may hold one by
    its name.  ``held`` is the element that holds it, 0 for the page.
    """

    text: str
    plain: int
    chrome: bool
    menu: bool
    inside: frozenset[int]
    held: int


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(text)} if text and "=" in text or "hidden" in text else {}


def _is_chrome(tag: str, at: dict[str, str], inner: bool) -> bool:
    if tag in CHROME or at.get("role", "").lower() in ROLES or "hidden" in at and tag not in ("body", "html") or at.get("aria-hidden") == "true":
        return True
    if "style" in at and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at["style"], re.I):
        return True
    if tag in ("html", "body"):
        return False
    names = at.get("class", "") + " " + at.get("id", "")
    if inner:
        return any(_is_chrome_name(name) for name in names.split())
    named = {w.lower() for w in _WORD.findall(names)}
    return bool(named & WORDS or STEMS.search(names) or named & OUTER_WORDS)


def _is_chrome_name(name: str) -> bool:
    """Whether a name says chrome and nothing else; inside an article a word of the lists may be one of its own."""
    words = [w.lower() for w in _WORD.findall(name)]
    own = lambda w: w in WORDS or bool(m := STEMS.match(w)) and w[m.end() :] in ("", "s") + tuple(NEUTRAL | WORDS)
    return any(map(own, words)) and all(own(w) or w in NEUTRAL or len(w) == 1 for w in words)


def _holds(tag: str, at: dict[str, str]) -> bool:
    return tag in ("div", "section", "td") and bool({w.lower() for w in _WORD.findall(at.get("class", "") + " " + at.get("id", ""))} & HOLDERS)


def lines(page: str) -> list[Line]:
    """The page's lines that have text."""
    out: list[Line] = []
    stack = [_Open("", False, False, False, frozenset(), 0)]
    parts: list[tuple[str, bool, bool]] = []
    marks = held = 0

    def flush() -> None:
        if parts:
            for chrome in (False, True):
                text = " ".join(entities.unescape("".join(t for t, c, _ in parts if c == chrome)).split())
                if text:
                    plain = len("".join(entities.unescape("".join(t for t, c, a in parts if c == chrome and (not a or len(t) >= LINK))).split()))
                    top = stack[-1]
                    out.append(Line(text, 0 if top.menu else plain, chrome, top.menu, top.inside, top.held))
            parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            parts.append((page[at:], stack[-1].chrome, stack[-1].link))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], stack[-1].chrome, stack[-1].link))
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        close, tag, rest = m[1] or m[4], tag.lower(), m[3] or m[6] or ""
        if tag in BLOCKS:
            flush()
        elif tag in ("td", "th", "dt", "option"):
            parts.append((" ", stack[-1].chrome, stack[-1].link))
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "td", "th", "table") and tag not in BLOCKS:
                    break
            continue
        if tag in RAW:
            if not rest.rstrip().endswith("/"):
                e = _END[tag].search(page, at)
                at = e.end() if e else n
            continue
        if tag in VOID:
            continue
        if stack[-1].tag == "p" and tag in BLOCKS:
            stack.pop()
        top, attributes = stack[-1], _attributes(rest)
        inside, chrome = top.inside, top.chrome
        marked = tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
        own = _is_chrome(tag, attributes, any(x % 2 for x in inside))
        if marked and not own:
            marks += 2
            inside = inside | {marks - 1 if not chrome else 1 - marks}
        elif own:
            chrome = True
        elif _holds(tag, attributes):
            marks += 2
            inside = inside | {marks if not chrome else -marks}
        if tag in HEADINGS and top.tag == "header" and inside:
            chrome = False
        if tag in CONTAINERS:
            held += 1
        menu = top.menu or tag in MENUS or attributes.get("role", "").lower() in MENU_ROLES
        stack.append(_Open(tag, chrome, top.link or tag == "a", menu, inside, (0 if tag == "body" else held) if tag in CONTAINERS else top.held))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page; empty if there is none."""
    return "\n".join(x.text for x in kept_lines(lines(page))) if page else ""


def kept_lines(found: list[Line]) -> list[Line]:
    """The lines of the main text: ``spans`` of the windows, narrowed and widened by marks."""
    marks = _marks(found)
    seen = [not x.chrome and (not marks or bool(x.inside & marks)) for x in found]
    weight = np.array([x.plain if s else 0 for x, s in zip(found, seen)], np.int64)
    breaks = np.array([x.chrome for x in found], bool)
    reached = [i for a, b in spans(weight, breaks, 0 if marks else SURGE) for i in range(a, b) if seen[i]]
    if marks:
        whole = {m for i in reached for m in found[i].inside & marks}
        return [x for x, s in zip(found, seen) if s and not x.menu and x.inside & whole]
    held = {found[i].held for i in reached if weight[i]} - {0}
    picked = set(reached)
    return [x for i, x in enumerate(found) if weight[i] and not x.menu and (i in picked or x.held in held)]


def _marks(found: list[Line]) -> set[int]:
    """All marked articles, side by side or one in another; else all elements named as holders, if they have the bulk of all text."""
    clear = [x for x in found if not x.chrome and not x.menu]
    marks = {m for x in clear for m in x.inside if m > 0}
    if articles := {m for m in marks if m % 2}:
        return articles
    size = lambda rows: sum(len(x.text) for x in rows)
    return marks if 5 * size(x for x in clear if x.inside & marks) >= 3 * size(clear) else set()


def spans(weight: np.ndarray, breaks: np.ndarray | None = None, surge: int = SURGE) -> list[tuple[int, int]]:
    """Lines from each surge to its dive, as (first, one after the last); no window goes beyond a line of ``breaks``."""
    if not weight.any():
        return []
    window = weight.copy()
    open_ = np.ones(len(weight), bool) if breaks is None else ~breaks
    for k in range(1, WINDOW):
        open_ = open_[:-1] & (True if breaks is None else ~breaks[k:])
        if not len(open_):
            break
        window[: len(open_)] += np.where(open_, weight[k:], 0)
    rises = np.diff((window > 0).astype(np.int8), prepend=0, append=0)
    # A window rises before its first line with weight is reached; the text begins at that line.
    runs = [(a + int(np.flatnonzero(weight[a:b])[0]), b) for a, b in zip(np.flatnonzero(rises == 1).tolist(), np.flatnonzero(rises == -1).tolist())]
    high = [(a, b) for a, b in runs if window[a:b].max() > surge]
    return high or [max(runs, key=lambda r: weight[r[0] : r[1]].sum())]


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``html`` replaced by ``out``, the main text, and n_chars, its code points.

    Null, empty and text-free pages give an empty text.  A page that breaks off
    keeps what it has.  Columns of ``pages`` named ``out`` or n_chars give way to the
    new ones; all others stay.  One row in, one row out; no shuffle.
    """
    rest = [c for c in pages.columns if c not in (html, out, "n_chars")]

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in b.column(b.schema.get_field_index(html)).to_pylist()]
        kept = [b.column(b.schema.get_field_index(c)) for c in rest]
        return pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, out, "n_chars"])

    schema = type(pages.schema)([pages.schema[c] for c in rest]).add(out, "string").add("n_chars", "long")
    return arrow_map(pages.select(*rest, F.col(html).cast("string").alias(html)), f, schema)
