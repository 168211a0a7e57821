"""Main text of web pages by tree scoring.

Each paragraph earns points for its length and commas and passes them to its ancestors, the full
amount to the nearest container and half as much to each further one. A container's points are discounted by
the share of its text that is link text. The best container is kept with those siblings that score well;
where an article or main element holds it, all of that element's blocks are its siblings, and so are articles
beside it. Left out are elements whose tag or role makes them menus, headers, footers, sidebars, notices, adverts,
forms or reader comments, lists of short links that no heading introduces, and containers whose class names nothing
but such a part ("cookie-notice", not "related-work"). Ids count like classes outside articles only; paragraphs and
headings are left out only where a class names an advert. A marked container stays if it holds the page's title, most of
its paragraphs where there is no article, or every article of the page (a thread of comments as articles doesn't).
Sums go up and marks go down the tree once each, so a page takes time in proportion to its length.

White space is HTML's: space, tab, line ends, form feed; no-break spaces stay.

Defined results: a null or empty page has empty text; markup cut off at the end of a page is dropped
and all open elements end there; a page without paragraphs gives its article's or body's text. Rows are
independent, so repeated rows give repeated results. Extra columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']+|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)|</?\Z""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([\w:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: HTML's elements by kind.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
LISTS = frozenset("ul ol dl menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul option select".split()
)
PARAGRAPH = frozenset("p pre td li dd blockquote h1 h2 h3 h4 h5 h6 figcaption".split())
JUNK_TAGS = frozenset(
    "head nav footer aside form script style title textarea noscript iframe template svg canvas object button select option menu dialog fieldset "
    "audio video map math datalist search".split()
)
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments disqus respond replies cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations pagination pager widget toolbar toc skip hidden".split()
)
#: Parts of class names that say where an element is, not what it is; elements that class names may mark.
LAYOUT_WORDS = frozenset(
    "site page main top bottom left right global local primary secondary outer inner wrapper wrap container content section area block box bar list item group row col column "
    "panel inline float fixed sticky small large mobile desktop links buttons button icons thread slot unit zone placement user reader readers post posts stories body".split()
)
AD_WORDS = frozenset("ad ads advert adverts advertisement sponsored".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section ul ol dl table td tr header menu details center article".split())
#: Elements that end an open element of the first name, up to the nearest of the others.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
ARTICLE = frozenset(("article", "main"))
SPACE = " \t\n\r\f\v"
SPACES = re.compile(r"[ \t-\r]+")
#: Longest mean link of a list of links that counts as a menu: shorter than what earns points.
SHORT_LINK = 25
WEIGHTS = {"article": 25, "main": 25, "div": 5, "section": 5, "blockquote": 3, "pre": 3, "td": 3, "ul": -3, "ol": -3, "dl": -3, "th": -5}


class Page:
    """Elements in page order (parallel lists; element 0 is the page) and blocks of text pieces."""

    def __init__(self, source: str):
        self.tag, self.parent, self.junk = [""], [-1], [False]
        self.named: list[bool] = [False]  # junk by class or id only
        self.links: list[bool] = [False]  # inside a link
        self.inside: list[bool] = [False]  # an article or inside one
        self.block: list[int] = [0]  # nearest block element, itself included
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []  # (nearest block element, [(element, text)])
        self._open, self._new = [0], True
        self._places: dict[str, list[int]] = {}  # of each tag, where it stands among the open elements
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            found = MARKUP.search(source, at)
            self._text(source[at : found.start()] if found else source[at:])
            if not found:
                return
            at = found.end()
            if not (tag := (found["tag"] or "").lower()):
                continue
            if found["end"]:
                self._end(tag)
                continue
            self._start(tag, found["attrs"])
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else n
                self._end(tag)

    def _text(self, text: str) -> None:
        if not text:
            return
        if self._new and text.strip(SPACE):
            self.blocks.append((self.block[self._open[-1]], []))
            self._new = False
        if not self._new:
            self.blocks[-1][1].append((self._open[-1], html.unescape(text) if "&" in text else text))

    def _start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag in BLOCK:
            self._new = True
            if tag != "option":
                self._close(("p",), ("table", "button", "object"))
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in VOID:
            return
        up = self._open[-1]
        self.tag.append(tag)
        self.parent.append(up)
        named = bool(attrs) and (tag in CONTAINERS and _named(attrs, self.inside[up]) or _advert(attrs))
        self.inside.append(tag in ARTICLE or self.inside[up])
        self.block.append(len(self.tag) - 1 if tag in BLOCK else self.block[up])
        self.junk.append(named or tag in JUNK_TAGS or bool(attrs) and _marked(attrs))
        self.named.append(named and not (tag in JUNK_TAGS or _marked(attrs)))
        self.links.append(tag == "a" or self.links[up])
        if not attrs.rstrip().endswith("/") or tag not in ("svg", "path"):
            self._places.setdefault(tag, []).append(len(self._open))
            self._open.append(len(self.tag) - 1)

    def _end(self, tag: str) -> None:
        self._new = self._new or tag in BLOCK
        self._close((tag,), () if tag in BLOCK else tuple(BLOCK - {"p"}))

    def _close(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        nearest = lambda names: max((self._places[t][-1] for t in names if self._places.get(t)), default=0)
        at = nearest(tags)
        if at and at >= nearest(stops):
            for e in self._open[at:]:
                self._places[self.tag[e]].pop()
            del self._open[at:]

    def _settle(self) -> None:
        """Marks spare what holds the article, its title or most paragraphs; junk covers all below it."""
        n = len(self.tag)
        title, article, marked, chars = [False] * n, [False] * n, [False] * n, [0] * n
        for owner, pieces in self.blocks:
            if self.tag[owner] in PARAGRAPH:
                chars[owner] += sum(len(t) for e, t in pieces if not self.links[e])
        for e in range(1, n):
            marked[e] = marked[self.parent[e]] or self.junk[e] and self.tag[e] not in ("html", "body")
        clean = any(self.tag[e] in ARTICLE and not marked[e] for e in range(1, n))
        for e in range(n - 1, 0, -1):
            title[self.parent[e]] |= self.tag[e] == "h1" or title[e]
            article[self.parent[e]] |= self.tag[e] in ARTICLE and not self.junk[e] or article[e]
            if self.tag[e] not in JUNK_TAGS:
                chars[self.parent[e]] += chars[e]
        for e in range(1, n):
            tag, up = self.tag[e], self.parent[e]
            holds = title[e] or article[e] and not clean
            if tag == "header":
                self.junk[e] = not ((title[e] or article[e]) and self.inside[e])
            elif self.junk[e] and tag not in JUNK_TAGS and (holds or tag in ("html", "body") or self.named[e] and not clean and 2 * chars[e] > chars[0]):
                self.junk[e] = False
            self.junk[e] |= self.junk[up]


def _marked(attrs: str) -> bool:
    """Whether an element is hidden or its role says that it is no part of an article."""
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.strip() in JUNK_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _named(attrs: str, in_article: bool) -> bool:
    """Whether one of a container's class names (outside articles also its id) names a junk part and nothing else."""
    for name, *values in ATTRIBUTE.findall(attrs):
        if name.lower() == "class" or name.lower() == "id" and not in_article:
            for token in "".join(values).lower().split():
                parts = set(re.split(r"[^a-z]+", token)) - {""}
                if parts & JUNK_WORDS and parts <= JUNK_WORDS | LAYOUT_WORDS:
                    return True
    return False


def _advert(attrs: str) -> bool:
    """Whether a class is the plain name of an advert, which is one on any element."""
    return any(name.lower() == "class" and not AD_WORDS.isdisjoint("".join(values).lower().split()) for name, *values in ATTRIBUTE.findall(attrs))


def main_text(source: str | None) -> str:
    """Text of the article's blocks, joined by newlines."""
    page = Page(source or "")
    n, up = len(page.tag), page.parent
    points, chars, linked, count, blocks = [0.0] * n, [0] * n, [0] * n, [0] * n, []
    for owner, pieces in page.blocks:
        kept = [(e, t) for e, t in pieces if not page.junk[e]]
        if text := SPACES.sub(" ", "".join(t for _, t in kept)).strip(" "):
            blocks.append((owner, text))
            chars[owner] += len(text)
            linked[owner] += min(sum(len(t) for e, t in kept if page.links[e]), len(text))
            count[owner] += 1
            paragraph = page.tag[owner] in PARAGRAPH
            if paragraph and page.tag[owner][0] != "h" or len(text) >= 25:
                earned = 1 + text.count(",") + text.count("،") + text.count("、") + min(len(text) // 100, 3)
                # a paragraph's nearest container is above it
                points[max(up[owner], 0) if paragraph else owner] += earned
    if not blocks:
        return ""
    for e in range(n - 1, 0, -1):
        for sums in (chars, linked, count):
            sums[up[e]] += sums[e]
        points[up[e]] += points[e] / 2
    density = [linked[e] / chars[e] if chars[e] else 0.0 for e in range(n)]
    score = [(points[e] + WEIGHTS.get(page.tag[e], 0)) * (1 - density[e]) if points[e] else 0.0 for e in range(n)]
    best = max(range(n), key=lambda e: (score[e], -e))
    if not score[best]:
        articles = [e for e in range(1, n) if page.tag[e] in ARTICLE and chars[e]]
        best = max(articles, key=lambda e: (chars[e], -e), default=0)
    return "\n".join(_kept(page, blocks, _chosen(page, best, score, density, chars), density, chars, count))


def _chosen(page: Page, best: int, score: list[float], density: list[float], chars: list[int]) -> set[int]:
    """The elements whose blocks are the article."""
    if not page.inside[best]:
        return {best, *_siblings(page, best, score, density, chars)}
    whole = best
    while page.inside[page.parent[whole]]:
        whole = page.parent[whole]
    beside = (e for e in range(1, len(page.tag)) if page.parent[e] == page.parent[whole] and page.tag[e] in ARTICLE and not page.junk[e] and score[e] > 0)
    return {whole, *beside}


def _kept(page: Page, blocks: list[tuple[int, str]], chosen: set[int], density: list[float], chars: list[int], count: list[int]) -> Iterator[str]:
    """Texts of the chosen elements' blocks without menus: lists of short links that no heading comes before."""
    n = len(page.tag)
    within, menu, first = [0 in chosen] * n, [0] * n, {}
    for e in range(1, n):
        up = page.parent[e]
        within[e] = within[up] or e in chosen
        menu[e] = menu[up]
        short = page.tag[e] in LISTS and density[e] > 0.9 and count[e] > 1 and chars[e] < SHORT_LINK * count[e]
        if within[e] and e not in chosen and not menu[e] and short:
            menu[e] = e
    before = ""
    for owner, text in blocks:
        at = menu[owner]
        if at and at not in first:
            first[at] = before in HEADINGS and before != "h1"
        before = page.tag[owner]
        if within[owner] and (not at or first[at]):
            yield text


def _siblings(page: Page, best: int, score: list[float], density: list[float], chars: list[int]) -> list[int]:
    least = max(10.0, 0.2 * score[best])
    out = []
    for e in range(1, len(page.tag)):
        if e != best and page.parent[e] == page.parent[best] and not page.junk[e] and chars[e]:
            plain = page.tag[e] == "p" and density[e] < 0.25 and (chars[e] > 80 or not density[e])
            part = page.tag[e] == "section" and density[e] < 0.25 and score[e] > 0
            if score[e] >= least or plain or part or page.tag[e] in ("h1", "h2"):
                out.append(e)
    return out


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page. Narrow: no shuffle."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(main_text, na_action=None)

    extract = F.pandas_udf(run, "string")
    texts = pages.select("page_id", "url", extract(F.coalesce("html", F.lit(""))).alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
