"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block is described by its word
count and link density, by those of the block before and after it, and by marks
of where it stands (an article, a menu, a footer, an element whose class says
advert or comments). The tree is grown on a small labelled table of blocks: of
pages with marks, and of pages without any, where counts and densities are all
there is to go by.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by what they do to text.
RAW = {"script", "style", "template", "iframe", "noembed", "noframes", "title", "textarea"}
BREAKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
SPACES = {"br", "img", "input"}
#: Elements that are kept on the stack of what is open.
HELD = {"article", "main", "nav", "header", "footer", "aside", "form", "menu", "div", "section", "ul", "ol", "dl", "li", "table", "figure", "details", "dialog", "button", "select", "fieldset", "search"}
BOILER = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "search"}
#: Without an end tag these rule nothing: the page's content may follow.
LEADING = BOILER - {"footer"} | {"header"}
# Words of class names and roles that are not of an article. A name counts if all its words are here or in PLAIN.
MARKED = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "breadcrumb", "breadcrumbs", "complementary", "consent", "contentinfo", "cookie", "cookies",
    "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion",
    "recommended", "related", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "topbar",
}
COMMENTS = {"comment", "comments", "disqus", "replies", "reply", "respond"}
PLAIN = {"area", "bar", "block", "body", "bottom", "box", "buttons", "container", "footer", "inner", "item", "left", "link", "links", "list", "main", "outer", "page", "right", "section", "site", "slot", "thread", "top", "widget", "wrapper"}
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_CLASS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")


class Element:
    """An open element: its marks, and whether its own end tag came."""

    __slots__ = ("name", "marked", "comments", "header", "closed")

    def __init__(self, name: str, rest: str) -> None:
        self.name, self.marked, self.comments, self.header, self.closed = name, False, False, name == "header", False
        if "=" in rest:
            for a, b, c in _CLASS.findall(rest):
                for token in _CAMEL.sub("-", a or b or c).lower().split():
                    words = {*_WORDS.findall(token)}
                    self.header |= "header" in words and words <= PLAIN | {"header"}
                    if words and words <= MARKED | COMMENTS | PLAIN:
                        self.comments |= bool(words & COMMENTS)
                        self.marked |= bool(words & MARKED)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    within: tuple[Element, ...]

    def marks(self) -> tuple[bool, bool, bool, bool, bool, bool]:
        """article, main, boiler, header, hinted, item. An article or main text begins anew within elements that have no end tag, or only a class."""
        article = main = header = item = comments = hinted = False
        boiler: list[Element] = []
        for e in self.within:
            comments |= e.comments
            if e.name in ("article", "main"):
                article |= e.name == "article"
                main |= e.name == "main"
                hinted = header = item = False
                boiler = [b for b in boiler if b.closed]
            else:
                hinted |= e.marked
                item |= e.name == "li"
                header |= e.header and not (article or main) and e.closed
                if e.name in BOILER and (e.closed or e.name not in LEADING):
                    boiler.append(e)
        return article, main, bool(boiler), header, hinted or comments, item


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order, without markup, comments, scripts and styles; references decoded."""
    page = page or ""
    out: list[Block] = []
    parts: list[str] = []
    held: list[Element] = []
    heading, linked, in_link = False, 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                out.append(Block(text, len(text.split()), linked, heading, tuple(held)))
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        piece = html.unescape(piece) if "&" in piece else piece
        parts.append(piece)
        if in_link:
            linked += len(piece.split())

    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        m = _TOKEN.match(page, begin)
        if not m:  # a plain less-than sign
            add(page[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            add(page[at:begin])
        at = m.end()
        slash, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not slash and not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in ("script", "style"):  # no text to the page's end; other raw elements without an end lose their tag alone
                    at = n
            parts.append(" ")
        elif name == "a":
            in_link = not slash
        elif name in SPACES:
            parts.append(" ")
        elif name in BREAKS:
            flush()
            if name[0] == "h" and name[1:].isdigit():
                heading = not slash
            elif name == "p":
                heading = False
            if name in HELD:
                if slash:
                    for k in range(len(held) - 1, -1, -1):
                        if held[k].name == name:
                            held[k].closed = True
                            del held[k:]
                            break
                elif not rest.endswith("/"):
                    if name == "li":  # an open item ends where the next begins in the same list
                        for k in range(len(held) - 1, -1, -1):
                            if held[k].name in ("ul", "ol", "menu"):
                                break
                            if held[k].name == "li":
                                del held[k:]
                                break
                    held.append(Element(name, rest))
                    in_link = False
    flush()
    return out


NAMES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "article", "main", "boiler", "header", "hinted", "item"]


def features(found: list[Block]) -> np.ndarray:
    """A row for each block; beyond the page's ends, blocks of no words."""
    own = [(b.words, b.linked / max(1, b.words)) for b in found]
    padded = [(0, 0.0), *own, (0, 0.0)]
    return np.array(
        [[*padded[k + 1], *padded[k], *padded[k + 2], b.heading, *b.marks()] for k, b in enumerate(found)],
        dtype=float,
    ).reshape(-1, len(NAMES))


# Skeletons of pages. M marks main text, B the rest; n words follow.
SKELETONS = [
    '<html><head><title>t</title></head><body><nav><ul><li><a href="/">{B1}</a></li><li><a href="/x">{B1}</a></li><li><a href="/y">{B2}</a></li></ul></nav><div class="ad">{B12}</div><article><h1>{M8}</h1><p>{M60}</p><p>{M1}</p><p>{M30}</p></article><footer>&copy; {B9}</footer></body></html>',
    '<body><nav><a href="/">{B1}</a> <a href="/x">{B1}</a></nav><article><h1>{M3}</h1><p><b>{M2}<br><p>{M1}</p><p>{M3}</p></article><footer>{B30}</footer></body>',
    '<body><header><h1>{B3}</h1><p>{B6}</p></header><main><article><header><h1>{M9}</h1></header><p>{M45}</p><div class="advert">{B20}</div><p>{M80}</p><section class="comments"><h3>{B2}</h3><p>{B25}</p><p>{B40}</p></section></article></main><aside><h2>{B2}</h2><p>{B35}</p></aside><footer>{B14}</footer></body>',
    '<body><div id="menu"><ul><li><a href="/">{B1}</a><li><a href="/">{B2}</a></ul></div><div id="content"><h2>{M6}</h2><p>{M50}</p><p>{M70}</p><p>{M4}</p></div><div id="sidebar"><p>{B25}</p><ul><li><a href="/">{B5}</a></li></ul></div><div id="footer">{B12}</div></body>',
    '<body><div class="cookie-notice"><p>{B22}</p><button>{B1}</button></div><main><h1>{M7}</h1><p>{M35} <a href="/">{M3}</a> {M20}</p><ul><li>{M6}</li><li>{M9}</li></ul><blockquote>{M18}</blockquote></main><form action="/s"><label>{B4}</label><select><option>{B1}</option></select></form><footer><p>{B16}</p></footer></body>',
    '<body><div class="topbar"><a href="/">{B2}</a></div><div class="post"><p>{M90}</p><p>{M12}</p><div class="share"><a href="/">{B1}</a><a href="/">{B1}</a></div></div><div id="comments"><div class="comment"><p>{B30}</p></div><div class="comment"><p>{B60}</p></div></div></body>',
    '<body><p>{M40}</p><p>{M55}</p><p>{M25}</p></body>',
    '<body><article><p>{M2}</p></article><aside>{B50}</aside><footer>{B60}</footer></body>',
    '<body><nav><p>{B40}</p></nav><div class="banner">{B45}</div><article><h2>{M2}</h2><p>{M5}</p><aside class="related"><a href="/">{B6}</a></aside><form><p>{B15}</p></form><p>{M15}</p><ul><li><a href="/">{M4}</a></li><li>{M3}</li></ul></article></body>',
    '<body><article><h1>{M5}</h1><p>{M20}</p><div class="newsletter"><p>{B18}</p><form><input></form></div><p>{M33}</p><footer><p>{B8}</p></footer></article><section id="comments"><article class="comment"><p>{B28}</p></article></section></body>',
    '<body><main><nav><a href="/">{B2}</a><a href="/">{B1}</a></nav><p>{M28}</p><p>{M3}</p><dialog>{B9}</dialog></main><div class="sidebar"><h3>{B2}</h3><ul><li><a href="/">{B4}</a></li></ul></div><footer>{B3}</footer></body>',
    '<body><nav><a href="/">{B1}</a></nav><article><p><a href="/">{M6}</a></p><p>{M50}</p><p><a href="/">{M9}</a></p><p>{M60}</p><ul><li><a href="/">{M3}</a></li><li><a href="/">{M5}</a></li></ul><p>{M2}</p><aside><a href="/">{B5}</a></aside><p>{M40}</p><p><a href="/">{M2}</a></p></article></body>',
    '<body><article><div class="share"><a href="/">{B1}</a></div><p>{M44}</p><div class="related"><p><a href="/">{B8}</a></p></div><p>{M33}</p><nav><a href="/">{B3}</a></nav><p><a href="/">{M7}</a></p><form><a href="/">{B2}</a> {B9}</form><p>{M25}</p></article><div class="ads"><a href="/">{B4}</a></div></body>',
    '<body><main><p><a href="/">{M5}</a></p><p>{M30}</p><div class="sponsor"><a href="/">{B6}</a></div><p>{M3}</p><ul><li><a href="/">{M4}</a></li><li>{M20}</li></ul></main><div class="cookies">{B40}</div></body>',
    '<body><main><form>{B2}</form><p>{M3}</p><p>{M2}</p></main><aside>{B3}</aside><footer>{B5}</footer></body>',
    '<body><div>{B6}</div><main><h1>{M4}</h1><p>{M9}</p><p>{M6}</p></main><div>{B8}</div><div>{B4}</div></body>',
    # pages without marks: runs of links and short blocks beside them, and the text between
    '<body><table><tr><td><a href="/">{B1}</a></td><td><a href="/">{B1}</a></td></tr></table><table><tr><td>{M75}</td></tr><tr><td>{M42}</td></tr></table><p><a href="/">{B3}</a></p></body>',
    '<body><div><a href="/">{B1}</a></div><div><a href="/">{B2}</a></div><div><a href="/">{B1}</a></div><div>{M6}</div><div>{M60}</div><div>{M9}</div><div>{M45}</div><div>{M80}</div><div><a href="/">{B3}</a> <a href="/">{B2}</a></div><div>{B6}</div></body>',
    '<body><p><a href="/">{B2}</a> {B1} <a href="/">{B2}</a></p><p>{M55}</p><p>{M30} <a href="/">{M3}</a> {M25}</p><p>{M12}</p><p>{M40}</p><p><a href="/">{B5}</a></p><p><a href="/">{B6}</a></p><p><a href="/">{B4}</a></p><p>{B5} <a href="/">{B2}</a></p></body>',
    '<body><p>{M60}</p></body>',
    '<body><div><a href="/">{B2}</a></div><div>{M70}</div><div>{B5}</div></body>',
    '<body><p>{B4}</p><p>{M40}</p><p>{M30}</p><p>{B6}</p></body>',
    '<body><p><a href="/">{B1}</a></p><p>{M90}</p></body>',
    '<body><center>{B3}</center><center><a href="/">{B1}</a> <a href="/">{B1}</a></center><h2>{M5}</h2><div>{M35}</div><div>{M50}</div><h3>{M4}</h3><div>{M70}</div><div>{B4} <a href="/">{B3}</a></div></body>',
    '<body><ul><li><a href="/">{B2}</a></li><li><a href="/">{B1}</a></li><li><a href="/">{B3}</a></li></ul><div>{B8}</div><ul><li><a href="/">{B2}</a></li></ul><div>{M25}</div><div>{M90}</div><div>{M3}</div><div>{M65}</div><ul><li><a href="/">{B7}</a></li><li><a href="/">{B8}</a></li></ul></body>',
]
#: Variants of each skeleton; depth and smallest leaf of the tree.
VARIANTS = 40
DEPTH = 10
LEAF = 2


def labelled_blocks(variants: int = VARIANTS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main text) of the skeletons' blocks. Each variant leaves some blocks out, so neighbours vary as word counts do."""
    rng = random.Random(seed)
    x, y = [], []

    def filled(m: re.Match) -> str:
        if rng.random() < 0.25:
            return ""
        return " ".join([f"{m[1]}word"] * max(1, int(int(m[2]) * rng.choice([0.5, 0.8, 1, 1, 1.3, 2]))))

    for _ in range(variants):
        for skeleton in SKELETONS:
            found = blocks(re.sub(r"\{([MB])(\d+)\}", filled, skeleton))
            x.append(features(found))
            y += [int("Mword" in b.text) for b in found]
    return np.vstack(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF):
    """A classification tree by Gini impurity: a label, or (feature, threshold, at most, above)."""
    share = y.mean() if len(y) else 1.0
    if depth == 0 or share in (0, 1) or len(y) < 2 * leaf:
        return int(share >= 0.5)
    best = (len(y) * share * (1 - share) - 1e-9, None)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, t = x[order, k], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= leaf) & (len(y) - n >= leaf)
        if not ok.any():
            continue
        p, q = t[:-1] / n, (t[-1] - t[:-1]) / (len(y) - n)
        cost = np.where(ok, n * p * (1 - p) + (len(y) - n) * q * (1 - q), np.inf)
        i = int(np.argmin(cost))
        if cost[i] < best[0]:
            best = (cost[i], (k, float((v[i] + v[i + 1]) / 2)))
    if best[1] is None:
        return int(share >= 0.5)
    k, at = best[1]
    low = x[:, k] <= at
    under, over = grow(x[low], y[low], depth - 1, leaf), grow(x[~low], y[~low], depth - 1, leaf)
    return under if under == over and isinstance(under, int) else (k, at, under, over)


@cache
def trained():
    return grow(*labelled_blocks())


def main_text(page: str | None, tree) -> str:
    """The main blocks in page order, joined by an empty line."""
    found = blocks(page)
    kept = []
    for b, row in zip(found, features(found).tolist(), strict=True):
        node = tree
        while not isinstance(node, int):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        if node:
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points), one row per input row.

    Null and empty pages, and pages without main text, give an empty text. Pages
    are read whole, however long. An unclosed comment, script, style or tag runs
    to the page's end; other elements without an end tag never swallow what
    follows: an article begins anew within them. Repeated rows are extracted
    each; a null id is kept; only the three named columns are read, so others
    may have any name. Empty tables give no rows.
    """
    tree = trained()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), tree) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(made, "page_id long, url string, text string, n_chars long")
