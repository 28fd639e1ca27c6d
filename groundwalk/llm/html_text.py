"""Main text of web pages by the line-block distribution.

Markup is stripped to lines, one for each block of text. Containers that never hold an article (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) leave one empty line. A line weighs as many
characters as it has outside links, and the weights of WINDOW neighbouring lines are summed. Where the sum reaches the
threshold the text surges, where it falls below it dives; what the sums between cover is one stretch, so a short
paragraph goes with its long neighbours, also across an advert. Links at the ends of a stretch are left off; inside it
nothing is. Where article elements (or else main elements) mark the text, the distribution's edges are theirs: all of
their lines are kept, of all of them, and no others.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Weight that a block needs; less if no block of the page has twice as much.
SURGE = 50
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(?=/?[a-zA-Z])[^>]*+(?:>|\Z)""", re.S)
# Elements of HTML by how they are laid out.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes", "noembed"}
_OUT = {"nav", "footer", "aside", "form", "head", "svg", "template", "button", "select", "object", "canvas", "dialog", "menu", "audio", "video", "datalist", "fieldset"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
_IMPLIED = {"p": _BLOCK, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
# Words of class, id and role that name what is not the article, and words for its place or shape.
_HINTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "adbox", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "commentlist", "complementary", "contentinfo", "cookie", "cookies",
    "consent", "disqus", "footer", "header", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "promoted", "promotion",
    "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "alert",
}
_SHAPES = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "container", "content", "form", "global", "group", "holder", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer",
    "overlay", "page", "panel", "primary", "right", "row", "secondary", "section", "site", "slot", "space", "text", "thread", "title", "top", "unit", "wrap", "wrapper", "zone",
}
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _unwanted(name: str, attributes: str, in_article: bool) -> bool:
    if name in _OUT or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for found in _NAMES.finditer(attributes):
        # A name counts as a whole: `ad-box` and `cookie-notice` do, `share-price` does not.
        for whole in (found[1] or found[2] or found[3] or "").lower().split():
            words = [w for w in re.split(r"[_\-\d]+", whole) if w]
            if not _HINTS.isdisjoint(words) and all(w in _HINTS or w in _SHAPES for w in words):
                return True
    return False


def lines(page: str) -> list[tuple[str, int, float]]:
    """(text, article, share of it in links) in page order; empty lines where something was cut out.

    `article` numbers the outermost article element (or main element, negative) that holds the line, 0 for none.
    """
    out: list[tuple[str, int, float]] = []
    text: list[str] = []
    linked = at = 0
    article = main = articles = mains = link = 0
    skip, depth = "", 0

    def flush() -> None:
        nonlocal linked
        plain = " ".join(html.unescape("".join(text)).split())
        if plain:
            out.append((plain, articles if article else -mains if main else 0, min(1.0, linked / len(plain))))
        text.clear()
        linked = 0

    def gap() -> None:
        flush()
        out.append(("", 0, 0.0))

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if not skip and stop > at:
            text.append(page[at:stop])
            linked += (stop - at) * bool(link)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if skip:
            if name in ("article", "main", "body") and not (skip == name) and (closing or name != "body"):
                skip = ""  # the skipped element was never closed
            elif not closing and skip in _IMPLIED and name in _IMPLIED[skip]:
                skip = ""
            elif name == skip:
                depth += -1 if closing else 1
                if depth == 0:
                    skip = ""
                    continue
                continue
            elif closing and skip in _IMPLIED and name in _BLOCK:
                skip = ""
            else:
                if not closing and name in _RAW:
                    at = _raw_end(page, at, name)
                continue
        if not closing and name in _RAW:
            flush() if name == "title" else None
            at = _raw_end(page, at, name)
            continue
        if not closing and name not in _VOID and not m[3].endswith("/") and _unwanted(name, m[3], bool(article)):
            gap()
            skip, depth = name, 1
            continue
        if name in ("article", "main"):
            gap()
            if name == "article":
                if not closing:
                    articles += article == 0
                    article += 1
                else:
                    article = max(0, article - 1)
            elif not closing:
                mains += main == 0
                main += 1
            else:
                main = max(0, main - 1)
        elif name in _BLOCK:
            flush()
        elif name in ("br", "wbr"):
            text.append(" " if name == "br" else "")
        elif name == "a":
            link = 0 if closing else 1
    flush()
    return out


def _raw_end(page: str, at: int, name: str) -> int:
    found = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
    return found.end() if found else len(page)


def stretches(weight: np.ndarray, window: int = WINDOW, surge: float = SURGE) -> list[tuple[int, int]]:
    """Line ranges that the sums over `window` lines cover from a surge to the next dive."""
    if not len(weight):
        return []
    total = np.concatenate([[0], np.cumsum(weight)])
    ends = np.minimum(np.arange(len(weight)) + window, len(weight))
    sums = total[ends] - total[:-1]
    live = np.flatnonzero((sums > 0) & (sums >= min(surge, sums.max() / 2)))
    covered = np.zeros(len(weight) + 1, np.int64)
    np.add.at(covered, live, 1)
    np.add.at(covered, ends[live], -1)
    step = np.diff(np.concatenate([[0], (np.cumsum(covered)[:-1] > 0).astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def main_text(page: str | None) -> str:
    found = lines(page or "")
    where = np.array([a for _, a, _ in found], np.int64)
    for marked in (where > 0, where < 0):
        if marked.any():
            return "\n".join(t for (t, _, _), own in zip(found, marked.tolist(), strict=True) if own and t)
    kept = []
    for a, b in stretches(np.array([len(t) * (1 - linked) for t, _, linked in found])):
        while a < b and (not found[a][0] or found[a][2] > 0.5):
            a += 1
        while a < b and (not found[b - 1][0] or found[b - 1][2] > 0.5):
            b -= 1
        kept += [t for t, _, _ in found[a:b] if t]
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            text = [main_text(page) for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per row of pages, without a shuffle.

    A null or blank page, and one of which nothing is the article, has an empty text. Null ids and urls are kept; rows
    that repeat stay; other columns don't matter.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
