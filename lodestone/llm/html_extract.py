"""Main-text extraction by line-block distribution.

A page is stripped of markup to lines, one per block element. A line's weight is the length of its text outside links.
Sums of the weights over sliding windows of WINDOW lines are the distribution of text along the page. It dives where a
window holds no weight; what lies between two dives is a stretch of text, and a stretch is kept if the distribution
surges in it, to SURGE characters in some window. All lines from the first to the last with weight are kept of such a
stretch, those of links among them too, and lines of links between two kept stretches, so a list of links inside a text
stays. Where no window of a page reaches SURGE, half the largest sum is the threshold. Nothing else decides: article
and main elements are blocks like others (but a header inside them is a heading, not the page's).

What is no text of the page makes no lines: scripts, styles, forms, menus, the page's header and footer, sidebars,
notices, adverts and readers' comments, by element or by a class, id or role that consists of such names. On the
distribution such a part counts as a dive (WINDOW lines of weight 0), except between two lines of the element that it
stands in: an advert inside a text doesn't end it.

Null and empty pages give an empty text. Rows are independent; columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

WINDOW = 3
SURGE = 80

BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CHROME_TAGS = frozenset("nav footer aside form button select textarea label menu dialog iframe noscript template svg canvas audio video object head title".split())
CHROME_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comments comment commentlist disqus replies pagination pager toolbar skip masthead topbar".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that may stand beside such a name in a class: ad-slot, site-footer, comment-list.
BESIDE = frozenset("site page main top bottom left right box bar list block wrapper wrap container content area section widget slot unit inner outer item items link links post posts button title text header global primary secondary".split())
MAIN = ("article", "main")
#: Elements that hold lines of their own; p, li and headings are lines.
HOLDERS = frozenset("article blockquote body center dd details div fieldset figure header li main ol section table tbody td th tr ul".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*>""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def is_chrome(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in CHROME_TAGS or tag == "header" and not in_main:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if _HIDDEN.search(attrs):
        return True
    names = (x for m in _NAMES.finditer(attrs) for x in (m[1] or m[2] or m[3] or "").lower().split())
    if tag in MAIN:
        return any(x.split("-")[0] in ("comment", "comments") for x in names)
    return any(map(names_chrome, names))


def names_chrome(name: str) -> bool:
    """Whether a class, id or role consists of chrome's names and words that stand beside them: ad, cookie-notice, site_footer, but not share-of-market."""
    parts = re.split(r"[_\-]+|(?<=[a-z])(?=\d)", name)
    return any(x in CHROME_NAMES for x in parts) and all(x in CHROME_NAMES or x in BESIDE or x.isdigit() or not x for x in parts)


class Line(NamedTuple):
    """A line of text outside chrome; text None: a line of weight 0 in place of chrome."""

    text: str | None
    weight: int
    holder: int = -1


def lines_of(page: str, window: int = WINDOW) -> list[Line]:
    """The lines of a page in order."""
    lines: list[Line] = []
    gaps: list[int] = []  # holders of the chrome since the last line
    parts: list[str] = []
    holders: list[tuple[str, int]] = [("", 0)]  # open holders, numbered
    linked = 0  # characters of the line inside links
    mains = links = depth = opened = 0  # open main elements and links; open elements named as the chrome's outermost; holders so far
    chrome = ""
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            holder = holders[-1][1]
            if gaps:
                inside = lines and lines[-1].holder == holder and set(gaps) == {holder}
                lines.extend([Line(None, 0, holder)] * (min(len(gaps), window - 1) if inside else window))
                gaps.clear()
            lines.append(Line(text, max(0, len(text) - linked), holder))
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at and not chrome:
            parts.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        if not m["tag"]:
            continue
        tag, closing = m["tag"].lower(), bool(m["close"])
        if chrome and tag in MAIN and chrome not in MAIN:  # chrome that was never closed
            chrome, depth = "", 0
        if chrome:
            if tag == chrome and not m["attrs"].endswith("/"):
                depth += -1 if closing else 1
                if depth == 0:
                    chrome = ""
            continue
        if tag in BLOCKS:
            flush()
            links = 0
        elif tag == "br":
            parts.append(" ")
        if not closing and tag not in VOID and not m["attrs"].endswith("/") and is_chrome(tag, m["attrs"], mains > 0):
            flush()
            gaps.append(holders[-1][1])
            chrome, depth = tag, 1
            continue
        if tag in MAIN:
            mains = max(0, mains + (-1 if closing else 1))
        elif tag == "a":
            links = 0 if closing else 1
        if tag in HOLDERS:
            if not closing:
                opened += 1
                holders.append((tag, opened))
            elif any(x == tag for x, _ in holders):
                while holders.pop()[0] != tag:
                    pass
    if not chrome:
        parts.append(page[at:])
    flush()
    return lines


def window_sums(weights: list[int], window: int = WINDOW) -> list[int]:
    """The distribution: the sum of each window, by its first line."""
    upto = [0, *accumulate(weights)]
    return [upto[min(i + window, len(weights))] - upto[i] for i in range(len(weights))]


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """[first, end) of what lies between dives, from a line with weight to a line with weight."""
    out: list[tuple[int, int]] = []
    for i, w in enumerate(weights):
        if w and out and i - out[-1][1] < window:
            out[-1] = out[-1][0], i + 1
        elif w:
            out.append((i, i + 1))
    return out


def kept_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """[first, end) of the kept parts, in order."""
    sums = window_sums([x.weight for x in lines], window)
    most = max(sums, default=0)
    least = surge if most >= surge else most / 2
    out: list[tuple[int, int]] = []
    for first, end in stretches([x.weight for x in lines], window):
        if max(sums[first:end]) < least:
            continue
        if out and all(x.text is not None and not x.weight for x in lines[out[-1][1] : first]):
            out[-1] = out[-1][0], end
        else:
            out.append((first, end))
    return out


def main_text(page: str) -> tuple[str, int, int]:
    """(text, number of lines, number of kept lines)."""
    lines = lines_of(page)
    kept = [x.text for first, end in kept_lines(lines) for x in lines[first:end] if x.text]
    return " ".join(kept), sum(x.text is not None for x in lines), len(kept)


def extract(columns: list[pa.Array]) -> list:
    found = [main_text(x or "") for x in columns[2].to_pylist()]
    return [columns[0], columns[1], [t for t, _, _ in found], [len(t) for t, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found]]


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_kept: one row per page."""
    return by_batch(pages.select("page_id", "url", F.col("html").cast("string").alias("html")), extract, "page_id bigint, url string, text string, n_chars bigint, n_lines bigint, n_kept bigint", "html")
