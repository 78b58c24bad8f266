"""HTML extraction by line-block distribution.

Markup is stripped to lines, one for each block of the page. A line weighs its
length without links; inside an article (or main) element it weighs ARTICLE_X
times its length, and lines outside then weigh nothing; lines of menus,
headers, footers, sidebars, notices, adverts, forms and reader comments weigh
nothing and are never text. The weights are summed over a sliding window of
lines. Text surges at a line with weight whose window passes the threshold (or
half the page's largest window, on pages that are all short) while the next
line goes on or the line alone passes it; it dives where a whole window weighs
nothing, or at the end. The lines between a surge and the last one with weight
before its dive are kept. What comes after a dive needs a surge of its own, in
an article as elsewhere.

Defined cases: null and empty html give an empty text; a page without an
article or main element is read by lengths alone; unclosed elements end with
the page; a < that begins no whole tag is text; repeated rows are read alike;
an empty table gives an empty table; columns that aren't named in keep aren't
read. Time is linear in the page, however deep its elements are.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, THRESHOLD = 3, 80
#: How much more a line weighs inside an article element.
ARTICLE_X = 8

#: Comments, elements whose content is never text, and tags.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title|head)\b(?:[^<>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL | re.IGNORECASE)
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav header footer aside form menu dialog button label fieldset".split())
NAMED = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
#: Words of class, id and role names that mark what isn't the article.
BAD = frozenset("ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended cookie cookies consent notice alert popup modal newsletter subscribe subscription comment comments reply replies respond disqus share sharing social login signup search pagination pager toolbar copyright legal complementary contentinfo".split())
GAP = re.compile(r"[\s ]+")


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, whether it may be main text) of each block of the page."""
    lines: list[tuple[str, int, bool, bool]] = []  # text, length without links, apart, inside an article
    stack: list[tuple[str, bool, bool]] = []  # tag, apart, article
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = apart = article = 0
    seen = False

    def flush() -> None:
        nonlocal linked
        line = GAP.sub(" ", entities.unescape("".join(text))).strip()
        if line:
            lines.append((line, max(len(line) - linked, 0), apart > 0, article > 0))
        text.clear()
        linked = 0

    def leave() -> None:
        nonlocal apart, article
        tag, was_apart, was_article = stack.pop()
        opened[tag] -= 1
        apart -= was_apart
        article -= was_article

    at = 0
    for m in TOKEN.finditer(page):
        piece = page[at : m.start()]
        at = m.end()
        if piece:
            text.append(piece)
            if opened["a"]:
                linked += len(piece.strip())
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        if m[2]:
            if opened[tag]:
                while stack[-1][0] != tag:
                    leave()
                leave()
        elif tag not in VOID and not m[4].rstrip().endswith("/"):
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                leave()
            names = re.split(r"[^a-z]+", " ".join("".join(x) for x in NAMED.findall(m[4])).lower()) if m[4] else ()
            is_article = tag in ("article", "main")
            bad = (tag in APART and not (tag == "header" and article)) or (not is_article and tag not in ("body", "html") and not BAD.isdisjoint(names))
            seen |= is_article and not apart
            stack.append((tag, bad, is_article))
            opened[tag] += 1
            apart += bad
            article += is_article
    text.append(page[at:])
    flush()
    out = []
    for line, own, is_apart, inside in lines:
        main = not is_apart and (inside or not seen)
        out.append((line, (len(line) * ARTICLE_X if inside else own) if main else 0, main))
    return out


def surges(weights: list[int], window: int, threshold: int) -> list[tuple[int, int]]:
    """(surge, dive) pairs: the lines from a surge up to, not with, its dive are text."""
    n = len(weights)
    total = [0, *accumulate(weights)]
    block = [total[min(i + window, n)] - total[i] for i in range(n)]
    least = min(threshold, max(block, default=0) // 2)
    found = []
    i = 0
    while i < n:
        goes_on = weights[i] > least or (i + 1 < n and weights[i + 1] > 0)
        if weights[i] == 0 or block[i] <= least or not goes_on:
            i += 1
            continue
        dive = i
        while dive < n and block[dive] > 0:
            dive += 1
        found.append((i, dive))
        i = dive
    return found


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The lines between surges and dives, joined by newlines."""
    if not page:
        return ""
    lines = page_lines(page)
    kept: list[str] = []
    for surge, dive in surges([w for _, w, _ in lines], window, threshold):
        kept += [line for line, _, main in lines[surge:dive] if main]
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep of pages, with text (main text, empty if none) and n_chars (its code points)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[list(keep)].assign(text=[main_text(x) for x in pdf["__html"]])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    out = pages.select(*keep, F.col(html_col).alias("__html")).mapInPandas(run, f"{schema}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
