"""Main text of web pages by line-block distribution.

Markup is turned into lines (one per block element), each with a weight. Sums of
weights over a sliding window of lines make the distribution; its first surge
over ``threshold`` and its last dive bound the main text.

A line weighs its characters, or nothing if more than half of them are links or
the markup declares it no article text (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments: by element, role, class or id; inside an
article only by whole words of class or id, headings never). Where a page has an
``<article>`` or ``<main>`` with at least a tenth of the page's weight, lines outside
weigh nothing, and each line inside a threshold more than its characters: so short
first and last lines are within the surge. All lines from surge to dive are the
text; on pages without such an element without the labels (lines under ``LABEL``
characters that end no sentence) at its ends, since a window reaches over its
neighbours.

At scale: a map over Arrow batches; nothing is shuffled or collected. Tags are read
as browsers do, each once, and closing tags are found in one pass, so that time
grows with the page.

Edge cases: null and empty pages, and pages without text, give an empty string;
an empty table gives no rows; very long pages are read whole;
comments, declarations, scripts, styles and other raw elements never give text; a
tag that the page's end cuts off gives none; a quote counts only after ``=``;
unclosed elements end with the page, and an unclosed boilerplate element ends
before the next block so that it cannot swallow the page; character references
are decoded after the markup is gone; all white space, no-break space included,
becomes one space inside a block; windows with exactly the threshold are below it;
repeated pages and ids are treated row by row; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

WINDOW = 5
THRESHOLD = 80
LABEL = 25
# Element names of the HTML standard, by how they are treated.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "head", "title", "object", "canvas", "audio", "video", "noframes", "xmp")
BOILERPLATE = ("nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "label", "option", "input")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
NAMES = (
    "ad", "ads", "advert", "adverts", "advertisement", "adbox", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "header", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "topbar", "widget",
)
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar")

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Za-z]+")
_HEADINGS = frozenset(("header", "hgroup", "h1", "h2", "h3", "h4", "h5", "h6"))
_RAW, _BOILERPLATE, _BLOCKS, _VOID, _NAMES, _ROLES = map(frozenset, (RAW, BOILERPLATE, BLOCKS, VOID, NAMES, ROLES))
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def _told(name: str, attributes: str, inside: bool) -> bool:
    """Whether role, class or id say that an element is no article text; inside an article only whole words of class and id do, and never of a heading."""
    element = name
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and not (inside and element in _HEADINGS):
            words = value.split()
            if any(w in _NAMES and w != "header" for w in words) if inside else any(p in _NAMES for w in words for p in _PART.findall(w)):
                return True
    return False


def tags_of(page: str) -> tuple[list[tuple[int, int, str, bool, str]], list[int]]:
    """(start, end, name, whether it opens, attributes) of each tag outside raw elements, and for each opening tag the number of the tag that closes it (-1: none).

    Comments and declarations are nameless tags, raw elements single ones.
    """
    tags: list[tuple[int, int, str, bool, str]] = []
    closed: list[int] = []
    waiting: dict[str, list[int]] = {}
    at = page.find("<")
    while at >= 0:
        lead = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            tags.append((at, end, "", False, ""))
        elif lead in ("!", "?"):
            end = page.find(">", at) + 1 or len(page)
            tags.append((at, end, "", False, ""))
        elif lead.isascii() and lead.isalpha() or lead == "/" and page[at + 2 : at + 3].isalpha():
            m = _TAG.match(page, at)
            if m is None:  # cut off by the end of the page
                tags.append((at, len(page), "", False, ""))
                closed.append(-1)
                break
            name, opens, end = m[2].lower(), not m[1], m.end()
            if opens and name in _RAW:
                stop = _RAW_END[name].search(page, end)
                end = stop.end() if stop else len(page) if name in ("script", "style") else end
            elif opens:
                waiting.setdefault(name, []).append(len(tags))
            elif waiting.get(name):
                closed[waiting[name].pop()] = len(tags)
            tags.append((at, end, name, opens, m[3]))
        else:
            at = page.find("<", at + 1)
            continue
        closed.append(-1)
        at = page.find("<", end)
    return tags, closed


def lines_of(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, characters of it in links, whether it is inside the article) of each line that the markup does not declare boilerplate, and whether the page has an article."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = links = depth = at = 0
    marked = False

    def end_line():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append((text, linked, depth > 0))
        parts.clear()
        linked = 0

    tags, closed = tags_of(page)
    k = 0
    while True:
        text = page[at : tags[k][0] if k < len(tags) else len(page)]
        if text:
            parts.append(text)
            linked += len(text) if links else 0
        if k == len(tags):
            break
        _, at, name, opens, attributes = tags[k]
        k += 1
        if name in _RAW and opens:
            end_line() if name == "head" else None
            continue
        if name in _BLOCKS:
            end_line()
        if name in ("article", "main"):
            marked = marked or opens
            depth = depth + 1 if opens else max(0, depth - 1)
        elif opens and name not in _VOID and name not in ("body", "html") and (name in _BOILERPLATE or name == "header" and not depth or _told(name, attributes, depth > 0)):
            end_line()
            if closed[k - 1] >= 0:
                at, k = tags[closed[k - 1]][1], closed[k - 1] + 1
            else:
                while k < len(tags) and tags[k][2] not in _BLOCKS:
                    k += 1
                at = tags[k][0] if k < len(tags) else len(page)
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            links = links + 1 if opens else max(0, links - 1)
        elif name in ("td", "th") and not opens:
            parts.append(" ")
    end_line()
    return lines, marked


def weights_of(lines: list[tuple[str, int, bool]], marked: bool, threshold: int) -> tuple[list[int], int, bool]:
    """The weight of each line, the threshold for the page, and whether its article counts."""
    plain = [len(text) if linked * 2 <= len(text) else 0 for text, linked, _ in lines]
    total = sum(plain)
    inside = sum(w for w, x in zip(plain, lines, strict=True) if x[2])
    threshold = min(threshold, total // 4)
    if marked and any(x[2] for x in lines) and 10 * inside >= total:
        return [len(text) + threshold if own else 0 for text, _, own in lines], threshold, True
    return plain, threshold, False


def stretches(sizes: list[int], window: int, threshold: int) -> list[tuple[int, int]]:
    """Line ranges from a surge point to a dive point of the window sums: a stretch begins at the first line with text of a window that exceeds the threshold, and ends with the last."""
    sums = [sum(sizes[k : k + window]) for k in range(len(sizes))]
    out, at = [], 0
    while at < len(sums):
        if sums[at] <= threshold:
            at += 1
            continue
        start = at
        while at < len(sums) and sums[at] > threshold:
            at += 1
        covered = [k for k in range(start, min(at + window - 1, len(sizes))) if sizes[k]]
        if covered:
            if out and covered[0] < out[-1][1]:
                out[-1] = (out[-1][0], covered[-1] + 1)
            else:
                out.append((covered[0], covered[-1] + 1))
    return out


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    lines, marked = lines_of(page or "")
    weights, threshold, marked = weights_of(lines, marked, threshold)
    found = stretches(weights, window, threshold)
    if not found:
        return ""
    start, stop = found[0][0], found[-1][1]
    if marked:
        return "\n".join(lines[k][0] for k in range(start, stop) if weights[k])
    label = lambda k: not weights[k] or weights[k] < LABEL and lines[k][0][-1] not in ".!?:;\"'"
    while start < stop - 1 and label(start):
        start += 1
    while start < stop - 1 and label(stop - 1):
        stop -= 1
    return "\n".join(lines[k][0] for k in range(start, stop))


def extract(pages: DataFrame, page_id="page_id", url="url", markup="html", window=WINDOW, threshold=THRESHOLD) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "html"):
            texts = [main_text(p, window, threshold) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(markup).alias("html"))
    return rows.mapInArrow(strip, "page_id bigint, url string, text string, n_chars bigint")


def op7_html(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
