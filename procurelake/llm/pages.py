"""Main text of web pages: blocks by markup, and differencing against the page with the nearest URL.

A page falls into blocks of text. Elements that name a menu, header, footer, sidebar, notice, advert, form or reader comments by tag or role,
and those that do so by a whole class or id (``ad``; of containers also ``ad-box``, but not ``related-work``), are left out, as are scripts and styles. Where a page marks its article (``article``, ``main``), only
lines of that are taken. All pages are paired by nearest URL path within their host, their lines are aligned by longest common
subsequence, and shared lines, which are the site's and not the page's, are deleted. A check follows: a shared line stays if it
lies in a marked article and nothing around it has a class or id with a word that names furniture, such as ``share-this-article``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procurelake.session import staged

#: Near copies of a page don't tell what is the site's: where more than this part of either page's characters is shared, the next page of
#: the host is tried, up to ``REACH`` pages away on either side.
COPY_SHARE, REACH = 0.8, 4
#: Pages that follow each other in the order and are aligned by one task, with the first ``REACH`` of the next ones; at least ``REACH``.
STRETCH = 64
#: Elements by what they are.
_RAW = "script|style|template|svg|iframe|object|textarea|select|title|head"
_LEFT_OUT = {"nav", "footer", "aside", "form", "dialog", "menu", "button"}
_MAIN = {"article", "main"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
_NAMES = {
    "ad", "ads", "adsense", "advert", "advertisement", "advertising", "adverts", "alert", "aside", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo",
    "promotion", "recommended", "related", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "toolbar",
}
_HEADS = {"header", "masthead", "topbar"}
#: Words that stand beside such a name without changing what it means, and the elements whose class or id is looked at.
_PLAIN = {
    "area", "bar", "block", "body", "bottom", "box", "col", "column", "container", "content", "form", "global", "inner", "item", "items", "left",
    "links", "list", "main", "module", "outer", "page", "panel", "posts", "primary", "right", "row", "secondary", "section", "site", "slot",
    "top", "unit", "widget", "wrap", "wrapper",
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_HOLDERS = {"div", "section", "ul", "ol", "dl", "table", "header", "details", "fieldset", "center", "span"}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\">]|\"[^\"<]*\"|'[^'<]*')*)>|<[!?/][^>]*>", re.S | re.I
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_BLANKS = re.compile(r"\s+")


def _left_out(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in _LEFT_OUT or (tag in ("header", "noscript") and not in_main):
        return True
    if not attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id"):
            for whole in value.split():
                if tag not in _HOLDERS:
                    if whole in _NAMES and tag not in _HEADINGS:
                        return True
                    continue
                words = {w for w in _WORDS.findall(whole) if not w.isdigit()}
                telling = words & (_NAMES if in_main else _NAMES | _HEADS)
                if telling and words <= _NAMES | _HEADS | _PLAIN:
                    return True
    return False


def _doubtful(tag: str, attributes: str) -> bool:
    """Whether a class or id has a word that names furniture, among others that may change what it means."""
    if not attributes or tag in _HEADINGS:
        return False
    values = (value for name, value in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id"))
    return any(not _NAMES.isdisjoint(_WORDS.findall(value.lower())) for value in values)


def blocks(html: str | None) -> tuple[bool, list[str]]:
    """Whether the page marks its article, and the blocks of the article or, without one, of the page."""
    marked, lines, _ = _judged(html)
    return marked, lines


def _judged(html: str | None) -> tuple[bool, list[str], list[bool]]:
    """The same, and of each block whether the marks are sure that it is the article's."""
    html = html or ""
    found: list[tuple[bool, str, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open element, left out, in the article, in doubt
    out = inside = doubt = False

    def flush() -> None:
        if text:
            line = _BLANKS.sub(" ", unescape("".join(text))).strip()
            if line:
                found.append((inside, line, inside and not doubt))
            text.clear()

    def settle() -> None:
        nonlocal out, inside, doubt
        _, out, inside, doubt = stack[-1] if stack else ("", False, False, False)

    at = 0
    for token in _TOKEN.finditer(html):
        if not out and token.start() > at:
            text.append(html[at : token.start()])
        at = token.end()
        tag = token[3]
        if not tag:
            continue
        tag = tag.lower()
        block = tag in _BLOCKS
        if block:
            flush()
        elif tag in ("br", "td", "th", "img", "input"):
            text.append(" ")
        if token[2]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    settle()
                    break
            continue
        if block and stack and stack[-1][0] == "p":
            stack.pop()
            settle()
        if tag in _VOID or token[4].endswith("/"):
            continue
        drop = out or _left_out(tag, token[4], inside)
        if block or drop != out:
            stack.append((tag, drop, inside or (tag in _MAIN and not drop), tag not in _MAIN and (doubt or _doubtful(tag, token[4]))))
            settle()
    if not out:
        text.append(html[at:])
    flush()
    marked = any(of_article for of_article, _, _ in found)
    taken = [(line, sure) for of_article, line, sure in found if of_article or not marked]
    return marked, [line for line, _ in taken], [sure for _, sure in taken]


def shared_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places in ``a`` and ``b`` of a longest common subsequence, by the chains of matching places."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places = defaultdict(list)
    for j in range(head, len(b) - tail):
        places[b[j]].append(j)
    ends: list[int] = []
    links: list[tuple[int, int, tuple | None]] = []
    for i in range(head, len(a) - tail):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[:2])
        link = link[2]
    pairs = [(k, k) for k in range(head)] + middle[::-1] + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    return [i for i, _ in pairs], [j for _, j in pairs]


def _host_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", url or ""


_PARSED = "page_id long, url string, marked boolean, host string, path string, lines array<string>, sure array<boolean>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()))
    for batch in batches:
        rows = []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            marked, lines, sure = _judged(html)
            rows.append((marked, *_host_path(url), lines, sure))
        columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
        names = ["page_id", "url", "marked", "host", "path", "lines", "sure"]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], names=names)


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield batch.drop(columns="path").assign(part=part, at=range(at, at + len(batch)))
        at += len(batch)


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For either side of a page the nearest one that is no near copy, with the places shared; stretches come whole and by rank."""
    last, near = None, deque(maxlen=REACH)  # pages before: row, of this stretch, hashes, widths, settled on the side of what follows
    for batch in batches:
        rows = []
        for stretch, _, own, host, marked, row, hashes, widths in batch.itertuples(index=False, name=None):
            if (stretch, host, marked) != last:
                last = (stretch, host, marked)
                near.clear()
            settled, y, wide_y = False, hashes.tolist(), widths.tolist()
            for far, before in enumerate(reversed(near), 1):
                other, here, x, wide_x, done = before
                if not here or (done and settled):
                    continue
                i, j = shared_lines(x, y)
                # the longer part of either page in common means a copy, not a template
                if not i or max(sum(wide_x[k] for k in i) / max(1, sum(wide_x)), sum(wide_y[k] for k in j) / max(1, sum(wide_y))) <= COPY_SHARE:
                    if not done:
                        rows.append((other, 1, far, i))
                        before[-1] = True
                    if not settled:
                        rows.append((row, -1, far, j))
                        settled = True
            near.append([row, own, y, wide_y, False])
        yield pd.DataFrame(rows, columns=["row", "side", "far", "shared"])


def _site_lines(pages: DataFrame) -> DataFrame:
    """``row, gone``: places of lines that a page shares with the nearest other pages by URL within its host.

    Pages that mark their article are paired with each other, and the rest too, since the former's lines are the article's only.
    Pages of a host with the same lines are one page here, the first of them, so copies neither hide a template from each other nor
    delete each other's text; what is found holds for all of them.
    """
    hashes = F.transform("lines", lambda line: F.xxhash64(line))
    slim = pages.where("host <> ''").select("row", "host", "marked", "path", hashes.alias("hashes"), F.transform("lines", F.length).alias("widths"))
    whole = slim.withColumn("same", F.md5(F.concat_ws(",", F.col("hashes").cast("array<string>"))))
    firsts = whole.groupBy("host", "marked", "same").agg(F.min(F.struct("path", "row", "hashes", "widths")).alias("m"))
    slim = firsts.select("host", "marked", "m.*")
    order = ["host", "marked", "path", "row"]
    # hosts of any size are spread by range; the order goes on from one task to the next
    ranged = slim.select("row", "host", "marked", "path", "hashes", "widths").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "row long, host string, marked boolean, hashes array<long>, widths array<int>, part int, at long"
    numbered = staged(ranged.mapInPandas(_numbered, schema), "ordered", compression="zstd")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = numbered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = numbered.join(before, "part").withColumn("rank", F.col("before") + F.col("at"))
    # each page goes to its stretch, and the first ones to that before as well, whose last ones they follow
    stretches = F.array_distinct(F.array(F.expr(f"rank div {STRETCH}"), F.expr(f"greatest(rank - {REACH}, 0) div {STRETCH}")))
    own = F.expr(f"rank div {STRETCH}") == F.col("stretch")
    along = ranked.select(F.explode(stretches).alias("stretch"), "*").select("stretch", "rank", own.alias("own"), "host", "marked", "row", "hashes", "widths")
    found = along.repartition("stretch").sortWithinPartitions("stretch", "rank").mapInPandas(_align, "row long, side int, far int, shared array<int>")
    nearest = found.groupBy("row", "side").agg(F.min_by("shared", "far").alias("shared"))
    gone = nearest.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("gone"))  # two sides at most
    keys = ["host", "marked", "same"]
    named = gone.join(whole.select("row", *keys), "row").select(*keys, "gone")
    return whole.select("row", *keys).join(named, keys).select("row", "gone")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages`` (``page_id``, ``url``, ``html``).

    Blocks are joined by a line feed; blanks within one are a single space; character references are decoded. A null or empty html,
    or one without text, gives an empty text. A page with no host, or alone on its host, has no neighbour and is not differenced;
    of equal URLs the order is that of the rows; copies of a page lose the same lines as the first of them, and near copies don't delete
    each other's (``COPY_SHARE``). A long page is read whole. Repeated rows are all kept; null ids and URLs stay null. An empty table
    gives an empty table; further columns are ignored.
    """
    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    parsed = staged(slim.mapInArrow(_parse, _PARSED).withColumn("row", F.monotonically_increasing_id()), "blocks", compression="zstd")
    gone = staged(_site_lines(parsed), "shared")
    kept = F.filter("lines", lambda line, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i) | F.get("sure", i))
    # pages whose every line stays by the check don't send their texts through the join
    doubtful = F.exists("sure", lambda sure: ~sure)
    differenced = parsed.where(doubtful).join(gone, "row", "left").select("page_id", "url", kept.alias("lines"))
    both = parsed.where(~doubtful).select("page_id", "url", "lines").unionByName(differenced)
    text = both.select("page_id", "url", F.array_join("lines", "\n").alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
