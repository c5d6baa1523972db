"""Main text of web pages: nearest-URL page differencing, checked against the markup.

Pages of a host are put in the order of their URL paths, and each is compared with the nearer of its
two neighbours (the one sharing more leading characters of the path; the earlier one in a
tie). Both are taken as sequences of text lines, one per block of the page, and aligned by a longest
common subsequence; shared lines are the site's furniture and are deleted. Pages of the same
lines are the same page under several addresses: they are neighbours of others only, never of each
other, and fare alike.

Differencing alone cannot tell everything: an article may quote a passage that its neighbour
quotes too, and a menu may differ from page to page. So the markup is heard after it. Lines in
elements that never hold text of the page (head, script, style, nav, header outside an article,
footer, aside, form, dialogs and the like), or whose class, id or role names such a part (menu,
sidebar, banner, cookie notice, advert, comments, ...), go even if they are not shared; lines within
the article or main element otherwise stay even if they are shared. Where a page has such an element,
what lies outside goes. Where it has none, differencing decides.

Steps: one pass digests the pages to line hashes (8 bytes a line); distinct line sequences
are sorted by (host, path) over all tasks, so a host with a third of all pages is many ranges; the
sequences of neighbours are joined and aligned; the lines found shared are joined to the
pages, which are read a second time. Aligning takes time in proportion to the product of the two line
counts after equal beginnings and ends, and memory in proportion to their sum.

Defined cases: a null or empty page has an empty text. A page without URL, or alone on its host, has
no neighbour: nothing is deleted as shared. Character references are decoded as HTML5 does; white space is
what Unicode calls so. Unclosed and misnested elements end with the element around them.
Very long pages are processed whole. Repeated rows get the same result each; ties in the order of
paths go by the query part of the URL, then by content. An empty table gives an empty table. Columns
named ``text``, ``n_shared`` or ``__*`` of the names used here are replaced, all others pass.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.common import append_columns
from tremora.session import stored

# Element and attribute names of HTML.
#: Elements whose content is not text of the page.
RAW = frozenset(["script", "style", "title", "textarea", "noscript", "iframe", "noframes", "noembed", "xmp"])
HIDDEN = frozenset(
    ["head", "nav", "footer", "aside", "form", "dialog", "menu", "template", "svg", "math", "object"]
    + ["select", "button", "label", "canvas", "audio", "video", "map", "datalist", "option"]
)
VOID = frozenset(
    ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
)
#: Elements that leave the line as it is; all others begin and end a block.
INLINE = frozenset(
    ["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i"]
    + ["img", "ins", "kbd", "mark", "q", "rb", "rp", "rt", "rtc", "ruby", "s", "samp", "small", "span", "strike"]
    + ["strong", "sub", "sup", "time", "tt", "u", "var", "wbr"]
)
#: A start tag of a block ends an open paragraph; these end others too.
PARAGRAPH = frozenset(["p"])
CLOSES = {
    "p": frozenset(["p"]),
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]),
    "body": frozenset(["head"]),
}
#: Words in class, id or role that name a part beside the text.
BESIDE = frozenset(
    ["nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer"]
    + ["masthead", "topbar", "banner", "contentinfo", "complementary", "search", "toolbar", "pagination", "pager"]
    + ["ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "sponsor", "sponsored"]
    + ["promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "alertdialog", "popup", "modal"]
    + ["newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related"]
    + ["recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"]
    + ["skip", "widget", "dialog", "tooltip", "overlay", "disclaimer"]
)
#: Such a word marks a header too, outside of articles.
HEADER = frozenset(["header"])
MAIN = frozenset(["article", "main"])

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>"']++))?+|.""", re.S)
NAMED = re.compile(r"(?:class|id|role|hidden|style)", re.I)
#: Parts of a camel-case word.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: "no-sidebar" or "has-comments" tell how a part is styled, they do not name it.
STYLED = frozenset(["no", "not", "has", "is", "with", "without", "hide", "show"])

#: What the markup says of a line.
DROPPED, OPEN, KEPT = 0, 1, 2

URL = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)(\?[^#]*)?")


def beside(attributes: str, names: frozenset, wholly: bool) -> bool:
    """Do the attributes of a tag name a part beside the text, or hide it?

    ``wholly``: a name counts only if all its parts do (``comment-reply``, not ``with-sidebar``).
    """
    if not NAMED.search(attributes):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = [x.lower() for x in PART.findall(word)]
                if word.lower() in names or (parts and all(x in names for x in parts)):
                    return True
                if not wholly and parts and parts[0] not in STYLED and not names.isdisjoint(parts):
                    return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """Lines of a page in order, each with what the markup says of it."""
    found: list[tuple[str, int]] = []
    parts: list[str] = []
    #: Open elements: name, does it hide, is it a main element.
    stack: list[tuple[str, bool, bool]] = []
    hiding = mains = 0
    any_main = False

    def end_line() -> None:
        if parts:
            line = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if line:
                found.append((line, DROPPED if hiding else KEPT if mains else OPEN))

    def close(to: int) -> None:
        nonlocal hiding, mains
        while len(stack) > to:
            _, hides, main = stack.pop()
            hiding -= hides
            mains -= main

    at, size = 0, len(page)
    while at < size:
        token = TOKEN.search(page, at)
        if token is None:
            parts.append(page[at:])
            break
        if token.start() > at:
            parts.append(page[at : token.start()])
        at = token.end()
        name = token[2]
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            end_line()
        if token[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name in INLINE and stack[i][1]:
                        end_line()
                    close(i)
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        attributes = token[3]
        if name in RAW:
            if not attributes.rstrip().endswith("/") or name != "iframe":
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name in VOID or attributes.endswith("/") and name not in MAIN:
            continue
        if name not in INLINE:
            ends = CLOSES.get(name, PARAGRAPH)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                elif stack[i][0] not in INLINE:
                    break
        names = BESIDE if mains else BESIDE | HEADER
        hides = name in HIDDEN or (name == "header" and not mains)
        hides = hides or (name not in ("html", "body") and beside(attributes, names, name in MAIN))
        if hides and name in INLINE:
            end_line()
        main = name in MAIN and not hiding and not hides
        any_main = any_main or main
        stack.append((name, hides, main))
        hiding += hides
        mains += main
    end_line()
    if any_main:
        found = [(line, kind if kind == KEPT else DROPPED) for line, kind in found]
    return found


def line_hashes(lines: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(x.encode(), digest_size=8).digest() for x in lines), np.int64)


def identity(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def lcs_marks(a: np.ndarray, b: np.ndarray, table: int = 1 << 22) -> np.ndarray:
    """Which items of ``a`` belong to a longest common subsequence of ``a`` and ``b``.

    Equal ends are set aside; items that only one side has cannot match. The rest is halved
    (Hirschberg) down to pieces whose table fits ``table`` cells.
    """
    marks = np.zeros(len(a), bool)
    head = 0
    shorter = min(len(a), len(b))
    unlike = np.flatnonzero(a[:shorter] != b[:shorter])
    head = int(unlike[0]) if len(unlike) else shorter
    rest = shorter - head
    unlike = np.flatnonzero(a[::-1][:rest] != b[::-1][:rest])
    tail = int(unlike[0]) if len(unlike) else rest
    marks[:head] = True
    marks[len(a) - tail :] = True
    inner, other = np.arange(head, len(a) - tail), b[head : len(b) - tail]
    inner = inner[np.isin(a[inner], other)]
    other = other[np.isin(other, a[inner])]
    pending = [(inner, other)]
    while pending:
        places, other = pending.pop()
        if not len(places) or not len(other):
            continue
        mine = a[places]
        if len(mine) * len(other) <= table or len(mine) == 1:
            marks[places[_table_marks(mine, other)]] = True
            continue
        half = len(mine) // 2
        forward = _last_row(mine[:half], other)
        backward = _last_row(mine[half:][::-1], other[::-1])[::-1]
        cut = int(np.argmax(forward + backward))
        pending += [(places[:half], other[:cut]), (places[half:], other[cut:])]
    return marks


def _next_row(row: np.ndarray, item: int, other: np.ndarray) -> np.ndarray:
    """Lengths for one item more: the best of the prefixes, each match one more than before it."""
    made = row.copy()
    made[1:] = np.maximum(row[1:], row[:-1] + (other == item))
    return np.maximum.accumulate(made, out=made)


def _last_row(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    row = np.zeros(len(other) + 1, np.int32)
    for item in mine:
        row = _next_row(row, item, other)
    return row


def _table_marks(mine: np.ndarray, other: np.ndarray) -> list[int]:
    if len(mine) == 1:
        return [0] if (other == mine[0]).any() else []
    rows = [np.zeros(len(other) + 1, np.int32)]
    for item in mine:
        rows.append(_next_row(rows[-1], item, other))
    found, j = [], len(other)
    for i in range(len(mine), 0, -1):
        j = int(np.searchsorted(rows[i], rows[i][j]))  # the first place with that length
        if j and rows[i - 1][j] < rows[i][j]:
            found.append(i - 1)
            j -= 1
    return found


def url_parts(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host in small letters, path, and query of a URL; nulls if there is no host."""
    match = URL.match(url or "")
    if not match or not match[1]:
        return None, None, None
    return match[1].lower(), match[2] or "/", match[3] or ""


def _pages(batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[tuple[str, int]]]]:
    texts = batch.column("html").cast(pa.large_binary())
    for url, page in zip(batch.column("url"), texts):
        yield url.as_py(), blocks((page.as_py() or b"").decode("utf-8", "replace"))


def digested(pages: DataFrame) -> DataFrame:
    """Of every page with a host and any line: __host, __path, __query, __page, __lines."""

    def start() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        def work(batch):
            hosts, paths, queries, names, lines = [], [], [], [], []
            for url, found in _pages(batch):
                hashes = line_hashes([x for x, _ in found])
                for column, value in zip((hosts, paths, queries), url_parts(url)):
                    column.append(value)
                names.append(identity(hashes))
                lines.append(hashes)
            return {
                "__host": pa.array(hosts, pa.string()),
                "__path": pa.array(paths, pa.string()),
                "__query": pa.array(queries, pa.string()),
                "__page": pa.array(names, pa.binary()),
                "__lines": pa.array(lines, pa.list_(pa.int64())),
            }

        return work

    fields = [
        T.StructField("__host", T.StringType()),
        T.StructField("__path", T.StringType()),
        T.StructField("__query", T.StringType()),
        T.StructField("__page", T.BinaryType()),
        T.StructField("__lines", T.ArrayType(T.LongType())),
    ]
    found = append_columns(pages.select("url", "html"), start, fields, drop=["url", "html"])
    return found.where(F.col("__host").isNotNull() & (F.size("__lines") > 0))


def with_nearest(distinct: DataFrame) -> DataFrame:
    """__host, __page and __nearest, the page nearest by path; pages alone on a host are left out.

    The rows are sorted over all tasks; looking back and ahead happens within a task's range, and
    the ends of the ranges, one row each, are matched with each other.
    """
    keys = ["__host", "__path", "__query", "__page"]
    ranges = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = distinct.select(keys).repartitionByRange(ranges, *keys).withColumn("__part", F.spark_partition_id())
    ordered = stored(ordered, "page-order")
    own = F.struct(*keys)
    inside = Window.partitionBy("__part").orderBy(*keys)
    ends = ordered.groupBy("__part").agg(F.min(own).alias("__first"), F.max(own).alias("__last"))
    over_ranges = Window.orderBy("__part")
    ends = ends.select(
        "__part", F.lag("__last").over(over_ranges).alias("__left"), F.lead("__first").over(over_ranges).alias("__right")
    )
    rows = ordered.withColumns({"__before": F.lag(own).over(inside), "__after": F.lead(own).over(inside)})
    rows = rows.join(F.broadcast(ends), "__part")  # a row per range, as many as shuffle partitions
    places = []
    for side, end in (("__before", "__left"), ("__after", "__right")):
        found = F.coalesce(side, end)
        found = F.when(found["__host"] == F.col("__host"), found)
        places += [found["__path"].alias(f"{side}_path"), found["__page"].alias(f"{side}_page")]
    rows = rows.select("__host", "__path", "__page", *places)

    def start():
        def work(batch):
            columns = [batch.column(c) for c in ("__path", "__before_path", "__after_path", "__before_page", "__after_page")]
            nearest = []
            for path, before, after, left, right in zip(*(c.to_pylist() for c in columns)):
                nearer = right if left is None or (right and shared_start(path, after) > shared_start(path, before)) else left
                nearest.append(nearer)
            return {"__nearest": pa.array(nearest, pa.binary())}

        return work

    drop = ["__path", "__before_path", "__after_path", "__before_page", "__after_page"]
    found = append_columns(rows, start, [T.StructField("__nearest", T.BinaryType())], drop=drop)
    return found.where(F.col("__nearest").isNotNull())


def shared_start(a: str, b: str) -> int:
    return len(commonprefix([a, b]))


def shared_lines(pages: DataFrame) -> DataFrame:
    """__host, __page, __shared: per line, is it shared with the nearest page?"""
    found = digested(pages).groupBy("__host", "__page")
    distinct = found.agg(F.min(F.struct("__path", "__query")).alias("__at"), F.first("__lines").alias("__lines"))
    distinct = stored(distinct.select("__host", "__page", "__at.*", "__lines"), "page-lines")
    lines = distinct.select("__host", "__page", "__lines")
    others = lines.select("__host", F.col("__page").alias("__nearest"), F.col("__lines").alias("__others"))
    pairs = with_nearest(distinct).join(lines, ["__host", "__page"]).join(others, ["__host", "__nearest"])

    def start():
        def work(batch):
            marks = []
            for mine, other in zip(batch.column("__lines"), batch.column("__others")):
                marks.append(lcs_marks(mine.values.to_numpy(), other.values.to_numpy()))
            return {"__shared": pa.array(marks, pa.list_(pa.bool_()))}

        return work

    field = T.StructField("__shared", T.ArrayType(T.BooleanType()))
    return append_columns(pairs, start, [field], drop=["__nearest", "__lines", "__others"]).where(
        F.array_contains("__shared", True)
    )


def main_text(pages: DataFrame) -> DataFrame:
    """Add text and n_shared, the number of lines shared with the nearest page; html is left out."""
    columns = [c for c in pages.columns if c not in ("html", "text", "n_shared")]

    def start():
        def work(batch):
            hosts, names, lines, places = [], [], [], []
            for url, found in _pages(batch):
                hosts.append(url_parts(url)[0])
                names.append(identity(line_hashes([x for x, _ in found])))
                lines.append([x for x, kind in found if kind != DROPPED])
                places.append([i if kind == OPEN else -1 for i, (_, kind) in enumerate(found) if kind != DROPPED])
            return {
                "__host": pa.array(hosts, pa.string()),
                "__page": pa.array(names, pa.binary()),
                "__text": pa.array(lines, pa.list_(pa.string())),
                "__places": pa.array(places, pa.list_(pa.int32())),
            }

        return work

    fields = [
        T.StructField("__host", T.StringType()),
        T.StructField("__page", T.BinaryType()),
        T.StructField("__text", T.ArrayType(T.StringType())),
        T.StructField("__places", T.ArrayType(T.IntegerType())),
    ]
    parsed = append_columns(pages.select(*columns, "html"), start, fields, drop=["html"])
    rows = parsed.join(shared_lines(pages), ["__host", "__page"], "left")
    # Place -1: the markup keeps the line whatever the neighbour has.
    gone = lambda i: F.coalesce(F.get("__shared", F.get("__places", i)), F.lit(False))
    return rows.select(
        *columns,
        F.array_join(F.filter("__text", lambda line, i: ~gone(i)), " ").alias("text"),
        F.coalesce(F.size(F.filter("__shared", lambda x: x)), F.lit(0)).cast("bigint").alias("n_shared"),
    )
