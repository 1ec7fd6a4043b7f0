"""Main text of web pages by differencing pages with neighbouring URLs.

A page becomes lines: one per block of text, with white space collapsed and character references decoded. Its markup gives
each line a level: inside an article, inside the main part, open, or boilerplate (menus, headers, footers, sidebars, forms,
notices, adverts, comments, by element, role or words of class and id). Pages are sorted by host, URL path and URL; each is
paired with the page before and the page after it on its host. The lines of a pair are aligned by a longest common
subsequence, and shared lines are deleted. Two kinds of lines stay although they are shared: those of an article element,
for two addresses of one article would delete each other, and those of pages that share ``COPY`` of their text outside
boilerplate, which are copies. Of what is left, the lines of the best level that the page has are its text.

So where pages mark their articles, markup alone decides what the text is; where they don't, differencing does.

Sorting is one range partition on sampled keys, with whole pages never moved twice: before it, the first and last key of
each range are found from the keys alone, and the lines' digests of these pages are sent to the ranges beside them as well.
A task then streams its ranges with one page of context on each side, so results don't depend on where ranges are cut.

Null html gives an empty text. A null URL or one without a host has no neighbours. Rows that repeat a page_id are pages of
their own; equal URLs are ordered by page_id, then by a hash of the html. Lines count as equal by 64-bit hashes. Other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: Pages of a range and most ranges; keys sampled per range to cut them.
RANGE, RANGES, SAMPLED = 256, 1 << 16, 4
#: Share of a page's text outside boilerplate from which a pair counts as copies.
COPY = 0.9
#: Bytes that an alignment may keep; beyond, it is split in halves.
KEPT = 1 << 25

BOILERPLATE, OPEN, MAIN, ARTICLE = range(4)

# Elements and names that mark what is not the article.
SKIPPED = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "select", "button", "svg", "object", "canvas", "audio", "video", "datalist"}
CHROME = {"nav", "aside", "footer", "form", "dialog", "menu", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "status", "toolbar"}
NAMES = {
    "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "copyright", "footer", "gdpr", "header", "login", "masthead", "menu", "menubar", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "related", "share", "sharing", "sidebar",
    "signup", "social", "subscribe", "toolbar", "widget",
}
#: These mark boilerplate even on an article or beside a word of ``CONTENT``.
STRONG = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "disqus", "promo", "replies", "reply", "sponsor", "sponsored"}
CONTENT = {"article", "content", "entry", "main", "post", "story"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: An opening tag of the key ends an open element of the values, looked for above the nearest element of ``SCOPE``.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "nav", "aside", "body", "blockquote"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks before which an open paragraph ends.
NO_PARAGRAPH = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "nav", "footer", "header", "main", "form", "pre", "blockquote", "figure", "hr"} | HEADINGS

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^><"']|"[^"<]*"|'[^'<]*')*+|[^><]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _level(name: str, attributes: str, inside: int) -> int:
    """The level of an element's lines, given that of the element around it."""
    if inside == BOILERPLATE or name in CHROME or (name == "header" and inside != ARTICLE):
        return BOILERPLATE
    level = ARTICLE if name == "article" else max(inside, MAIN) if name == "main" else inside
    if not attributes:
        return level
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    words = {w.lower() for w in _WORD.findall(found.get("class", "") + " " + found.get("id", ""))}
    if words & STRONG or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return level if name in ("html", "body") else BOILERPLATE
    role = found.get("role", "").lower()
    if role in ROLES:
        return BOILERPLATE
    if words & NAMES and not words & CONTENT and name not in ("html", "body", "main", "article"):
        return BOILERPLATE
    if role == "article" or found.get("itemprop", "").lower() == "articlebody":
        return ARTICLE
    return max(level, MAIN) if role == "main" else level


def lines_of(html: str) -> list[tuple[int, str]]:
    """(level, text) of the page's blocks, in order; blocks without text are left out."""
    lines: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    level, at, end = OPEN, 0, len(html)

    def close() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            # of a header inside an article, only headings belong to it
            shown = level if level != ARTICLE or not any(n == "header" for n, _ in stack) or any(n in HEADINGS for n, _ in stack) else BOILERPLATE
            lines.append((shown, text))

    def back_to(depth: int) -> None:
        nonlocal level
        del stack[depth:]
        level = stack[-1][1] if stack else OPEN

    while True:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else end]
        if text:
            parts.append(unescape(text) if "&" in text else text)
        if m is None:
            close()
            return lines
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE and not any(n == name for n, _ in stack[-4:]):
                continue
            if name not in INLINE:
                close()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name in INLINE and level != (stack[depth - 1][1] if depth else OPEN):
                        close()
                    back_to(depth)
                    break
            continue
        if name in SKIPPED:
            if not m[3].endswith("/"):
                gone = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                at = gone.end() if gone else end
            continue
        if name not in INLINE:
            close()
            ended = {"p"} if name in NO_PARAGRAPH else ENDS.get(name)
            for depth in range(len(stack) - 1, -1, -1) if ended else ():
                if stack[depth][0] in ended:
                    back_to(depth)
                    break
                if stack[depth][0] in SCOPE:
                    break
        if name not in VOID:
            inner = _level(name, m[3], level)
            if name in INLINE and inner == level:
                continue  # nothing depends on where it ends
            if name in INLINE:
                close()
            stack.append((name, inner))
            level = inner


def key_of(url: str | None, page_id: int | None) -> str:
    """What pages are sorted by: host, path without its ending, URL, page_id."""
    rest = (url or "").strip().split("://", 1)[-1]
    place = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = place.partition("/")
    path = re.sub(r"(/index)?(\.[a-z]{3,5})?/*$", "", path.lower())
    return "\0".join((host.lower(), path, url or "", "" if page_id is None else f"{page_id:020d}"))


def _rows_kept(a: list[int], masks: dict[int, int], m: int) -> list[int]:
    """Bit rows of the longest common subsequence of ``a`` and a text of m lines: bit j of row i is 0 where one more line
    of the text's first j + 1 is matched than of its first j."""
    full = (1 << m) - 1
    v, rows = full, []
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _masks(b: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for j, x in enumerate(b):
        out[x] = out.get(x, 0) | 1 << j
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and every prefix of ``b``."""
    full, masks = (1 << len(b)) - 1, _masks(b)
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) of a longest common subsequence of two lists, ascending."""
    both = set(a) & set(b)
    at, bt = ([i for i, x in enumerate(s) if x in both] for s in (a, b))
    a, b = [a[i] for i in at], [b[j] for j in bt]
    return [(at[i], bt[j]) for i, j in _common(a, b)]


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    start, n, m = 0, len(a), len(b)
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    head = [(i, i) for i in range(start)]
    tail = [(n + i, m + i) for i in range(len(a) - n)]
    x, y = a[start:n], b[start:m]
    if not x or not y:
        return head + tail
    if len(x) * len(y) > 8 * KEPT and len(x) > 1:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        found = _common(x[:half], y[:cut]) + [(half + i, cut + j) for i, j in _common(x[half:], y[cut:])]
    else:
        rows, found, i, j = _rows_kept(x, _masks(y), len(y)), [], len(x), len(y)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not (i and not rows[i - 1] >> (j - 1) & 1):
                    j -= 1
                    found.append((i, j))
        found.reverse()
    return head + [(start + i, start + j) for i, j in found] + tail


class _Page:
    """A page on its way through the differencing."""

    def __init__(self, row: dict):
        self.row = row
        self.hashes, self.levels, self.sizes = row["hashes"], row["levels"], row["sizes"]
        self.shared: set[int] = set()

    def pair(self, other: _Page) -> None:
        """Marks the lines that two neighbours share."""
        both = common(self.hashes, other.hashes)
        mine, theirs = {i for i, _ in both}, {j for _, j in both}
        if not (self.copied(mine) or other.copied(theirs)):
            self.shared |= mine
            other.shared |= theirs

    def copied(self, shared: set[int]) -> bool:
        told = [i for i, x in enumerate(self.levels) if x != BOILERPLATE]
        return bool(told) and sum(self.sizes[i] for i in told if i in shared) >= COPY * sum(self.sizes[i] for i in told)

    def text(self) -> tuple[str, int]:
        """The text, and how many of all lines were deleted for being shared."""
        best, lines = max(self.levels, default=BOILERPLATE), iter(self.row["text"].split("\n"))
        gone = {i for i in self.shared if self.levels[i] != ARTICLE}
        if best == BOILERPLATE:
            return "", len(gone)
        mine = [(i, next(lines)) for i, x in enumerate(self.levels) if x == best]
        return " ".join(t for i, t in mine if i not in gone), len(gone)


_PARSED = "bucket int, key string, mark long, context boolean, page_id long, url string, hashes array<long>, levels binary, sizes array<int>, text string"
_OUT = "page_id long, url string, text string, n_chars long, n_lines int, n_shared int"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _keys(pages: DataFrame, cuts: list[str]) -> DataFrame:
    """(bucket, key) of every page, from its URL and page_id alone."""

    def run(batches):
        for b in batches:
            keys = [key_of(u, p) for u, p in zip(b["url"].to_pylist(), b["page_id"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(cuts, k) for k in keys], pa.int32()), pa.array(keys, pa.string())], ["bucket", "key"])

    return pages.select("page_id", "url").mapInArrow(run, "bucket int, key string")


def _parsed(pages: DataFrame, cuts: list[str], beside: dict[str, list[int]]) -> DataFrame:
    """Pages as lines: one row for the page's own range, one without text for each range that it is the context of."""
    schema = _arrow(_PARSED)

    def run(batches):
        for b in slices(batches, "html"):
            out = []
            for page_id, url, html in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html"))):
                lines = lines_of(html or "")
                levels = bytes(x for x, _ in lines)
                best = max(levels, default=BOILERPLATE)
                hashes = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for _, t in lines]
                sizes, key = [len(t) for _, t in lines], key_of(url, page_id)
                mark = xxhash.xxh3_64_intdigest(html or "") - (1 << 63)
                text = "\n".join(t for x, t in lines if x == best != BOILERPLATE)
                out.append((bisect_right(cuts, key), key, mark, False, page_id, url, hashes, levels, sizes, text))
                out += [(k, key, mark, True, None, None, hashes, levels, sizes, "") for k in beside.get(key, ())]
            yield _batch(out, schema)

    return pages.mapInArrow(run, _PARSED)


def _differences(batches):
    """Streams sorted pages: each is paired with the one before it, and told once the one after it is known."""
    schema, last = _arrow(_OUT), None

    def told(page: _Page) -> list[tuple]:
        if page is None or page.row["context"]:
            return []
        text, gone = page.text()
        return [(page.row["page_id"], page.row["url"], text, len(text), len(page.levels), gone)]

    for b in slices(batches):
        out = []
        for row in b.to_pylist():
            page = _Page(row)
            if last is not None and last.row["bucket"] == row["bucket"]:
                host = row["key"].split("\0", 1)[0]
                if host and host == last.row["key"].split("\0", 1)[0] and not (row["context"] and last.row["context"]):
                    last.pair(page)
            out += told(last)
            last = page
        yield _batch(out, schema)
    yield _batch(told(last), schema)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared) of every page: its main text, the number of its lines, and of those
    deleted because a neighbour has them."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    n = pages.count()
    ranges = min(max(n // RANGE, 1), RANGES)
    cuts: list[str] = []
    if ranges > 1:  # at most SAMPLED * RANGES keys come to the driver, and twice RANGES below
        sample = sorted({r["key"] for r in _keys(pages.sample(min(1.0, SAMPLED * ranges / n), seed=7), []).collect()})
        cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    ends = sorted((r["bucket"], r["low"], r["high"]) for r in _keys(pages, cuts).groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()) if cuts else []
    beside: dict[str, list[int]] = {}
    for (k, _, high), (after, low, _) in zip(ends, ends[1:]):
        beside.setdefault(high, []).append(after)
        beside.setdefault(low, []).append(k)
    rows = _parsed(pages, cuts, beside)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "key", "mark")
    return rows.mapInArrow(_differences, _OUT)
