"""Main-text extraction by nearest-URL page differencing.

Pages are parsed to blocks of text and range-sorted by (host, URL path), so that a page stands
between the two pages of its host whose paths are nearest. It is paired with the nearer of them,
the one that shares the longer beginning of the path, and both pages' blocks are aligned by longest
common subsequence: what they share is the site's, what only one has is the page's own.

What is compared is a line's key. A block that stands in a place with a name (a class, an id, an element like ``nav``
or ``footer``) outside the main container is known by that place: its elements with their classes, numbers
masked. So a menu or an advert is shared though its words differ from page to page, and either
neighbour will do; neighbours may repeat a place more or less often. Other blocks are known by their text.

The diff cannot tell an article that two pages quote from a template, nor anything of a page without
neighbours. Markup breaks these ties: shared blocks inside an ``article`` or ``main`` element stay, and blocks that no
neighbour shares go if their own markup names them as menus, adverts, comments and so on, unless the
element so named holds the main container. On a page without ``article`` or ``main`` the container is the
innermost element with more than half of the text, and a text shared with one neighbour goes only if the
neighbour on the other side, where there is one, holds it as well.
"""

from __future__ import annotations

import html as entities
import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import _batch as B
from weft.llm._shared import by_name

# Element names and class words of HTML practice.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "canvas", "title", "head"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "label", "fieldset", "menu", "dialog", "input"} | RAW
CONTENT = {"article", "main"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"
}
CLASS_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "banners", "sponsor", "sponsored", "promo", "promotion", "promoted", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs",
    "sidebar", "aside", "footer", "masthead", "topbar", "toolbar", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall", "disclaimer",
    "comment", "comments", "comment-list", "respond", "replies", "reply", "disqus", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "login", "search", "skip", "pagination", "pager", "alert",
}
#: Reader comments may well be longer than what they are about, so their names never mislead.
COMMENT_WORDS = {"comment", "comments", "comment-list", "respond", "replies", "disqus"}
#: Elements that are no container, however much text they hold.
SINGLE = {"html", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "pre", "td", "th", "tr"}
#: Words that may stand beside one of these in a compound class.
NEUTRAL = {
    "area", "bar", "block", "body", "bottom", "box", "center", "container", "content", "group", "head", "header", "holder", "inner", "item", "items", "large", "left", "link", "links", "list", "main",
    "mobile", "outer", "page", "panel", "right", "row", "section", "site", "slot", "small", "title", "top", "unit", "wrap", "wrapper"
}
#: Elements that name no place: their blocks are known by their text, unless a class or an id names one.
PLAIN = {"html", "body", "div", "p", "section", "center", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "tbody", "thead", "tr", "td", "th", "figure", "figcaption", "article", "main", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
_ATTR = re.compile(r"(?<![a-zA-Z_:-])([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Flags of a block.
CONTENT_FLAG, NOISE_FLAG = 1, 2


def _listed(token: str) -> bool:
    """Whether a class is a listed word, or a compound of listed, neutral words and numbers."""
    parts = [p for p in re.split(r"[-_]+|[0-9]+", token) if p]
    return token in CLASS_WORDS or any(p in CLASS_WORDS for p in parts) and all(p in CLASS_WORDS or p in NEUTRAL for p in parts)


def _place(name: str, attrs: str) -> tuple[str, bool]:
    """An element as part of a place, and whether it gives the place a name."""
    words = sorted(w for key, a, b, c in _ATTR.findall(attrs) if key.lower() in ("class", "id") for w in (a or b or c).lower().split()) if attrs.strip() else []
    return " ".join([name, *(re.sub("[0-9]+", "0", w) for w in words)]), bool(words) or name not in PLAIN


def _noise(name: str, attrs: str, content: bool) -> str:
    """Why markup names an element as noise: "hard" by what it is, "soft" by a word that may mislead, or not at all."""
    if name in DROPPED and not (name == "header" and content):
        return "soft" if name == "form" else "hard"
    if not attrs.strip():
        return ""
    for key, a, b, c in _ATTR.findall(attrs):
        value, key = (a or b or c).lower(), key.lower()
        if key in ("class", "id") and name not in ("body", "html", "article", "main"):
            words = value.split()
            if COMMENT_WORDS.intersection(words):
                return "hard"
            if any(map(_listed, words)):
                return "soft"
        elif key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return "hard"
    bare = f" {_ATTR.sub('', attrs)} ".replace("/", " ")
    return "hard" if " hidden" in bare and re.search(r"\shidden\s", bare) else ""


def _tags(page: str):
    """(text before, name or None, whether it ends an element, attributes, literal text, end) of each piece of markup.

    Each place is passed once: after one tag that no ``>`` outside quotes ends, quotes no longer count.
    """
    at = text = 0
    quotes = True
    while True:
        lt = page.find("<", at)
        if lt < 0:
            yield page[text:], None, False, "", "", len(page)
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            end = len(page) if end < 0 else end + 3
            yield page[text:lt], None, False, "", "", end
        elif page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt + 9)
            yield page[text:lt], None, False, "", page[lt + 9 : len(page) if end < 0 else end], (end := len(page) if end < 0 else end + 3)
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt) + 1
            if not end:
                yield page[text:], None, False, "", "", len(page)
                return
            yield page[text:lt], None, False, "", "", end
        else:
            m = _NAME.match(page, lt + 1)
            if m is None:
                at = lt + 1
                continue
            rest = _REST.match(page, m.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else page.find(">", m.end()) + 1
            if not end:
                yield page[text:], None, False, "", "", len(page)
                return
            jump = yield page[text:lt], m[2].lower(), bool(m[1]), page[m.end() : end - 1], "", end
            if jump is not None:
                end = jump
                yield "", None, False, "", "", end  # the answer to send()
        at = text = end


class _Elements:
    """The block elements of a page by number: parent, soft noise, and the text that lies in them."""

    def __init__(self):
        self.parent, self.soft, self.size, self.tops = [-1], [False], [0], []

    def add(self, parent: int, soft: bool) -> int:
        self.parent.append(parent)
        self.soft.append(soft)
        self.size.append(0)
        return len(self.parent) - 1

    def settle(self, single: set[int]) -> tuple[list[bool], list[bool]]:
        """By number: whether it lies in the main container found by size, and whether soft noise that counts is above it or in it."""
        n = len(self.parent)
        total = list(self.size)
        for k in range(n - 1, 0, -1):
            total[self.parent[k]] += total[k]
        most = 0
        if not self.tops:
            most = max((k for k in range(1, n) if 2 * total[k] > total[0] and k not in single), default=0)
        void = [False] * n
        for k in [*self.tops, most]:
            while k > 0 and not void[k]:
                void[k] = True
                k = self.parent[k]
        inside, noisy = [False] * n, [False] * n
        for k in range(1, n):
            p = self.parent[k]
            inside[k] = k == most or inside[p]
            noisy[k] = noisy[p] or self.soft[k] and not void[k]
        return inside, noisy


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside article or main, noise by markup) of each block with text, in page order."""
    return [x[:3] for x in shaped(page)]


def shaped(page: str) -> list[tuple[str, bool, bool, str]]:
    """The blocks, each with its key: NUL and its place's digest outside the main container where the place has a name, else the text."""
    found: list[tuple[str, bool, bool, int, int, bool]] = []
    stack: list[tuple] = []  # name, content, noise, number, place, named
    elements, single = _Elements(), set()
    opened: Counter[str] = Counter()
    top = ("", False, False, 0, 0, False)
    _, content, noise, number, place, named = top
    parts: list[str] = []

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                found.append((text, content, noise, number, place, named))
                elements.size[number] += 0 if noise else len(text)
            parts.clear()

    def cut(k: int) -> None:
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    tags = _tags(page)
    for before, name, ends, attrs, literal, end in tags:
        parts.append(before)
        if name is None:
            parts.append(literal)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if ends:
            if name not in INLINE:
                close()
            for k in range(len(stack) - 1 if opened[name] else -1, -1, -1):
                if stack[k][0] == name:
                    if name in INLINE and stack[k][2:4] != (noise, number):
                        close()
                    cut(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break  # an inline end tag does not close blocks
            _, content, noise, number, place, named = stack[-1] if stack else top
            continue
        if name in RAW and name != "head":
            # Raw text: nothing but its own end tag counts; unclosed, it runs to the end.
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, end)
            if stop:
                tags.send(stop.end())
            elif name not in ("svg", "math", "object", "template", "noscript"):
                break
            continue
        bad = _noise(name, attrs, content)
        if name not in INLINE or bad and not noise:
            close()
        if name in ("body", "article", "main") and opened["head"]:  # an open head ends here
            stack[:] = [x for x in stack if x[0] != "head"]
            opened["head"] = 0
        if name == "p" and opened["p"]:
            k = len(stack) - 1
            while stack[k][0] in INLINE:
                k -= 1
            if stack[k][0] == "p":
                cut(k)  # a paragraph ends the one before it
        if name in ("li", "td", "th", "tr", "dd", "dt") and stack and stack[-1][0] == name:
            cut(len(stack) - 1)
        _, content, noise, number, place, named = stack[-1] if stack else top
        if name in VOID or attrs.rstrip().endswith("/"):
            continue
        if name not in INLINE or bad:
            number = elements.add(number, bad == "soft")
            part, names_it = _place(name, attrs)
            place, named = zlib.crc32(part.encode(), place), named or names_it
            if name in SINGLE:
                single.add(number)
            if name in CONTENT:
                elements.tops.append(number)
        content, noise = content or name in CONTENT, noise or bad == "hard"
        stack.append((name, content, noise, number, place, named))
        opened[name] += 1
    close()
    inside, noisy = elements.settle(single)
    known = lambda text, content, number, place, named: f"\0{place:08x}" if named and not content and not inside[number] else text
    return [(text, content, noise or noisy[number], known(text, content, number, place, named)) for text, content, noise, number, place, named in found]


def aligned(a: list[str], b: list[str]) -> set[int]:
    """Positions of a whose keys a longest common subsequence pairs; a place that comes several times in a row counts once."""
    def runs(keys):
        return [k for k, x in enumerate(keys) if not (k and x[:1] == "\0" and keys[k - 1] == x)]

    starts, other = runs(a), runs(b)
    hit = common([a[k] for k in starts], [b[k] for k in other])
    ends = [*starts[1:], len(a)]
    return {j for k in hit for j in range(starts[k], ends[k])}


def common(a: list[str], b: list[str]) -> set[int]:
    """Positions of a inside one longest common subsequence of a and b."""
    lo, out = 0, set()
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        out.add(lo)
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
        out.add(ea)
    # Middle part by Hunt and Szymanski: work follows the number of equal pairs, not the product.
    places: dict[str, list[int]] = {}
    for j in range(lo, eb):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least end in b of a common subsequence of each length
    links: list[tuple | None] = []
    for i in range(lo, ea):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def nearest(path: str, before: str | None, after: str | None) -> int:
    """0 if the page before is the nearer by its path, 1 if that after is; None is no neighbour."""
    if before is None or after is None:
        return 0 if after is None else 1
    shared = [len(os.path.commonprefix([path, other])) for other in (before, after)]
    return int(shared[1] > shared[0])


def main_text(own: list[tuple], path: str, before: tuple | None, after: tuple | None) -> str:
    """The page's text without what it shares with its neighbours, each (path, keys) or None.

    A neighbour with the same keys is a copy, which tells nothing of the template.
    """
    keys = [x[-1] if len(x) > 3 else x[0] for x in own]
    sides = [x if x is not None and x[1] != keys else None for x in (before, after)]
    k = nearest(path, *(None if x is None else x[0] for x in sides))
    near, other = (aligned(keys, sides[j][1]) if sides[j] else set() for j in (k, 1 - k))
    texts = near & other if sides[1 - k] and not any(x[1] for x in own) else near
    gone = {j for j in near | other if keys[j][:1] == "\0"} | {j for j in texts if keys[j][:1] != "\0"}
    return "\n\n".join(x[0] for j, x in enumerate(own) if x[1] and not x[2] or not x[2] and j not in gone)


PARSED = "chunk int, side int, k string, url string, h bigint, page_id bigint, host string, path string, body string, flags string, places string"
TEXTS = "page_id bigint, url string, text string, n_chars bigint"


def _parse(batches):
    """Each page's blocks: a line, a digit of flags and, where it is no text, the key of each."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            got = [shaped(page or "") for page in part.column(8).to_pylist()]
            body = pa.array(["\n".join(x[0] for x in y) for y in got], pa.string())
            flags = pa.array(["".join(str(CONTENT_FLAG * c + NOISE_FLAG * n) for _, c, n, _ in x) for x in got], pa.string())
            places = pa.array([" ".join(key[1:] if key[:1] == "\0" else "" for _, _, _, key in x) for x in got], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:8], body, flags, places], names=[*part.schema.names[:8], "body", "flags", "places"])


class _Run:
    """Neighbouring pages of one host with the same html."""

    def __init__(self, chunk: int, host: str, h: int, path: str, body: str, flags: str, places: str):
        self.key, self.path, self.last_path = (chunk, host, h), path, path
        self.lines = body.split("\n") if flags else []
        self.keys = [f"\0{p}" if p else t for t, p in zip(self.lines, places.split(" "))]
        self.flags, self.pages = flags, []

    def texts(self, before: "_Run | None", after: "_Run | None"):
        """page_id, url, text of the pages, which stand between two other runs of the chunk."""
        own = [(t, bool(int(f) & CONTENT_FLAG), bool(int(f) & NOISE_FLAG), key) for t, f, key in zip(self.lines, self.flags, self.keys)]
        near = lambda x: x is not None and self.key[1] != "" and x.key[:2] == self.key[:2]
        sides = (before.last_path, before.keys) if near(before) else None, (after.path, after.keys) if near(after) else None
        known: dict[int, str] = {}  # by the side that is nearer: all that differs between copies
        for i, url, path in self.pages:
            k = nearest(path, *(None if x is None else x[0] for x in sides))
            if k not in known:
                known[k] = main_text(own, path, *sides)
            yield i, url, known[k]


def _differenced(batches):
    """Texts of pages sorted by (chunk, side, k, url, h); rows of another side than 0 are neighbours from outside the chunk."""
    before: _Run | None = None
    run: _Run | None = None

    def batch_of(rows):
        texts = [x[2] for x in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.string()), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64())
            ],
            names=["page_id", "url", "text", "n_chars"]
        )

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            done: list = []
            for chunk, side, _, url, h, i, host, path, body, flags, places in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                if run is None or run.key != (chunk, host, h):
                    now = _Run(chunk, host, h, path, body, flags, places)
                    if run is not None:
                        done += run.texts(before, now)
                    before, run = run, now
                run.last_path = path
                if side == 0:
                    run.pages.append((i, url, path))
            if done:
                yield batch_of(done)
    if run is not None:
        yield batch_of(list(run.texts(before, None)))


#: Keys that are drawn for each chunk's bounds; no result depends on them.
KEYS_PER_CHUNK = 32


def _chunks(keys: DataFrame, n: int) -> list[str]:
    """Bounds that cut the sorted keys into n chunks of about equal numbers, from a bounded draw of them."""
    drawn = sorted({r["k"] for r in keys.select("k").orderBy(F.xxhash64("k")).limit(n * KEYS_PER_CHUNK).collect()})
    return sorted({drawn[j * len(drawn) // n] for j in range(1, n)}) if drawn else []


def _chunk_of(bounds: list[str], names: list[str], outside: list[tuple[int, int, str, str, int]] = ()):
    """Put the number of its chunk, and side 0, before the columns of each row; ``names`` begin with k, url, h.

    A row that another chunk needs as its neighbour from outside is repeated for that chunk.
    """
    wanted: dict[tuple, list[tuple[int, int]]] = {}
    for chunk, side, *key in outside:
        wanted.setdefault(tuple(key), []).append((chunk, side))

    def run(batches):
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            at = [(bisect_right(bounds, key[0]), 0, n) for n, key in enumerate(keys)]
            at += [(chunk, side, n) for n, key in enumerate(keys) if key in wanted for chunk, side in wanted[key]]
            rows = batch if len(at) == len(keys) else batch.take(pa.array([n for _, _, n in at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in at], pa.int32()), pa.array([x[1] for x in at], pa.int32()), *rows.columns],
                names=["chunk", "side", *names]
            )

    return B.tidy(run)


def _borders(keys: DataFrame) -> list[tuple[int, int, str, str, int]]:
    """(chunk, side, k, url, h) of the page that stands next to each chunk's first and last run.

    Four keys of each chunk reach the driver: its first and last, and those that end and begin
    the runs of equal html there.
    """
    row = F.struct("k", "url", "h", "host")
    ends = keys.groupBy("chunk").agg(F.min(row).alias("head"), F.max(row).alias("tail"))
    differs = lambda c: ~((F.col("host") == F.col(c + ".host")) & (F.col("h") == F.col(c + ".h")))
    inner = keys.join(ends, "chunk").groupBy("chunk", "head", "tail").agg(
        F.min(F.when(differs("head"), row)).alias("second"), F.max(F.when(differs("tail"), row)).alias("last_but")
    )
    found = sorted(inner.collect(), key=lambda r: r["chunk"])
    out = []
    same = lambda a, b: (a["host"], a["h"]) == (b["host"], b["h"])
    for side, first, names in ((-1, "head", ("head", "second", "last_but", "tail")), (1, "tail", ("tail", "last_but", "second", "head"))):
        last = other = None  # the row passed last, and the last one unlike it
        for r in found if side < 0 else reversed(found):
            for name in names:
                if (x := r[name]) is None:
                    continue
                if name == first and last is not None:
                    near = other if same(last, x) else last
                    if near is not None and near["host"] == x["host"] and x["host"]:
                        out.append((r["chunk"], side, near["k"], near["url"], near["h"]))
                if last is None or not same(last, x):
                    other = last
                last = x
    return out


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null or empty html gives an empty text. A neighbour with the same html is a copy and passed
    over, to the next page of the host that is none. A page alone on its host and one without a
    host in its URL (null URLs too) keep all blocks that their markup does not name as noise. Ties
    of host and path go by id, URL and html; repeated rows are each reported. A hot host spreads
    over many chunks of the sorted keys and is gathered nowhere; each chunk gets the page before
    and the page behind it as two more rows, so the text does not depend on where chunks begin.
    """
    spark = pages.sparkSession
    rows = pages.select(
        by_name(pages, id_col).cast("long").alias("page_id"), by_name(pages, url_col).cast("string").alias("url"),
        by_name(pages, html_col).cast("string").alias("html")
    )
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    keyed = rows.select("page_id", "url", host.alias("host"), path.alias("path"), F.xxhash64("html").alias("h"), "html")
    keyed = keyed.withColumn("k", F.concat_ws("\x01", "host", "path", F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    light = keyed.select("k", "url", "h", "host")
    bounds = _chunks(light, n)
    kinds = "chunk int, side int, k string, url string, h bigint"
    borders = _borders(light.mapInArrow(_chunk_of(bounds, light.columns), f"{kinds}, host string"))
    # Two rows of each chunk at most travel with the function.
    columns = ["k", "url", "h", "page_id", "host", "path", "html"]
    every = keyed.select(*columns).mapInArrow(_chunk_of(bounds, columns, borders), f"{kinds}, page_id bigint, host string, path string, html string")
    parsed = every.mapInArrow(B.tidy(_parse), PARSED)
    return parsed.repartitionById(n, "chunk").sortWithinPartitions("chunk", "side", "k", "url", "h").mapInArrow(B.tidy(_differenced), TEXTS)
