"""Main text of web pages by differencing each page against its nearest URLs.

Every page becomes a list of text lines, one a block of the page. Pages are ordered by host
and URL path; a page's neighbours are the NEAR nearest pages of its host on either side in
that order whose lines are not all the same, however many copies lie between. The nearest by
path is the partner: the lists are aligned by longest common subsequence, and shared lines
go: they are the template of the site. A page that is nearly the same (see copies()) is
passed over for the next. An explicit article or main element is evidence: a line inside it
goes only if all neighbours share it that do not repeat half of the element, two at least, so
chance, passages that a few pages share and copies take nothing. Lines outside stay unless shared or noise. A page that no neighbour can
be differenced with is its article or main element, if that holds more than half of the page.
Template lines that differ on every page (a menu of own links, a comment, an advert) are
known by their element: nav, header, footer, aside, form, script, style, hidden elements, and
containers whose class, id or role says so.

The order is cut into ranges at keys from a bounded sample; copies and repeated rows have keys
of their own, so they are cut like all others. The neighbours across a cut come as rows of the
same shuffle, so a page's partner does not depend on where the cuts fall, and a host with a
third of all pages is many ranges. The driver sees keys alone, at most 2 * NEAR a range. Pages
are read and parsed twice, for the keys and for the lines, so that only keys are written;
pages that come in another order each time they are read should be written first.

Defined results: null or empty html gives an empty text; a null url is a host of its
own; equal URLs are ordered by page id; repeated rows each give a row. No line of the
main text is dropped or cut.
"""

from __future__ import annotations

import bisect
import hashlib
import html as html_lib
import itertools
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from burin.llm.common import persisted, sampled

#: Pages of a range, ranges at most, sampled keys for each range.
RANGE_PAGES, MOST_RANGES, KEYS_A_RANGE = 2000, 10_000, 20
#: Pages that share this part of their characters are copies of each other; neighbours on a side that are looked at.
COPY, NEAR = 0.9, 3

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|aria-label)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "canvas", "title"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_CELLS = {"td", "th"}
_NOISE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "fieldset"}
_MAIN = {"article", "main"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSED_BY = {name: closed | _INLINE for name, closed in _CLOSES.items()}
_NOISE_WORDS = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "sidebar", "aside", "footer", "header", "masthead",
    "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "disqus", "respond", "replies", "reply",
    "discussion", "related", "recommended", "recommendations", "share", "sharing", "social", "popup", "modal", "overlay", "widget", "pagination", "pager", "toolbar", "search", "copyright", "legal", "disclaimer", "tracking",
}
_NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_WORDS = re.compile(r"[a-z]+")


_NONE, _BY_WORD, _CERTAIN = range(3)
_SELF_CLOSED = re.compile(r"""(?:\A|[\s"'])/\Z""")
_NEXT = re.compile(r"<[a-zA-Z/!]")


def _noise(name: str, attributes: str, in_main: bool) -> int:
    """Whether an element is noise: for certain, or by a word of its class or id."""
    if name in _NOISE and not (name == "header" and in_main):
        return _CERTAIN
    if not attributes or name in ("body", "html") or name in _MAIN and not in_main and "comment" not in attributes.lower():
        return _NONE
    by_word = False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id") and not (name == "header" and in_main):
            by_word = by_word or not _NOISE_WORDS.isdisjoint(_WORDS.findall(value))
        elif key == "role" and value in _NOISE_ROLES or key == "hidden" and not value or key == "aria-hidden" and value == "true":
            return _CERTAIN
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _CERTAIN
    return _BY_WORD if by_word else _NONE


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """(line, noise by its element, inside an article or main element) in page order.

    A word of a class or id makes no noise of an element that holds the article (the longest
    article or main element) or, on a page without one, more than half of what is no certain noise.
    """
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    open_: list[tuple[str, int]] = []
    noise = main = total = 0
    begun: list[tuple[int, int, str]] = []
    by_word: list[tuple[int, int, int]] = []
    articles: list[tuple[int, int, int, bool]] = []
    depth: Counter[str] = Counter()

    def flush() -> None:
        if parts:
            if line := " ".join("".join(map(html_lib.unescape, parts)).split()):
                out.append((line, noise > 0, main > 0))
                nonlocal total
                total += len(line) * (noise == 0)
            parts.clear()

    def pop() -> None:
        nonlocal noise, main
        name, bad = open_.pop()
        depth[name] -= 1
        noise -= bad == _CERTAIN
        main -= name in _MAIN
        if bad == _BY_WORD or name in _MAIN:
            line, before, place = begun.pop()
            if bad == _BY_WORD:
                by_word.append((line, len(out), total - before))
            if name in _MAIN:
                articles.append((total - before, line, len(out), bad == _BY_WORD and "comment" in place))

    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        if tag is None:
            parts.append(page[at:])
            break
        if tag.start() > at:
            parts.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = (tag[1] or tag[4]), (tag[3] or tag[6] or "")
        if name not in _INLINE and name not in _CELLS:
            flush()
        elif name == "br" or name in _CELLS:
            parts.append(" ")
        if closing:
            if name not in _VOID and depth[name]:
                while open_[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _RAW:
            if _SELF_CLOSED.search(attributes):
                continue
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                code = _NEXT.search(page, at)
                at = code.start() if code else size
            continue
        if name in _VOID or attributes.endswith("/") and name in _INLINE:
            continue
        if name in _CLOSES:
            while open_ and open_[-1][0] in _CLOSED_BY[name] and any(depth[n] for n in _CLOSES[name]):
                pop()
        bad = _noise(name, attributes, main > 0)
        open_.append((name, bad))
        depth[name] += 1
        noise += bad == _CERTAIN
        main += name in _MAIN
        if bad == _BY_WORD or name in _MAIN:
            begun.append((len(out), total, attributes.lower()))
    flush()
    while open_:
        pop()
    article = max((a for a in articles if not a[3]), default=None)
    edges = [0] * (len(out) + 1)
    for line, end, held in by_word:
        if not (line <= article[1] and article[2] <= end if article and article[0] else 2 * held > total):
            edges[line] += 1
            edges[end] -= 1
    return [(text, bad or cover > 0, inside) for (text, bad, inside), cover in zip(out, itertools.accumulate(edges), strict=False)]


#: Matches of two lists that are linked one by one, at most: so many, or so many a line. Lists of more, whose lines repeat, are split first.
SMALL, LINKS = 4096, 8


def _chain(a: list[int], b: list[int]) -> Iterator[int]:
    """Places of a in a longest rising chain of matches (Hunt and Szymanski)."""
    where: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    chain: list[tuple[int, tuple | None]] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect.bisect_left(tails, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(link)
            else:
                tails[k], chain[k] = j, link
    link = chain[-1] if chain else None
    while link:
        yield link[0]
        link = link[1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of b and each prefix of a.

    One bit for each line of a in a Python integer, one sum for each line of b: a bit is
    cleared where the length of the prefix grows by one.
    """
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks.setdefault(x, bytearray(len(a) // 8 + 1))[i >> 3] |= 1 << (i & 7)
    masks = {x: int.from_bytes(m, "little") for x, m in masks.items()}
    full = (1 << len(a)) - 1
    state = full
    for x in b:
        if mask := masks.get(x):
            u = state & mask
            state = ((state + u) | (state - u)) & full
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def shared(a: list[int], b: list[int]) -> set[int]:
    """Places of a that a longest common subsequence of a and b takes.

    Common ends and lines that only one list has go first. Long lists are split (Hirschberg):
    the half of b that each part of a is aligned with follows from the lengths from both ends,
    so time is len(a) * len(b) / 64 and memory that of the lists, also where lines repeat.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = {*range(low), *range(len(a) - high, len(a))}
    both = set(a[low : len(a) - high]) & set(b[low : len(b) - high])
    places = [i for i in range(low, len(a) - high) if a[i] in both]
    work = [(places, [a[i] for i in places], [x for x in b[low : len(b) - high] if x in both])]
    while work:
        at, x, y = work.pop()
        if not x or not y:
            continue
        times = Counter(y)
        if sum(times[v] for v in x) <= max(SMALL, LINKS * (len(x) + len(y))):
            out.update(at[i] for i in _chain(x, y))
            continue
        if len(y) == 1:
            if y[0] in x:
                out.add(at[x.index(y[0])])
            continue
        half = len(y) // 2
        cut = int((_lengths(x, y[:half]) + _lengths(x[::-1], y[half:][::-1])[::-1]).argmax())
        work += [(at[:cut], x[:cut], y[:half]), (at[cut:], x[cut:], y[half:])]
    return out


@dataclass(eq=False)
class Page:
    """Lines of a page (text, noise, inside an article), a hash of each, and the characters of all; the rows that are this page, and its neighbours."""

    path: str
    content: str
    lines: list[tuple[str, bool, bool]]
    hashes: list[int] = field(init=False)
    weight: int = field(init=False)
    rows: list[tuple] = field(default_factory=list)
    before: list[Page] = field(default_factory=list)
    after: list[Page] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.hashes = [hash(line) for line, _, _ in self.lines]
        self.weight = sum(len(line) for line, _, _ in self.lines)


def copies(page: Page, other: Page, gone: set[int]) -> bool:
    """Whether two pages are nearly the same: shared lines are nearly all of both, and at least half of the page's article if it has one."""
    size = lambda places: sum(len(page.lines[i][0]) for i in places)
    body = [i for i, (_, noise, inside) in enumerate(page.lines) if inside and not noise]
    return size(gone) >= COPY * max(page.weight, other.weight) and 2 * size(i for i in body if i in gone) >= size(body)


def main_text(page: Page, partners: list[Page]) -> str:
    """The page's own lines, differenced against the partners that share lines and are no copies of it, nearest first.

    A line outside a container goes if the nearest such partner has it; one inside goes if
    all partners have it that do not repeat the container, two at least. A page without such a partner is its
    container, if that holds more than half of what is no noise, and else all of this.
    """
    lines = page.lines
    body = [i for i, (_, noise, inside) in enumerate(lines) if inside and not noise]
    body_weight = sum(len(lines[i][0]) for i in body)
    differenced, witnesses = [], []
    for partner in partners:
        gone = shared(page.hashes, partner.hashes)
        if gone and copies(page, partner, gone):
            continue
        if gone:
            differenced.append(gone)
        if 2 * sum(len(lines[i][0]) for i in body if i in gone) < body_weight:
            witnesses.append(gone)
        if differenced and not body:
            break
    if not differenced:
        contained = 2 * body_weight > sum(len(line) for line, noise, _ in lines if not noise)
        return "\n".join(line for line, noise, inside in lines if not noise and (inside or not contained))
    template = set.intersection(*witnesses) if len(witnesses) > 1 else set()
    return "\n".join(line for i, (line, noise, inside) in enumerate(lines) if not noise and i not in (template if inside else differenced[0]))


def nearness(a: str, b: str) -> tuple[int, int]:
    """Shared leading segments of two paths, then shared leading characters."""
    x, y = a.split("/"), b.split("/")
    segments = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return segments, next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


_SEPARATOR = "\x01"


def _lined(batch: pa.RecordBatch, i: int) -> tuple[str, bytes, str]:
    """(lines, a byte of marks for each, key) of a page; columns page_id, url, html, host, path, place, number."""
    own = lines_of(batch.column(2)[i].as_py() or "")
    text, marks = "\n".join(line for line, _, _ in own), bytes(noise + 2 * inside for _, noise, inside in own)
    content = hashlib.blake2b(text.encode("utf-8", "replace") + b"\0" + marks, digest_size=16).hexdigest()
    return text, marks, _SEPARATOR.join([*(batch.column(c)[i].as_py() for c in (3, 4, 5)), content, batch.column(6)[i].as_py()])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array([_lined(batch, i)[2] for i in range(batch.num_rows)], pa.string())], ["k"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            made, start, size = [], at, 0
            while at < batch.num_rows and size < 8 << 20:
                made.append(_lined(batch, at))
                size += len(made[-1][0])
                at += 1
            lines, marks, keys = zip(*made, strict=True)
            kept = batch.slice(start, at - start)
            yield pa.record_batch([kept.column(0), kept.column(1), pa.array(keys, pa.string()), pa.array(lines, pa.string()), pa.array(marks, pa.binary())], ["page_id", "url", "k", "lines", "marks"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """b, k sorted by both in; of each range the keys of its first host's first NEAR contents (side 0) and its last host's last ones (side 1)."""

    def rows(b: int, first: list[str], last: dict[str, str]) -> pa.RecordBatch:
        keys = [*first, *last.values()]
        sides = [0] * len(first) + [1] * len(last)
        return pa.record_batch([pa.array([b] * len(keys), pa.int32()), pa.array(sides, pa.int32()), pa.array(keys, pa.string())], ["b", "side", "k"])

    at, first, last, host, start, met = None, [], {}, None, None, set()
    for batch in batches:
        for b, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own, _, _, content, _ = k.split(_SEPARATOR)
            if b != at:
                if at is not None:
                    yield rows(at, first, last)
                at, first, last, host, start, met = b, [], {}, own, own, set()
            if own != host:
                host, last = own, {}
            if own == start and len(first) < NEAR and content not in met:
                first.append(k)
                met.add(content)
            last.setdefault(content, k)
            if len(last) > NEAR:
                del last[next(iter(last))]
    if at is not None:
        yield rows(at, first, last)


def _across(edges: dict[int, tuple[list[str], list[str]]]) -> list[tuple[int, str]]:
    """(range, key) of the pages of other ranges that a range's pages have as neighbours."""
    order, out = sorted(edges), []
    part = lambda k, i: k.split(_SEPARATOR)[i]
    for i, b in enumerate(order):
        for step, (near, far) in ((-1, (0, 1)), (1, (1, 0))):
            own = edges[b][near][0 if near == 0 else -1]
            host, met, j = part(own, 0), set(), i + step
            while 0 <= j < len(order) and len(met) < NEAR:
                there = edges[order[j]]
                for k in there[far] if far == 0 else reversed(there[far]):
                    if part(k, 0) == host and part(k, 3) not in met and len(met) < NEAR:
                        met.add(part(k, 3))
                        out.append((b, k))
                if part(there[near][0 if near == 0 else -1], 0) != host:
                    break
                j += step
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    spark = pages.sparkSession
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = slim.schema["page_id"].dataType
    address = F.translate(F.coalesce("url", F.lit("")), _SEPARATOR, " ")
    host = F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", "")
    place = F.translate(F.coalesce(F.col("page_id").cast("string"), F.lit("")), _SEPARATOR, " ")
    if isinstance(kind, IntegralType):
        place = F.lpad(place, 20, "0")
    # A number makes the keys of repeated rows differ, so that no range must hold all of them.
    number = F.hex(F.monotonically_increasing_id())
    named = slim.select("page_id", "url", "html", host.alias("host"), path.alias("path"), place.alias("place"), number.alias("number"))
    held = persisted(named.mapInArrow(_keys, "k string"))
    n = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // RANGE_PAGES)))
    keys = sorted(r["k"] for r in sampled(held.select("k"), n * KEYS_A_RANGE, 31, "k").collect())
    cuts = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return k.map(lambda x: bisect.bisect_right(cuts, x))

    dealt = lambda df: df.repartition(n, "b").sortWithinPartitions("b", "k")
    found = dealt(held.select(range_of("k").alias("b"), "k")).mapInArrow(_edges, "b int, side int, k string").collect()  # 2 * NEAR keys a range
    edges: dict[int, tuple[list[str], list[str]]] = {}
    for r in found:
        edges.setdefault(r["b"], ([], []))[r["side"]].append(r["k"])
    rows = named.mapInArrow(_parsed, f"page_id {kind.simpleString()}, url string, k string, lines string, marks binary").withColumn("b", range_of("k"))
    here = F.struct("b", F.lit(False).alias("outer"))
    outer: dict[str, list[int]] = {}
    for b, k in _across(edges):
        outer.setdefault(k, []).append(b)
    places = F.array(here)
    if outer:
        rows = rows.join(F.broadcast(spark.createDataFrame(list(outer.items()), "k string, others array<int>")), "k", "left")  # 2 * NEAR keys a range
        there = F.transform(F.coalesce("others", F.array().cast("array<int>")), lambda b: F.struct(b.alias("b"), F.lit(True).alias("outer")))
        places = F.concat(places, there)
    spread = rows.withColumn("at", F.explode(places)).select("at.b", "k", "page_id", "url", "lines", "marks", "at.outer")
    return dealt(spread).mapInArrow(_difference, f"page_id {kind.simpleString()}, url string, text string, n_chars long")


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and key in, neighbours from other ranges among them; the text of each row of the range out.

    Held at a time: the last NEAR pages and those that wait for the NEAR after them.
    """
    kind, held, size = None, [], 0

    def done(page: Page) -> None:
        nonlocal size
        if page.rows:
            near = sorted(((nearness(page.path, p.path), p) for p in [*page.before, *page.after]), key=lambda x: x[0], reverse=True)
            text = main_text(page, [p for _, p in near])
            held.extend((*row, text, len(text)) for row in page.rows)
            size += len(text) * len(page.rows)
        page.before = page.after = page.rows = ()

    def out() -> pa.RecordBatch:
        nonlocal size
        ids, urls, texts, sizes = zip(*held, strict=True)
        held.clear()
        size = 0
        return pa.record_batch([pa.array(ids, kind), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["page_id", "url", "text", "n_chars"])

    at, recent, waiting = None, deque(maxlen=NEAR), deque()
    for batch in batches:
        kind = batch.schema.field(2).type
        for i, (b, k, page_id, url) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
            host, path, _, content, _ = k.split(_SEPARATOR)
            if (b, host) != at:
                while waiting:
                    done(waiting.popleft())
                recent.clear()
                at = b, host
            page = next((p for p in recent if p.content == content), None)
            if page is None:
                text, marks = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                page = Page(path, content, [(line, bool(m & 1), m > 1) for line, m in zip(text.split("\n"), marks, strict=False)])
                page.before = list(recent)
                for p in waiting:
                    p.after.append(page)
                recent.append(page)
                waiting.append(page)
                while len(waiting[0].after) >= NEAR:
                    done(waiting.popleft())
            if not batch.column(6)[i].as_py():
                page.rows.append((page_id, url))
            if size > 4 << 20 or len(held) >= 2000:
                yield out()
    while waiting:
        done(waiting.popleft())
    if held:
        yield out()
