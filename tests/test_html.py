"""Pages: the token fold against a reader that goes byte by byte, and regions cut out of bytes."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from burin.functions import media
from burin.operators import html as H

SPACE = " \t\n\r"
RAW = ("script", "style", "title", "textarea", "xmp", "noscript")
PARTS = (
    "<head>", "</head>", "<body>", "</body>", "<HEAD/>", "</ body >", "<meta name=author content=x>", '<meta property="og:x" content="a > b">', "<META charset=utf-8>", "<meta name='viewport'>", "<meta name = 'q' / content=z>",
    "<meta itemprop=y content=>", "<meta http-equiv=Content-Type content='text/html; charset=l1'>", "<link rel='x me' href=/a>", "<link rel=icon>", "<link rel=PUBLISHER>", "<script>", "</script>", "<script/>", "</script >", "<title>", "</title>", "<style a='>'>", "</style>",
    "<!-- ", "-->", "<!doctype html>", "<!x [ <!y '>'> ]>", "<!x [", "<plaintext>", "<p>", "</p>", "<a b='", "'", '"', "<", ">", "< ", "text é ", "<b c=d/>", "<metadata name=x>", "<linkrel=me>",
)


def tag_end(s, i):
    quote = ""
    while i < len(s):
        c = s[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == ">":
            return i + 1
        i += 1
    return -1


def declaration_end(s, i):
    quote, depth = "", 0
    while i < len(s):
        c = s[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "[":
            depth += 1
        elif c == "]":
            depth = max(0, depth - 1)
        elif c == ">" and not depth:
            return i + 1
        i += 1
    return -1


def raw_end(s, i, name):
    low = s.lower()
    while (i := low.find(f"</{name}", i)) >= 0:
        after = i + len(name) + 2
        if after >= len(s) or s[after] in SPACE + ">":
            return tag_end(s, after)
        i += 1
    return -1


def read(s):
    """(name, section, start, end, attributes) of the tags that count; None for a page that cannot be read."""
    out, section, i = [], "", 0
    while (i := s.find("<", i)) >= 0:
        if s.startswith("<!--", i):
            end = s.find("-->", i + 4)
            if end < 0:
                return None
            i = end + 3
            continue
        if s.startswith("<!", i):
            end = declaration_end(s, i + 2)
            if end < 0:
                return None
            out.append(("!", section, i, end, {}))
            i = end
            continue
        end = tag_end(s, i + (2 if s.startswith("</", i) else 1))
        if end < 0:
            return None
        if s[i + 1] == "/":
            if s[i + 2 : end - 1].strip().lower() in ("head", "body"):
                section = ""
            i = end
            continue
        at = i + 1
        while at < end - 1 and s[at] not in SPACE + "/>":
            at += 1
        name = s[i + 1 : at].lower()
        if not name:
            return None
        if name in ("meta", "link"):
            out.append((name, section, i, end, attributes(s, at, end - 1)))
        closed = s[end - 2] == "/"
        if not closed:
            section = name if name in ("head", "body") else section
            if name in RAW:
                end = raw_end(s, end, name)
                if end < 0:
                    return None
            if name == "plaintext":
                break
        i = end
    return out


def attributes(s, i, end):
    out = {}
    while i < end:
        while i < end and s[i] in SPACE:
            i += 1
        if i >= end or s[i] in "/>":
            break
        a = i
        while i < end and s[i] not in SPACE + "=/>":
            i += 1
        name, value = s[a:i].lower(), ""
        while i < end and s[i] in SPACE:
            i += 1
        if i < end and s[i] == "=":
            i += 1
            while i < end and s[i] in SPACE:
                i += 1
            if i < end and s[i] in "'\"":
                close = s.find(s[i], i + 1, end)
                value, i = (s[i + 1 : close], close + 1) if close >= 0 else (s[i + 1 : end], end)
            else:
                a = i
                while i < end and s[i] not in SPACE + ">":
                    i += 1
                value = s[a:i]
        if name:
            out.setdefault(name, value)
    return out


def removable(tag):
    name, _, a, b, have = tag
    if name == "link" and {"author", "me", "publisher"} & set(have.get("rel", "").lower().split()):
        return ("links", a, b)
    if name == "meta" and "charset" not in have and "http-equiv" not in have and have.get("name", "").strip().lower() != "viewport" and any(have.get(k, "").strip() for k in ("name", "property", "itemprop")):
        return ("meta", a, b)
    return None


def without(data, regions):
    gone = bytearray(len(data))
    for a, b in regions:
        for i in range(max(0, a), min(b, len(data))):
            gone[i] = 1
    return bytes(c for c, g in zip(data, gone, strict=True) if not g)


def test_token_fold_equals_a_reader_that_goes_byte_by_byte(spark):
    rng = random.Random(12)
    pages = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, page string")
    raw = F.encode("page", "UTF-8")
    got = df.select("i", H.html_regions(F.decode(raw, "ISO-8859-1")).alias("r"), H.html_entries(F.col("page")).alias("e"), H.strip_html(raw).alias("s"), H.strip_html(raw, ("links",)).alias("l")).collect()
    unread = 0
    for row in got:
        data = pages[row["i"]].encode()
        found = read(data.decode("latin-1"))
        unread += found is None
        regions = [r for r in map(removable, found or []) if r]
        assert [tuple(r) for r in row["r"]] == regions == list(media.html_removable(data)), pages[row["i"]]
        assert bytes(row["s"]) == without(data, [r[1:] for r in regions]) == media.strip_html(data)
        assert bytes(row["l"]) == without(data, [r[1:] for r in regions if r[0] == "links"])
        metas = [t for t in found or [] if removable(t) and t[0] == "meta"]
        assert [e["where"].rpartition(" > ")[0] for e in row["e"] if e["block"] == "meta"] == [t[1] for t in metas]
        assert [e["ord"] for e in row["e"]] == list(range(1, len(row["e"]) + 1))
        assert (row["e"] == []) == (found is None or not data) and media.html_readable(data) == (found is not None)
    assert 500 < unread < 3500


def test_cleaning_leaves_pages_that_cannot_be_read(spark):
    rows = [(1, b"<script>var a;<meta name=author content=x>"), (2, b"<!-- <meta name=author content=x>"), (3, b"<plaintext><meta name=author content=x>"), (4, b"<meta name=author content=x>\xff\xfe<p>"), (5, b""), (6, None)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b), "r") for i, b in rows], "id int, page binary, remark string")
    got = {r["id"]: r for r in H.cleaned_pages(df, "page").collect()}
    assert [bytes(got[i]["result"]) for i in (1, 2, 3, 5)] == [rows[0][1], rows[1][1], rows[2][1], b""] and bytes(got[4]["result"]) == b"\xff\xfe<p>" and got[6]["result"] is None
    assert [got[i]["status"] for i in range(1, 7)] == ["unverifiable", "unverifiable", "clean", "clean", "unverifiable", None]


def test_values_of_entries(spark):
    page = f"<meta name=a content='  x   y '><meta name=b content='{'\U0001f600' * 120}'><meta name=b content='a{'\U0001f600' * 120}'><meta name=c>"
    got = spark.createDataFrame([(page,)], "p string").select(F.explode(H.html_entries(F.col("p"))).alias("e")).select("e.*").collect()
    assert [r["value"] for r in got[:4]] == ["x y", "\U0001f600" * 100 + "…", "a" + "\U0001f600" * 99 + "�…", "Presente"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=30), st.lists(st.tuples(st.integers(0, 35), st.integers(0, 35)), max_size=6)), min_size=1, max_size=20))
def test_subtraction_of_regions(spark, rows):
    df = spark.createDataFrame([(i, bytearray(b), [{"start": a, "end": z} for a, z in r]) for i, (b, r) in enumerate(rows)], "i int, b binary, r array<struct<start:int,end:int>>")
    got = {r["i"]: bytes(r["s"]) for r in df.select("i", H.subtract(F.col("b"), F.col("r")).alias("s")).collect()}
    for i, (b, r) in enumerate(rows):
        assert got[i] == without(b, [(a, z) for a, z in r if z > a])


def test_no_python_worker(spark):
    df = spark.createDataFrame([(1, bytearray(b"x"))], "id int, page binary")
    plan = H.cleaned_pages(df, "page").select("*", H.strip_frontmatter(F.col("page")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_pages_take_one_pass(spark):
    pages = ["<meta " + "a='b' " * 100_000 + ">", '<x "' * 100_000, "<script>" * 100_000, "<!--" * 100_000, "x<b>" * 100_000, "<![" * 50_000, "<" * 100_000]
    got = spark.createDataFrame([(p,) for p in pages], "p string").select(F.size(H.html_entries(F.col("p"))).alias("n"), F.size(H.html_regions(F.col("p"))).alias("m")).collect()
    assert [r["n"] for r in got] == [1, 0, 0, 0, 1, 0, 0] and all(r["m"] == 0 for r in got)
    for p in pages:
        list(media.html_removable(p.encode()))
