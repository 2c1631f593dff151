"""Metadata inventories: HTML pages, frontmatter, grouping, search, stripping and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from burin.operators import html as H
from burin.operators import inventory as I
from burin.operators import ranges as R
from burin.plans.registry import query, table
from burin.plans.text_queries import trimmed

# Ten shapes of whole pages by id: (what comes after <head>, after <body>, after the page), as SQL that both engines read; and the same without what a cleaning removes.
_Q = "chr(39)"
_AUTHOR = """concat('<meta name="author" content="', url, '">')"""
_LINK = """concat('<link rel="stylesheet ME" href="/u/', page_id, '">')"""
_TITLE = f"""concat('<meta property=', {_Q}, 'og:title', {_Q}, ' content=', {_Q}, 'a > "b"', {_Q}, '>')"""
_LONG = """concat('<meta name="generator" content=" ', repeat('ab ', 100), '">')"""
_SHAPES = (
    ("''", "''", "''"),
    (_AUTHOR, _AUTHOR, "''"),
    (_TITLE, "''", "''"),
    ("""'<meta name="description" content="charset=foo"><META NAME=Viewport CONTENT=x>'""", "''", "''"),
    ("''", "''", """'<script>var a;<meta name="author" content="x">'"""),
    ("''", "''", """'<plaintext><meta name="author" content="x">'"""),
    ("''", "''", """'<!-- <meta name="author" content="x">'"""),
    (f"concat({_LINK}, '<link rel=icon href=x>')", "'<a rel=author></a><textarea><meta name=a></textarea>'", "''"),
    ("""'<meta http-equiv="Content-Type" content="text/html; charset=latin1"><meta itemprop=year content="">'""", "''", "''"),
    ("'<style>@media{}</style>'", "''", _LONG),
)
_STRIPPED = {
    1: ("''", "''", "''"), 2: ("''", "''", "''"), 3: ("'<META NAME=Viewport CONTENT=x>'", "''", "''"), 7: ("'<link rel=icon href=x>'", _SHAPES[7][1], "''"),
    8: ("""'<meta http-equiv="Content-Type" content="text/html; charset=latin1">'""", "''", "''"), 9: (_SHAPES[9][0], "''", "''"),
}


def _page(shapes) -> str:
    piece = lambda i: "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN {s[i]}" for k, s in enumerate(shapes)) + " END"
    return f"concat(replace(replace(html, '<head>', concat('<head>', {piece(0)})), '<body>', concat('<body>', {piece(1)})), {piece(2)})"


_PAGE = _page(_SHAPES)
_ENTRIES = """entries AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY t.ord) AS INTEGER) AS ord, t.place AS "where", t.key, t.label, t.value, t.sensitivity, t.removal FROM pages, LATERAL (VALUES
    (1, 1, 'head > meta[name=author]', 'author', 'author', url, 'medium', 'with-container'),
    (1, 2, 'body > meta[name=author]', 'author', 'author', url, 'medium', 'with-container'),
    (2, 1, 'head > meta[property=og:title]', 'og:title', 'og:title', 'a > "b"', 'low', 'with-container'),
    (3, 1, 'head > meta[name=description]', 'description', 'description', 'charset=foo', 'low', 'with-container'),
    (7, 4, 'head > link[rel=me]', 'rel:me', 'Enlace de autoría (me)', concat('/u/', page_id), 'medium', 'with-container'),
    (8, 1, 'head > meta[itemprop=year]', 'year', 'year', 'Presente', 'low', 'with-container'),
    (9, 1, CASE WHEN contains(html, '</body>') THEN 'meta[name=generator]' ELSE 'body > meta[name=generator]' END, 'generator', 'generator', concat(substr(repeat('ab ', 100), 1, 200), '…'), 'low', 'with-container'),
    (-1, 5, 'documento', 'doctype', 'Tipo de documento', regexp_extract(html, '(?i)<!doctype[^>]*>'), 'low', 'never'),
    (-1, 6, 'head > meta[charset]', 'charset', 'Juego de caracteres', CASE WHEN page_id % 10 = 8 THEN 'latin1' ELSE regexp_extract(html, '<meta charset="([^"]*)"', 1) END, 'low', 'never'),
    (-1, 7, 'cabecera', 'viewport', 'Viewport', CASE WHEN page_id % 10 = 3 THEN 'Sí' ELSE 'No' END, 'low', 'never')) AS t(shape, ord, place, key, label, value, sensitivity, removal)
  WHERE page_id % 10 NOT IN (4, 6) AND (shape = -1 OR shape = page_id % 10))"""


def _made(spark, d):
    return table(spark, d, "pages").select("page_id", F.expr(_PAGE).alias("page"))


def _entries(spark, d):
    return I.exploded(_made(spark, d), I.html_entries(F.col("page")), "page_id")


@query(f"WITH {_ENTRIES} SELECT page_id, CAST(ord AS INTEGER) AS ord, \"where\", key, label, value, sensitivity, removal FROM entries")
def html_inventory(spark, d):
    return _entries(spark, d).select("page_id", "ord", "where", "key", "label", "value", "sensitivity", "removal")


@query("""SELECT page_id, key, value FROM (
  SELECT page_id, 'doctype' AS key, regexp_extract(html, '(?i)<!doctype[^>]*>') AS value FROM pages
  UNION ALL SELECT page_id, 'charset', regexp_extract(html, '(?i)<meta charset="([^"]*)"', 1) FROM pages
  UNION ALL SELECT page_id, 'viewport', 'No' FROM pages) WHERE value <> ''""")
def html_inventory_pages(spark, d):
    return I.exploded(table(spark, d, "pages"), I.html_entries(F.col("html")), "page_id").select("page_id", "key", "value")


@query("""SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site, CAST(count(DISTINCT page_id) AS BIGINT) AS n_pages, CAST(3 * count(*) AS BIGINT) AS n_entries, CAST(0 AS BIGINT) AS removable FROM pages GROUP BY site""")
def html_inventory_summary(spark, d):
    """Flagship: the inventory of every page, summed by site."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("site"), I.html_entries(F.col("html")).alias("entries"))
    removable = F.size(F.filter("entries", lambda e: e["removal"] != "never"))
    return pages.groupBy("site").agg(F.countDistinct("page_id").alias("n_pages"), F.sum(F.size("entries")).cast("long").alias("n_entries"), F.sum(removable).cast("long").alias("removable"))


@query(f"WITH {_ENTRIES} SELECT page_id, \"where\", CAST(min(ord) AS INTEGER) AS first_ord, CAST(count(*) AS BIGINT) AS n_entries, string_agg(concat(key, '=', value), '; ' ORDER BY ord) AS rows FROM entries GROUP BY page_id, \"where\"")
def inventory_groups(spark, d):
    return I.groups(_entries(spark, d), "page_id")


@query(f"WITH {_ENTRIES} SELECT page_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (removal <> 'never') AS BIGINT) AS removed, CAST(count(*) FILTER (removal = 'never') AS BIGINT) AS preserved, CAST(count(*) FILTER (sensitivity = 'high') AS BIGINT) AS high_risk FROM entries GROUP BY page_id")
def inventory_summary(spark, d):
    return I.summary(_entries(spark, d), "page_id")


@query(f"WITH {_ENTRIES} SELECT page_id, CAST(ord AS INTEGER) AS ord, key, value FROM entries WHERE contains(lower(key), 'meta') OR contains(lower(label), 'meta') OR contains(lower(value), 'meta') OR contains(lower(\"where\"), 'meta')")
def inventory_search(spark, d):
    return I.search(_entries(spark, d), "page_id", "META").select("page_id", "ord", "key", "value")


@query(f"""SELECT page_id, sha256({_page([_STRIPPED.get(k, s) for k, s in enumerate(_SHAPES)])}) AS page FROM pages""")
def strip_html(spark, d):
    """Removable tags go, none inside scripts, comments or pages that cannot be read: compared byte for byte, without a Python worker."""
    return _made(spark, d).select("page_id", F.sha2(H.strip_html(F.encode("page", "UTF-8")), 256).alias("page"))


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN '<meta name="author" content="A"><META property=og:x content=1>' ELSE '' END AS m,
  CASE WHEN doc_id % 5 IN (0, 2) THEN concat('<link href="/u/', doc_id, '" rel="me">') WHEN doc_id % 5 = 4 THEN '<style><meta name=author content=A>' ELSE '' END AS l, concat('<p>', replace(replace(text, '<', ' '), '>', ' '), '</p>') AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(concat(l, b)) AS page, sha256(concat(m, l, b)) AS same, CASE WHEN doc_id % 5 IN (0, 2) THEN 'remaining' WHEN doc_id % 5 = 4 THEN 'unverifiable' ELSE 'clean' END AS status,
  CAST(CASE WHEN doc_id % 5 IN (0, 2) THEN 1 ELSE 0 END AS BIGINT) AS remaining FROM p""")
def verify_clean(spark, d):
    """Light mode with the block `meta` on pages of five shapes, whole texts in them: links stay and are found, an open style cannot be verified, the rest byte for byte."""
    k = F.col("doc_id") % 5
    m = F.when(k.isin(0, 1), '<meta name="author" content="A"><META property=og:x content=1>').otherwise("")
    link = F.when(k.isin(0, 2), F.concat(F.lit('<link href="/u/'), F.col("doc_id").cast("string"), F.lit('" rel="me">'))).when(k == 4, "<style><meta name=author content=A>").otherwise("")
    body = F.concat(F.lit("<p>"), F.translate("text", "<>", "  "), F.lit("</p>"))
    pages = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.encode(F.concat(m, link, body), "UTF-8").alias("page"))
    made = H.cleaned_pages(pages, "page", "light", ("meta",)).select("doc_id", "page", "result", "status", "remaining")
    named = made.withColumnsRenamed({"result": "cleaned", "status": "verdict", "remaining": "left"})
    both = H.cleaned_pages(named, "page", "light")
    return both.select("doc_id", F.sha2("cleaned", 256).alias("page"), F.sha2("result", 256).alias("same"), F.col("verdict").alias("status"), F.col("left").alias("remaining"))


@query("""SELECT doc_id, sha256(concat('\n', text)) AS deep, sha256(concat('---\ntitle: ', doc_id, '\nkey:  v \n---\n', '\n', text)) AS light FROM documents WHERE text IS NOT NULL""".replace("\n", "' || chr(10) || '"))
def strip_frontmatter(spark, d):
    """Deep mode takes the frontmatter off and leaves the text; light mode without a block leaves everything. No Python worker."""
    md = F.encode(F.concat(F.lit("---\ntitle: "), F.col("doc_id").cast("string"), F.lit("\nkey:  v \n---\n\n"), F.col("text")), "UTF-8")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(H.strip_frontmatter(md), 256).alias("deep"), F.sha2(md, 256).alias("light"))


@query(f"""WITH {_ENTRIES} SELECT page_id, CAST(ord AS INTEGER) AS ord, removal <> 'never' AS deep, removal <> 'never' AND page_id % 2 = 0 AS light,
  CASE WHEN removal = 'never' THEN 'dato técnico o que el limpiador actual no elimina: se conserva' WHEN page_id % 2 = 1 THEN 'el modo Ligero no elimina esta entrada' ELSE 'se borra junto con su contenedor' END AS detail FROM entries""")
def removal_plan(spark, d):
    """What each mode does to each entry; odd pages have no block to send."""
    e = _entries(spark, d)
    some = F.col("page_id") % 2 == 0
    return e.select("page_id", "ord", I.will_remove(F.col("removal"), "deep", some).alias("deep"), I.will_remove(F.col("removal"), "light", some).alias("light"), I.row_plan(F.col("removal"), "light", some)["detail"].alias("detail"))


@query(f"""WITH {_ENTRIES} SELECT page_id, key, CASE key WHEN 'doctype' THEN 'Se conserva: es la declaración estructural del documento.' ELSE 'Se conserva: quitarlo rompe la codificación de la página.' END AS preserved_note FROM entries WHERE key IN ('doctype', 'charset')""")
def preserved_notes(spark, d):
    return I.preserved(_entries(spark, d)).select("page_id", "key", "preserved_note")


@query("""WITH r AS (SELECT l_orderkey, l_partkey % 50 AS s, l_partkey % 50 + CAST(l_quantity AS BIGINT) % 12 AS e FROM lineitem),
w AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT l_orderkey, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end" FROM g GROUP BY l_orderkey, island""")
def region_subtraction(spark, d):
    s = F.col("l_partkey") % 50
    rows = table(spark, d, "lineitem").select("l_orderkey", s.alias("start"), (s + F.col("l_quantity").cast("long") % 12).alias("end"))
    return R.merged_regions(rows, "l_orderkey")


_FRONT = "concat('---', chr(10), 'title: Doc ', doc_id, chr(10), 'author:  ', source, ' ', chr(10), 'no colon', chr(10), 'date: 2024-01-01T10:00', chr(10), '---', chr(10), text)"


@query("SELECT doc_id, CAST(t.ord AS INTEGER) AS ord, t.key, t.value FROM documents, LATERAL (VALUES (1, 'title', concat('Doc ', doc_id)), (2, 'author', " + trimmed("source") + "), (3, 'date', '2024-01-01T10:00')) AS t(ord, key, value)")
def frontmatter_scan(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr(_FRONT.replace("chr(10)", "'\\n'")).alias("md"))
    return I.exploded(rows, I.frontmatter_entries(F.col("md")), "doc_id").select("doc_id", "ord", "key", "value")
