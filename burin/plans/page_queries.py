"""Page algebra over conversations: a conversation is a document, a turn is a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from burin.operators import pages as P
from burin.plans.registry import query, table


def _pages(spark, d):
    """doc_id, page_no from 1, text; repeated turns keep one page each."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    return P.with_position(rows, "doc_id", "turn").select("doc_id", F.col("pos").alias("page_no"), "text")


_PAGES = "pages_ AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS page_no, text FROM conversations)"
_TOTALS = "totals AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS total FROM pages_ GROUP BY doc_id)"
_LIST = "concat(doc_id % 7, ',', doc_id % 5 + 1, '-', doc_id % 5 + 1 + doc_id % 4, ', x,', doc_id % 3 + 2, ',5-2')"


def _list_sql(x: str) -> str:
    tokens = f"list_transform(string_split({x}, ','), lambda t: trim(t))"
    one = r"""CASE WHEN regexp_full_match(t, '\d+\s*-\s*\d+') AND CAST(regexp_extract(t, '(\d+)\s*-\s*(\d+)', 2) AS BIGINT) >= CAST(regexp_extract(t, '(\d+)\s*-\s*(\d+)', 1) AS BIGINT)
      THEN list_transform(range(CAST(regexp_extract(t, '(\d+)\s*-\s*(\d+)', 1) AS BIGINT), CAST(regexp_extract(t, '(\d+)\s*-\s*(\d+)', 2) AS BIGINT) + 1), lambda n: CAST(n AS INTEGER))
      WHEN regexp_full_match(t, '\d+') AND CAST(t AS BIGINT) >= 1 THEN [CAST(t AS INTEGER)] ELSE CAST([] AS INTEGER[]) END"""
    return f"flatten(list_transform({tokens}, lambda t: {one}))"


_IDS = "ids AS (SELECT DISTINCT conv_id AS doc_id FROM conversations)"


@query(f"WITH {_IDS} SELECT doc_id, array_to_string({_list_sql(_LIST)}, ' ') AS pages FROM ids")
def page_list_parse(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return rows.select("doc_id", F.array_join(P.parse_page_list(F.expr(_LIST)), " ").alias("pages"))


@query(f"""WITH {_IDS}, o AS (SELECT doc_id, CAST(doc_id % 6 AS INTEGER) AS total, {_list_sql(_LIST)} AS o FROM ids),
f AS (SELECT doc_id, total, o, list_filter(o, lambda p: p >= 1 AND p <= total) AS named FROM o),
n AS (SELECT doc_id, total, list_filter(named, lambda p, i: list_position(named, p) = i) AS named FROM f)
SELECT doc_id, array_to_string(list_concat(named, list_filter(list_transform(range(1, total + 1), lambda p: CAST(p AS INTEGER)), lambda p: NOT list_contains(named, p))), ' ') AS pages FROM n""")
def complete_order(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return rows.select("doc_id", F.array_join(P.complete_order(P.parse_page_list(F.expr(_LIST)), (F.col("doc_id") % 6).cast("int")), " ").alias("pages"))


@query(f"WITH {_IDS}, t AS (SELECT doc_id, list_transform(range(1, doc_id % 9 + 1), lambda p: CAST(p AS INTEGER)) AS every FROM ids) SELECT doc_id, array_to_string(list_filter(every, lambda p: p % 2 = 0), ' ') AS pares, array_to_string(list_filter(every, lambda p: p % 2 = 1), ' ') AS impares, array_to_string(every, ' ') AS todas FROM t")
def preset_pages(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    n = (F.col("doc_id") % 9).cast("int")
    return rows.select("doc_id", *[F.array_join(P.preset_pages(F.lit(p), n), " ").alias(p) for p in ("pares", "impares", "todas")])


@query(f"""WITH {_IDS}, t AS (SELECT doc_id, list_transform(range(1, doc_id % 6 + 1), lambda p: CAST(p AS INTEGER)) AS o, CAST(doc_id % 7 - 1 AS INTEGER) AS a, CAST(doc_id % 5 AS INTEGER) AS b FROM ids),
r AS (SELECT *, list_concat(o[1 : a], o[a + 2 :]) AS rest FROM t)
SELECT doc_id, array_to_string(CASE WHEN a >= 0 AND a < len(o) AND b < len(o) THEN list_concat(list_concat(rest[1 : b], [o[a + 1]]), rest[b + 1 :]) ELSE o END, ' ') AS pages FROM r""")
def move_in_order(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    order = P.up_to((F.col("doc_id") % 6).cast("int"))
    return rows.select("doc_id", F.array_join(P.move_in_order(order, (F.col("doc_id") % 7 - 1).cast("int"), (F.col("doc_id") % 5).cast("int")), " ").alias("pages"))


@query(f"WITH {_IDS}, t AS (SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS n, CAST(doc_id % 5 AS INTEGER) AS total FROM ids) SELECT doc_id, n > 0 AS split_ok, n > 0 AND n < total AS delete_ok FROM t")
def can_submit(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    n, total = F.col("doc_id") % 4, F.col("doc_id") % 5
    return rows.select("doc_id", P.can_submit(F.lit("split"), n, total).alias("split_ok"), P.can_submit(F.lit("delete"), n, total).alias("delete_ok"))


_NAMED = f"named AS (SELECT doc_id, {_list_sql(_LIST)} AS o FROM (SELECT DISTINCT doc_id FROM pages_))"


@query(f"""WITH {_PAGES}, {_NAMED}, u AS (SELECT doc_id, list_filter(o, lambda p, i: list_position(o, p) = i) AS o FROM named)
SELECT p.doc_id, p.page_no, CAST(list_position(u.o, p.page_no) AS INTEGER) AS pos, p.text FROM pages_ p JOIN u USING (doc_id) WHERE list_contains(u.o, p.page_no)""")
def pages_split(spark, d):
    return P.split(_pages(spark, d), P.parse_page_list(F.expr(_LIST))).select("doc_id", "page_no", "pos", "text")


@query(f"WITH {_PAGES}, {_NAMED} SELECT p.doc_id, p.page_no, p.text FROM pages_ p JOIN named USING (doc_id) WHERE NOT list_contains(named.o, p.page_no)")
def pages_delete(spark, d):
    return P.delete(_pages(spark, d), P.parse_page_list(F.expr(_LIST)))


@query(f"""WITH {_PAGES}, {_TOTALS}, {_NAMED},
f AS (SELECT doc_id, total, list_filter(o, lambda p: p >= 1 AND p <= total) AS o FROM named JOIN totals USING (doc_id)),
u AS (SELECT doc_id, total, list_filter(o, lambda p, i: list_position(o, p) = i) AS o FROM f),
w AS (SELECT doc_id, list_concat(o, list_filter(list_transform(range(1, total + 1), lambda p: CAST(p AS INTEGER)), lambda p: NOT list_contains(o, p))) AS o FROM u)
SELECT p.doc_id, p.page_no, CAST(list_position(w.o, p.page_no) AS INTEGER) AS pos FROM pages_ p JOIN w USING (doc_id)""")
def pages_reorder(spark, d):
    pages = _pages(spark, d)
    totals = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total"))
    rows = pages.join(totals, "doc_id")
    return P.split(rows, P.complete_order(P.parse_page_list(F.expr(_LIST)), F.col("total"))).select("doc_id", "page_no", "pos")


@query(f"WITH {_PAGES} SELECT doc_id // 3 AS target, doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id, page_no) AS INTEGER) AS pos FROM pages_")
def pages_merge(spark, d):
    rows = _pages(spark, d).select(F.expr("doc_id div 3").alias("target"), "doc_id", "page_no")
    return P.merge(rows, "target", "doc_id")


@query(f"WITH {_PAGES} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_pages, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_no)) AS body FROM pages_ GROUP BY doc_id")
def pages_text(spark, d):
    """Pages of a document joined in order, as text extraction does."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n\n")
    return _pages(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.md5(joined).alias("body"))
