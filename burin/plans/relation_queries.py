"""Ranges, references, labels and verification as relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from burin.operators import closure, labels, ranges
from burin.operators import html as H
from burin.operators import inventory as I
from burin.plans.meta_queries import _made
from burin.plans.registry import query, table

_ISLANDS = """w AS (SELECT *, max(e) OVER (PARTITION BY a ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY a ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM w),
islands AS (SELECT a, min(s) AS s, max(e) AS e FROM g GROUP BY a, island)"""


@query(f"""WITH r AS (SELECT 'all' AS a, l_orderkey * 10 + l_linenumber AS s, l_orderkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) % 13 AS e FROM lineitem), {_ISLANDS}
SELECT a AS artifact, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM islands""")
def region_union_one_artifact(spark, d):
    """All of lineitem in one artifact: it is cut into pieces, so no task takes more than a share of it."""
    s = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(F.lit("all").alias("artifact"), s.alias("start"), (s + F.col("l_quantity").cast("long") % 13).alias("end"))
    return ranges.merged_regions(rows, "artifact", most=2000)


@query(f"""WITH r AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END AS a, l_partkey * 5 AS s, l_partkey * 5 + CAST(l_quantity AS BIGINT) % 12 AS e FROM lineitem), {_ISLANDS},
b AS (SELECT a, lag(e) OVER (PARTITION BY a ORDER BY s) AS s, s AS e FROM islands)
SELECT a AS supplier, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM b WHERE s IS NOT NULL""")
def region_gaps(spark, d):
    """What a removal of regions keeps between them; one artifact holds a third of all rows."""
    s = F.col("l_partkey") * 5
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(F.col("l_suppkey")).alias("supplier"), s.alias("start"), (s + F.col("l_quantity").cast("long") % 12).alias("end"))
    return ranges.gaps(rows, "supplier", most=1000)


@query("""WITH o AS (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_partkey + l_orderkey % 50 END AS BIGINT) AS place FROM lineitem),
c AS (SELECT l_suppkey, l_partkey AS stop, CAST(sum(CAST(l_quantity AS BIGINT) % 12 - 8) AS BIGINT) AS delta FROM lineitem WHERE l_suppkey % 10 <> 7 GROUP BY l_suppkey, l_partkey)
SELECT o.*, CAST(o.place + coalesce((SELECT sum(delta) FROM c WHERE c.l_suppkey = o.l_suppkey AND c.stop <= o.place), 0) AS BIGINT) AS moved FROM o""")
def moved_offsets(spark, d):
    """Offsets after the changes before them: an as-of sum by order of position, without a pair of an offset and a change."""
    lines = table(spark, d, "lineitem")
    place = F.when(F.col("l_linenumber") != 3, F.col("l_partkey") + F.col("l_orderkey") % 50)
    offsets = lines.select("l_suppkey", "l_orderkey", "l_linenumber", place.cast("long").alias("place"))
    changes = lines.where("l_suppkey % 10 <> 7").select("l_suppkey", F.col("l_partkey").alias("stop"), (F.col("l_quantity").cast("long") % 12 - 8).alias("delta"))
    return ranges.translated(offsets, changes, "l_suppkey", "place", "stop", "delta", most=500)


@query("""WITH RECURSIVE items AS (SELECT l_suppkey AS package, l_partkey AS key, (l_partkey * 3 + l_linenumber) % 211 AS refers_to FROM lineitem),
gone AS (SELECT DISTINCT l_suppkey AS package, l_partkey AS key FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 47),
chain AS (SELECT package, key FROM gone UNION SELECT i.package, i.key FROM chain c JOIN items i ON i.package = c.package AND i.refers_to = c.key)
SELECT package, key FROM chain""")
def removed_in_chain(spark, d):
    """Items that go because what they refer to goes, in chain."""
    lines = table(spark, d, "lineitem")
    items = lines.select(F.col("l_suppkey").alias("package"), F.col("l_partkey").alias("key"), ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % 211).alias("refers_to"))
    gone = lines.where("l_returnflag = 'R' AND l_quantity > 47").select(F.col("l_suppkey").alias("package"), F.col("l_partkey").alias("key"))
    return closure.removed_in_chain(items, gone, "package", "key", "refers_to").select("package", "key")


@query("""WITH m AS (SELECT l_orderkey, concat('parts/', l_partkey) AS path FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, '/' FROM lineitem)
SELECT l_orderkey, path FROM m WHERE path = '/' OR EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = m.l_orderkey AND concat('parts/', f.l_partkey) = m.path AND f.l_returnflag <> 'R')""")
def manifest_prune(spark, d):
    """Rows of a manifest whose file is still in the package; the root stays."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("parts/"), F.col("l_partkey").cast("string")).alias("path"), "l_returnflag")
    manifest = lines.select("l_orderkey", "path").unionAll(lines.select("l_orderkey").distinct().withColumn("path", F.lit("/")))
    return closure.present(manifest, lines.where("l_returnflag <> 'R'"), "l_orderkey", "path")


@query("""SELECT page_id, CASE WHEN page_id % 10 IN (4, 6) THEN 'unverifiable' WHEN page_id % 10 = 7 THEN 'remaining' ELSE 'clean' END AS status,
  CAST(CASE WHEN page_id % 10 = 7 THEN 1 ELSE 0 END AS BIGINT) AS remaining, CASE WHEN page_id % 10 = 7 THEN 'Enlace de autoría (me)' ELSE '' END AS sample FROM pages""")
def inventory_verify(spark, d):
    """Pages of ten shapes before and after a light cleaning of the block `meta`: links remain, pages that cannot be read are unverifiable, and every page has a row."""
    pages = _made(spark, d)
    cleaned = pages.select("page_id", F.decode(H.strip_html(F.encode("page", "UTF-8"), ("meta",)), "UTF-8").alias("page"))
    of = lambda rows: I.exploded(rows, I.html_entries(F.col("page")), "page_id")
    return I.verify(of(pages), of(cleaned), "page_id", pages)


_OWN_RULES = (*labels.RULES, ("site", "w", True, "Web", "medium"), ("site", "ww", True, "Red", "high"), ("site", "f", True, "Foro", "medium"), ("site", "c", True, "Corpus", "low"))
_VALUES = ", ".join(f"('{t}', '{p}', {o}, '{l}', '{s}')" for t, p, o, l, s in _OWN_RULES)
_KINDS = "['exif', 'id3', 'ilst', 'site', 'xmp']"
_NAMES = "['" + "', '".join([p for _, p, _, _, _ in labels.RULES] + ["TIT2x", "Mak", "zzz"]) + "']"


@query(f"""WITH k AS (SELECT doc_id, {_KINDS}[CAST(doc_id % 5 AS INTEGER) + 1] AS tags, CASE WHEN doc_id % 5 = 3 THEN source ELSE {_NAMES}[CAST(doc_id % {len(labels.RULES) + 3} AS INTEGER) + 1] END AS key FROM documents),
m AS (SELECT k.*, r.label, r.sensitivity, row_number() OVER (PARTITION BY doc_id ORDER BY length(r.prefix) DESC) AS n FROM k LEFT JOIN (VALUES {_VALUES}) AS r(tags, prefix, open, label, sensitivity)
  ON r.tags = k.tags AND (r.prefix = k.key OR (r.open AND starts_with(k.key, r.prefix))))
SELECT doc_id, tags, key, coalesce(label, key) AS label, coalesce(sensitivity, CASE tags WHEN 'id3' THEN 'medium' WHEN 'ilst' THEN 'medium' ELSE 'low' END) AS sensitivity FROM m WHERE n = 1""")
def key_labels(spark, d):
    """Raw keys with the label and sensitivity of the longest rule that fits, or the default of their kind."""
    names = F.array(*[F.lit(p) for _, p, _, _, _ in labels.RULES], *map(F.lit, ("TIT2x", "Mak", "zzz")))
    kinds = F.array(*map(F.lit, ("exif", "id3", "ilst", "site", "xmp")))
    at = lambda values, n: F.element_at(values, (F.col("doc_id") % n + 1).cast("int"))
    keys = table(spark, d, "documents").select("doc_id", at(kinds, 5).alias("tags"), F.when(F.col("doc_id") % 5 == 3, F.col("source")).otherwise(at(names, len(labels.RULES) + 3)).alias("key"))
    return labels.labelled(keys, labels.rules(spark, _OWN_RULES)).select("doc_id", "tags", "key", "label", "sensitivity")
