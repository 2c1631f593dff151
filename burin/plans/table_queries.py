"""Tabular conversions over nation, region, customer, events and documents; the tool catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from burin.functions import text as T
from burin.operators import catalog
from burin.operators.convert import convert
from burin.plans.registry import query, table
from burin.plans.text_queries import replaced
from burin.sources.detect import EXTENSIONS, KINDS


def _cell(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '[",\\r\\n]') THEN concat('"', replace({x}, '"', '""'), '"') ELSE {x} END"""


@query(f"SELECT doc_id, md5({_cell('text')}) AS cell, {_cell('source')} AS source FROM documents")
def csv_cell_render(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.csv_cell(F.col("text"))).alias("cell"), T.csv_cell(F.col("source")).alias("source"))


@query(f"SELECT n_nationkey, concat('<row><n_nationkey>', n_nationkey, '</n_nationkey><n_name>', {replaced('n_name', T.XML_ESCAPES)}, '</n_name></row>') AS row_xml FROM nation")
def csv_to_xml_rows(spark, d):
    name = T.xml_escape(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("<row><n_nationkey>"), F.col("n_nationkey").cast("string"), F.lit("</n_nationkey><n_name>"), name, F.lit("</n_name></row>")).alias("row_xml"))


_NATIONS = "SELECT r_name, string_agg(concat(n_nationkey, ',', n_name), chr(10) ORDER BY n_nationkey) AS body FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


@query("SELECT r_name, concat('[', chr(10), string_agg(concat('  {', chr(10), '    \"n_nationkey\": \"', n_nationkey, '\",', chr(10), '    \"n_name\": \"', n_name, '\"', chr(10), '  }'), concat(',', chr(10)) ORDER BY n_nationkey), chr(10), ']') AS result, NULL::VARCHAR AS error FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def csv_to_json(spark, d):
    return _region_csv(spark, d).select("r_name", convert(F.col("csv"), "csv-to-json").alias("c")).select("r_name", "c.*")


@query("SELECT r_name, concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?>', chr(10), '<root>', string_agg(concat('<row><n_nationkey>', n_nationkey, '</n_nationkey><n_name>', n_name, '</n_name></row>'), chr(10) ORDER BY n_nationkey), '</root>') AS result, NULL::VARCHAR AS error FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def csv_to_xml(spark, d):
    return _region_csv(spark, d).select("r_name", convert(F.col("csv"), "csv-to-xml").alias("c")).select("r_name", "c.*")


@query(f"SELECT r_name, concat('n_nationkey,n_name', chr(10), body) AS result, NULL::VARCHAR AS error FROM ({_NATIONS})")
def json_to_csv(spark, d):
    made = _region_csv(spark, d).select("r_name", convert(F.col("csv"), "csv-to-json")["result"].alias("json"))
    return made.select("r_name", convert(F.col("json"), "json-to-csv").alias("c")).select("r_name", "c.*")


def _region_csv(spark, d):
    """One CSV text for each region, built from its nations."""
    rows = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.concat(r["n_nationkey"].cast("string"), F.lit(","), r["n_name"]))
    return rows.groupBy("r_name").agg(F.concat(F.lit("n_nationkey,n_name\n"), F.array_join(lines, "\n")).alias("csv"))


@query("SELECT event_type, key, CAST(count(*) AS BIGINT) AS n, CAST(min(event_id) AS BIGINT) AS first_event FROM (SELECT event_id, event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY event_type, key")
def json_props_union_keys(spark, d):
    """The union of JSON keys, with the first row in which each appears."""
    keys = table(spark, d, "events").select("event_id", "event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT event_id, props AS result, NULL::VARCHAR AS error FROM (SELECT event_id, regexp_replace(props, '\\s', '', 'g') AS props FROM events)")
def json_minify(spark, d):
    pretty = table(spark, d, "events").select("event_id", convert(F.col("props"), "json-pretty")["result"].alias("p"))
    return pretty.select("event_id", convert(F.col("p"), "json-minify").alias("c")).select("event_id", "c.*")


_TABLE = "concat('intro', chr(10), '| id | name |', chr(10), '|---|:--|', chr(10), '| ', c_custkey, ' | ', c_name, ' |', chr(10), '|', c_mktsegment, '|\"q\", x|')"


@query("SELECT c_custkey, concat('id,name', chr(10), c_custkey, ',', c_name, chr(10), c_mktsegment, ',', '\"\"\"q\"\", x\"') AS csv FROM customer")
def md_table_parse(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.expr(_TABLE.replace("chr(10)", "'\\n'")).alias("md"))
    return rows.select("c_custkey", T.md_table_csv(F.col("md")).alias("csv"))


def _actions_sql() -> str:
    rows = [(i, a, c, k) for i, (a, c, kinds, _) in enumerate(catalog.ACTIONS) for k in (kinds or KINDS)]
    return ", ".join(f"({i}, '{a}', '{c}', '{k}')" for i, a, c, k in rows)


def _kinds_sql() -> str:
    pairs = ", ".join(f"('{e}', '{k}')" for e, k in EXTENSIONS.items())
    return f"files AS (SELECT page_id, coalesce(e.kind, 'unknown') AS kind FROM (SELECT page_id, {_KEYS}[CAST(page_id % {len(EXTENSIONS) + 1} AS INTEGER) + 1] AS ext FROM pages) LEFT JOIN (VALUES {pairs}) AS e(ext, kind) USING (ext))"


_KEYS = "['" + "', '".join([*EXTENSIONS, "exe"]) + "']"


def _files(spark, d):
    from burin.sources.detect import kind_by_name

    keys = F.array(*map(F.lit, [*EXTENSIONS, "exe"]))
    name = F.concat(F.lit("f."), F.element_at(keys, (F.col("page_id") % (len(EXTENSIONS) + 1) + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", kind_by_name(name).alias("kind"))


@query(f"WITH {_kinds_sql()} SELECT page_id, kind, action, category FROM files JOIN (VALUES {_actions_sql()}) AS a(ord, action, category, kind) USING (kind)")
def actions_for_kind(spark, d):
    return catalog.applicable_actions(_files(spark, d)).select("page_id", "kind", "action", "category")


@query(f"WITH {_kinds_sql()} SELECT category, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT page_id) AS BIGINT) AS n_files FROM files JOIN (VALUES {_actions_sql()}) AS a(ord, action, category, kind) USING (kind) GROUP BY category")
def actions_by_category(spark, d):
    return catalog.applicable_actions(_files(spark, d)).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_files"))


_CONVERSIONS = ", ".join(f"('{c}', '{k}', '{e}')" for c, kinds, e in catalog.CONVERSIONS for k in kinds)


@query(f"WITH {_kinds_sql()} SELECT kind, CAST(count(DISTINCT page_id) AS BIGINT) AS n_files, CAST(count(DISTINCT conversion) AS BIGINT) AS n_conversions, coalesce(string_agg(DISTINCT ext, ',' ORDER BY ext), '') AS exts FROM files LEFT JOIN (VALUES {_CONVERSIONS}) AS c(conversion, kind, ext) USING (kind) GROUP BY kind")
def conversions_matrix(spark, d):
    """Kinds of files with their conversions; a kind without any has a row too."""
    rows = catalog.applicable_conversions(_files(spark, d), every=True)
    return rows.groupBy("kind").agg(F.countDistinct("page_id").alias("n_files"), F.countDistinct("conversion").alias("n_conversions"), F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("exts"))
