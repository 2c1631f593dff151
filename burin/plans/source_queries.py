"""Sources and sinks: what Spark derives from the tables is written as files and read again."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from burin.plans.registry import query, table
from burin.sources import packages
from burin.sources.csv_lines import read_rows
from burin.storage import folder


@query("SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, sha256(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL")
def csv_by_ranges(spark, d):
    """Whole documents as quoted CSV with line breaks inside cells, read by ranges of bytes."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '""'), F.lit('"'))
    path = folder(spark)
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL")
    docs.select(F.concat_ws(",", F.col("doc_id").cast("string"), quoted(F.col("lang")), quoted(F.col("source")), quoted(F.col("text"))).alias("value")).write.text(path)
    rows = read_rows(spark, path, "part-*")
    return rows.select(F.col("cells")[0].cast("long").alias("doc_id"), F.col("cells")[1].alias("lang"), F.col("cells")[2].alias("source"), F.sha2(F.col("cells")[3], 256).alias("text"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(zipfile.ZipInfo("mimetype"), "text/plain", zipfile.ZIP_STORED)
                z.writestr(zipfile.ZipInfo("doc/text.txt"), text or "")
                z.writestr(zipfile.ZipInfo("doc/label.txt"), label or "")
            out.append(held.getvalue())
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])


@query("SELECT doc_id, CAST(2 AS INTEGER) AS ord, 'doc/label.txt' AS member, CAST(strlen(coalesce(source, '')) AS BIGINT) AS size, sha256(coalesce(source, '')) AS content FROM documents UNION ALL SELECT doc_id, 1, 'doc/text.txt', CAST(strlen(coalesce(text, '')) AS BIGINT), sha256(coalesce(text, '')) FROM documents")
def package_members(spark, d):
    """Documents as packages, written as files by the sink and read by member; the filter on members reaches the reader."""
    path = folder(spark)
    made = table(spark, d, "documents").select("doc_id", "text", "source").mapInArrow(_packed, "doc_id long, bytes binary")
    packages.save_files(made.select(F.concat(F.col("doc_id").cast("string"), F.lit(".zip")).alias("name"), "bytes"), path)
    rows = packages.read_packages(spark, path).where(F.col("member").startswith("doc/"))
    key = F.regexp_extract("package", r"([0-9]+)\.zip$", 1).cast("long")
    return rows.select(key.alias("doc_id"), "ord", "member", "size", F.sha2("bytes", 256).alias("content"))
