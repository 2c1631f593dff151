"""Inventory of new pages as they arrive: a stateless stream from files to entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burin.functions.text import decode_utf8
from burin.operators.inventory import exploded, html_entries
from burin.sources.artifacts import stream_files


def html_inventory_stream(spark: SparkSession, path: str) -> DataFrame:
    """Entries of every new HTML file under a path; append with any sink."""
    pages = stream_files(spark, path, "*.html").where(F.col("kind").isin("html", "xml", "unknown"))
    return exploded(pages.withColumn("page", decode_utf8(F.col("bytes"))), html_entries(F.col("page")), "id", "name")


def inventory_to_table(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Start the stream into a Parquet table; returns the query."""
    return html_inventory_stream(spark, source).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
