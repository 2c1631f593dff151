"""Files as rows: id, name, kind, size, bytes; batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burin.sources.detect import kind_by_magic, kind_by_name


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    magic = kind_by_magic(F.col("content"))
    kind: Column = F.when(magic != "unknown", magic).otherwise(kind_by_name(name))
    return files.select(F.col("path").alias("id"), name.alias("name"), kind.alias("kind"), F.col("length").alias("size"), F.col("content").alias("bytes"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a path; the bytes are read only if a column needs them."""
    return _named(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def stream_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """New files under a path as a stream of the same rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _named(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path))


def from_text(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """Rows of a text column as artifacts of one kind."""
    return df.select(F.col(key).cast("string").alias("id"), F.concat(F.col(key).cast("string"), F.lit(f".{kind}")).alias("name"), F.lit(kind).alias("kind"), F.octet_length(text).cast("long").alias("size"), F.encode(text, "UTF-8").alias("bytes"))
