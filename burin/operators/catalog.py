"""Which tools and conversions apply to a kind: dimension tables and their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The catalogue's categories in order, and its tools as (id, category, kinds, implemented).
CATEGORIES = ("principales", "pdf", "image", "av", "convert", "write", "meta")
_VIDEO, _IMAGE = ("mp4", "mov", "mkv", "avi", "webm"), ("jpg", "png", "webp", "gif")
_PICTURE = (*_IMAGE, "tiff", "heic")
ACTIONS = (
    ("convert.any", "principales", ("pdf", "jpg", "png", "webp", "gif", "md", "txt", "csv", "json", "xml", "docx", "xlsx"), True),
    ("meta.strip", "principales", (), True),
    ("crypto.file", "principales", (), True),
    ("pdf.split", "pdf", ("pdf",), True), ("pdf.merge", "pdf", ("pdf",), True), ("pdf.delete-pages", "pdf", ("pdf",), True), ("pdf.rearrange", "pdf", ("pdf",), True),
    ("pdf.compress", "pdf", ("pdf",), True), ("pdf.extract-text", "pdf", ("pdf",), True), ("pdf.protect", "pdf", ("pdf",), True), ("pdf.sign", "pdf", ("pdf",), True),
    ("image.resize", "image", _PICTURE, True), ("image.crop", "image", _PICTURE, True), ("image.compress", "image", _PICTURE, True), ("image.to-text", "image", _PICTURE, True),
    ("av.trim", "av", _VIDEO, False), ("av.convert", "av", _VIDEO, False), ("av.extract-audio", "av", _VIDEO, False), ("av.to-text", "av", ("mp3", "flac", "m4a", "wav", "mp4", "webm"), False), ("av.compress", "av", _VIDEO, False),
    ("convert.csv-excel", "convert", ("csv",), False), ("convert.xml-json", "convert", ("xml",), False), ("convert.split-csv", "convert", ("csv",), False), ("convert.qr", "convert", ("txt",), False), ("convert.meme", "convert", ("jpg", "png", "webp"), False),
    ("write.translate", "write", ("txt", "md"), False), ("write.summarize", "write", ("txt", "md", "pdf"), False), ("write.rewrite", "write", ("txt", "md"), False),
)
# Conversions as (id, kinds they accept, extension they give).
CONVERSIONS = (
    *((f"case-{c}", ("txt", "md"), "txt") for c in ("camel", "pascal", "snake", "kebab", "constant", "title", "sentence", "slug")),
    ("url-encode", ("txt",), "txt"), ("url-decode", ("txt",), "txt"), ("html-escape", ("txt", "html"), "txt"), ("html-unescape", ("txt", "html"), "txt"),
    ("xml-escape", ("txt", "xml"), "txt"), ("xml-unescape", ("txt", "xml"), "txt"), ("rot13", ("txt",), "txt"), ("txt-to-base64", ("txt",), "txt"), ("base64-to-txt", ("txt",), "bin"),
    ("text-stats", ("txt", "md"), "txt"), ("html-to-md", ("txt", "html"), "txt"), ("md-to-txt", ("md",), "txt"), ("md-to-html", ("md",), "html"),
    ("color-convert", ("txt",), "txt"), ("number-base", ("txt",), "txt"), ("dec-to-roman", ("txt",), "txt"), ("roman-to-dec", ("txt",), "txt"), ("timestamp-to-date", ("txt",), "txt"), ("date-to-timestamp", ("txt",), "txt"),
    ("to-sha256", ("md", "txt", "pdf", "csv", "json"), "txt"), *((f"sha{n}", ("txt", "md", "json", "csv", "pdf"), "txt") for n in (1, 384, 512)), ("uuid-v4", ("txt",), "txt"),
    ("csv-to-json", ("csv",), "json"), ("json-to-csv", ("json",), "csv"), ("json-pretty", ("json",), "json"), ("json-minify", ("json",), "json"), ("json-to-xlsx", ("json",), "xlsx"), ("csv-to-xlsx", ("csv",), "xlsx"),
    ("xlsx-to-csv", ("xlsx",), "csv"), ("xlsx-to-json", ("xlsx",), "json"), ("xml-to-json", ("xml",), "json"), ("json-to-xml", ("json",), "xml"), ("csv-to-xml", ("csv",), "xml"), ("xml-to-csv", ("xml",), "csv"),
    ("yaml-to-json", ("yaml",), "json"), ("json-to-yaml", ("json",), "yaml"), ("toml-to-json", ("toml",), "json"), ("json-to-toml", ("json",), "toml"), ("md-table-to-csv", ("md", "txt"), "csv"), ("json-to-ts", ("json",), "ts"),
    ("txt-to-pdf", ("txt",), "pdf"), ("md-to-pdf", ("md",), "pdf"), ("html-to-pdf", ("txt",), "pdf"), ("docx-to-txt", ("docx",), "txt"), ("docx-to-html", ("docx",), "html"), ("docx-to-pdf", ("docx",), "pdf"),
    ("pptx-to-txt", ("pptx",), "txt"), ("pptx-to-pdf", ("pptx",), "pdf"), ("epub-to-txt", ("epub",), "txt"), ("odt-to-txt", ("odt",), "txt"), ("rtf-to-txt", ("rtf",), "txt"),
    ("pdf-to-txt", ("pdf",), "txt"), ("pdf-to-docx", ("pdf",), "docx"), ("pdf-to-csv", ("pdf",), "csv"), ("pdf-to-jpg", ("pdf",), "jpg"), ("pdf-to-png", ("pdf",), "png"), ("pdf-to-webp", ("pdf",), "webp"),
    ("to-jpg", _IMAGE, "jpg"), ("to-png", _IMAGE, "png"), ("to-webp", _IMAGE, "webp"), ("img-to-pdf", ("jpg", "png"), "pdf"), ("img-to-svg", ("jpg", "png"), "svg"),
    ("heic-to-jpg", ("heic",), "jpg"), ("heic-to-png", ("heic",), "png"), ("tiff-to-png", ("tiff",), "png"), ("tiff-to-jpg", ("tiff",), "jpg"), ("zip-to-manifest", ("zip",), "txt"),
)


def actions(spark: SparkSession) -> DataFrame:
    rows = [(i, a, c, list(k), done) for i, (a, c, k, done) in enumerate(ACTIONS)]
    return spark.createDataFrame(rows, "ord int, action string, category string, applies_to array<string>, implemented boolean")


def conversions(spark: SparkSession) -> DataFrame:
    rows = [(i, c, list(k), e) for i, (c, k, e) in enumerate(CONVERSIONS)]
    return spark.createDataFrame(rows, "ord int, conversion string, from_kinds array<string>, ext string")


def applicable_actions(artifacts: DataFrame, kind: str = "kind") -> DataFrame:
    """Every artifact with the tools that apply to it; the catalogue has a fixed size and is broadcast.

    Tools for all kinds become a row for each kind of the catalogue, so the join is by equality.
    """
    from burin.sources.detect import KINDS

    kinds = F.array(*map(F.lit, KINDS))
    table = actions(artifacts.sparkSession).withColumn(kind, F.explode(F.when(F.size("applies_to") == 0, kinds).otherwise(F.col("applies_to")))).drop("applies_to")
    return artifacts.join(F.broadcast(table), kind)


def applicable_conversions(artifacts: DataFrame, kind: str = "kind", every: bool = False) -> DataFrame:
    """Every artifact with the conversions of its kind; with `every`, one without any keeps a row of nulls."""
    table = conversions(artifacts.sparkSession).withColumn(kind, F.explode("from_kinds")).drop("from_kinds")
    return artifacts.join(F.broadcast(table), kind, "left" if every else "inner")
