"""Scan and strip of whole files as columns: Arrow functions over burin.functions.media."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burin.functions import cleaning, documents, media

ENTRY = "array<struct<ord:int,where:string,key:string,value:string,sensitivity:string,removal:string>>"


def scan(content: Column, kind: Column) -> Column:
    """Inventory of a file: an array of entries, empty if its kind has none or it cannot be read."""

    @F.pandas_udf(ENTRY)
    def apply(data: pd.Series, kinds: pd.Series) -> pd.Series:
        names = ("ord", "where", "key", "value", "sensitivity", "removal")
        return pd.Series([[dict(zip(names, (i + 1, *e), strict=True)) for i, e in enumerate(media.scan(b, k))] for b, k in zip(data, kinds, strict=True)])

    return apply(content, kind)


def strip(content: Column, kind: Column) -> Column:
    """The file without removable metadata; kinds without a stripper pass through."""

    @F.pandas_udf("binary")
    def apply(data: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([media.strip(b, k) for b, k in zip(data, kinds, strict=True)])

    return apply(content, kind)


def cleaned(content: Column, kind: Column, mode: str = "deep", blocks: tuple[str, ...] = ()) -> Column:
    """struct(result, error, status, remaining, sample): a file cleaned in a mode, and verified in the same pass.

    Light mode removes the named blocks; the verification compares the inventories before and
    after, and says `unverifiable` where both are empty. A kind that cannot be cleaned is an error.
    """

    def one(data: bytes | None, k: str) -> tuple:
        try:
            out = cleaning.clean(data, k, mode, blocks)
        except ValueError as e:
            return None, str(e), None, None, None
        return out, None, *cleaning.verdict(cleaning.entries(data, k), cleaning.entries(out, k))

    @F.pandas_udf("result binary, error string, status string, remaining long, sample array<string>")
    def apply(data: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b, k) for b, k in zip(data, kinds, strict=True)], columns=["result", "error", "status", "remaining", "sample"], dtype=object)

    return apply(content, kind)


def risks(content: Column, kind: Column) -> Column:
    """What a cleaning would lose besides metadata: an array of (id, label, detail, severity, affects)."""
    names = ("id", "label", "detail", "severity", "affects")

    @F.pandas_udf("array<struct<id:string,label:string,detail:string,severity:string,affects:string>>")
    def apply(data: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, r, strict=True)) for r in cleaning.risks(b or b"", k)] for b, k in zip(data, kinds, strict=True)])

    return apply(content, kind)


def risks_for(found: Column, mode: str) -> Column:
    """Those that a mode brings."""
    return F.filter(found, lambda r: r["affects"] == mode)


def blocks(spark: SparkSession) -> DataFrame:
    """kind, block, label: what can be removed, a table of fixed size."""
    rows = [(k, i, b, label) for k, own in cleaning.BLOCKS.items() for i, (b, label) in enumerate(own)]
    return spark.createDataFrame(rows, "kind string, ord int, block string, label string")


def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def sample_file(kind: str, author: str) -> bytes:
    """A small file of a kind that names an author in its metadata."""
    raw = author.encode()
    if kind == "png":
        ihdr = struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", ihdr) + _png_chunk(b"tEXt", b"Author\0" + raw) + _png_chunk(b"IDAT", zlib.compress(b"\0\0")) + _png_chunk(b"IEND", b"")
    if kind == "jpg":
        text = raw.ljust(4) + b"\0"
        tiff = b"II*\0\x08\0\0\0\x02\0" + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<HHII", 0x013B, 2, len(text), 38) + b"\0\0\0\0" + text
        segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
        return b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tiff) + segment(0xFE, b"by " + raw) + segment(0xC0, b"\x08\0\x01\0\x01\x01\x01\x11\0") + b"\xff\xda\0\x02\x00\xff\xd9"
    if kind == "gif":
        return b"GIF89a\x01\0\x01\0\0\0\0\x21\xfe" + bytes([len(raw)]) + raw + b"\0\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\0\x3b"
    if kind == "mp3":
        body = b"\0" + raw
        frame = b"TPE1" + struct.pack(">I", len(body)) + b"\0\0" + body
        return b"ID3\x03\0\0" + bytes([0, 0, len(frame) >> 7, len(frame) & 127]) + frame + b"\xff\xfb\x90\0" + bytes(100) + b"TAG" + raw[:30].ljust(30, b"\0") + bytes(95)
    if kind == "flac":
        comment = struct.pack("<I", 1) + b"x" + struct.pack("<I", 1) + struct.pack("<I", 7 + len(raw)) + b"ARTIST=" + raw
        return b"fLaC" + b"\0\0\0\x22" + bytes(34) + bytes([0x84]) + len(comment).to_bytes(3, "big") + comment + b"\xff\xf8frames"
    if kind == "wav":
        info = b"INFO" + b"IART" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2)
        body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"LIST" + struct.pack("<I", len(info)) + info + b"data" + struct.pack("<I", 2) + b"\0\0"
        return b"RIFF" + struct.pack("<I", len(body)) + body
    if kind == "svg":
        return f'<svg xmlns="http://www.w3.org/2000/svg"><metadata>{author}</metadata><!-- {author} --><rect data-name="{author}" width="1"/></svg>'.encode()
    if kind == "rtf":
        return b"{\\rtf1\\ansi{\\info{\\author " + raw + b"}}{\\*\\generator Editor;}text}"
    if kind == "docx":
        core = f"<cp:coreProperties><dc:creator>{author}</dc:creator></cp:coreProperties>"
        return documents._zip([("docProps/core.xml", core.encode()), ("word/document.xml", b"<w:document/>")])
    if kind == "tiff":
        text = raw.ljust(4) + b"\0"
        entries = struct.pack("<HHII", 0x0100, 3, 1, 1) + struct.pack("<HHII", 0x013B, 2, len(text), 38)
        return b"II*\0\x08\0\0\0\x02\0" + entries + b"\0\0\0\0" + text
    if kind == "mkv":
        element = lambda number, body: bytes.fromhex(number) + bytes([0x40 | len(body) >> 8, len(body) & 255]) + body
        tag = element("67C8", element("45A3", b"ARTIST") + element("4487", raw))
        segment = element("1549A966", element("7BA9", raw)) + element("1254C367", element("7373", tag))
        return element("1A45DFA3", element("4282", b"matroska")) + element("18538067", segment)
    if kind == "epub":
        opf = f'<package><metadata><dc:identifier id="i">1</dc:identifier><dc:title>T</dc:title><dc:creator id="c">{author}</dc:creator><meta refines="#c" property="role">aut</meta><dc:date>2024</dc:date></metadata></package>'
        return documents._zip([("mimetype", b"application/epub+zip"), ("OEBPS/content.opf", opf.encode()), ("META-INF/calibre_bookmarks.txt", raw)])
    if kind == "pdf":
        return documents.txt_to_pdf("text").replace(b"/Root 1 0 R", b"/Root 1 0 R /Info << /Author <" + raw.hex().encode() + b"> >>")
    raise ValueError(kind)


SAMPLE_KINDS = ("png", "jpg", "gif", "mp3", "flac", "wav", "svg", "rtf", "docx", "tiff", "mkv", "epub", "pdf")


def sample_files(rows: DataFrame, key: str = "doc_id", author: str = "source") -> DataFrame:
    """One file a row, of a kind by its id, that names the row's author."""

    @F.pandas_udf("binary")
    def made(kinds: pd.Series, authors: pd.Series) -> pd.Series:
        return pd.Series([sample_file(k, a or "") for k, a in zip(kinds, authors, strict=True)])

    kinds = F.array(*map(F.lit, SAMPLE_KINDS))
    named = rows.select(key, F.element_at(kinds, (F.col(key) % len(SAMPLE_KINDS) + 1).cast("int")).alias("kind"), F.col(author).alias("author"))
    return named.select(key, "kind", made("kind", "author").alias("bytes"))
