"""Type detection by extension, MIME type and leading bytes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burin.functions.text import ext_of

# Kinds, and the extensions and MIME types that name them.
KINDS = (
    "pdf", "docx", "xlsx", "pptx", "md", "txt", "csv", "xml", "json", "jpg", "png", "webp", "gif", "svg", "tiff", "heic", "mp3",
    "flac", "m4a", "wav", "mp4", "mov", "mkv", "avi", "webm", "epub", "zip", "html", "odt", "rtf", "yaml", "toml", "adei", "unknown",
)
EXTENSIONS = {k: k for k in KINDS if k != "unknown"} | {"jpeg": "jpg", "tif": "tiff", "heif": "heic", "htm": "html", "yml": "yaml"}
MIME_TYPES = {
    "application/pdf": "pdf", "image/jpeg": "jpg", "image/png": "png", "image/webp": "webp", "image/gif": "gif", "image/svg+xml": "svg",
    "video/mp4": "mp4", "video/webm": "webm", "audio/mpeg": "mp3", "audio/wav": "wav", "text/csv": "csv", "text/markdown": "md",
    "text/plain": "txt", "application/json": "json", "application/xml": "xml", "text/xml": "xml",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
}
#: How many leading bytes are looked at.
HEAD_BYTES = 4100


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[key]


def kind_by_name(name: Column, mime: Column | None = None) -> Column:
    found = _looked_up(ext_of(name), EXTENSIONS)
    if mime is not None:
        found = F.coalesce(found, _looked_up(F.lower(mime), MIME_TYPES))
    return F.coalesce(found, F.lit("unknown"))


def kind_by_magic(content: Column) -> Column:
    """Kind by signatures in the first bytes; ZIP packages by the names of their first entries."""
    head = F.substring(content, 1, HEAD_BYTES)
    starts = lambda sig, at=0: F.substring(head, at + 1, len(sig)) == F.lit(sig)
    brand = F.substring(head, 9, 4)
    holds = lambda text: F.contains(F.hex(head), F.lit(text.encode().hex().upper()))
    zip_kind = (
        F.when(holds("mimetypeapplication/epub+zip"), "epub").when(holds("mimetypeapplication/vnd.oasis.opendocument.text"), "odt")
        .when(holds("word/"), "docx").when(holds("xl/"), "xlsx").when(holds("ppt/"), "pptx").otherwise("zip")
    )
    return (
        F.when(starts(b"ADEI"), "adei").when(starts(b"%PDF"), "pdf").when(starts(b"\xff\xd8\xff"), "jpg").when(starts(b"\x89PNG\r\n\x1a\n"), "png")
        .when(starts(b"GIF8"), "gif").when(starts(b"RIFF") & starts(b"WEBP", 8), "webp").when(starts(b"RIFF") & starts(b"WAVE", 8), "wav").when(starts(b"RIFF") & starts(b"AVI ", 8), "avi")
        .when(starts(b"II*\0") | starts(b"MM\0*"), "tiff").when(starts(b"fLaC"), "flac").when(starts(b"ID3") | starts(b"\xff\xfb") | starts(b"\xff\xf3") | starts(b"\xff\xf2"), "mp3")
        .when(starts(b"ftyp", 4) & brand.isin(F.lit(b"heic"), F.lit(b"heix"), F.lit(b"mif1")), "heic").when(starts(b"ftyp", 4) & brand.isin(F.lit(b"M4A "), F.lit(b"M4B ")), "m4a")
        .when(starts(b"ftyp", 4) & (brand == F.lit(b"qt  ")), "mov").when(starts(b"ftyp", 4), "mp4")
        .when(starts(b"\x1aE\xdf\xa3") & holds("webm"), "webm").when(starts(b"\x1aE\xdf\xa3"), "mkv").when(starts(b"{\\rtf"), "rtf")
        .when(starts(b"PK\x03\x04") | starts(b"PK\x05\x06"), zip_kind).when(starts(b"<?xml"), "xml").otherwise("unknown")
    )


def kind_of(content: Column, name: Column, mime: Column | None = None) -> Column:
    """Leading bytes first, then name and MIME type."""
    magic = kind_by_magic(content)
    return F.when(magic != "unknown", magic).otherwise(kind_by_name(name, mime))


# The MIME type of a result by its kind; all others are plain bytes.
RESULT_TYPES = {k: t for t, k in MIME_TYPES.items() if t not in ("text/xml", "text/markdown")} | {
    "zip": "application/zip", "tiff": "image/tiff", "flac": "audio/flac", "mkv": "video/x-matroska", "md": "text/plain",
}


def mime_of(kind: Column) -> Column:
    return F.coalesce(_looked_up(kind, RESULT_TYPES), F.lit("application/octet-stream"))
