"""Document conversions as columns: (result, error), the error a stable message.

Conversions with a Column expression stay in the JVM; those that need a parser run as
Arrow functions over batches. One bad row gives an error in its row, not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burin.functions import documents as D
from burin.functions import images as G
from burin.functions import numeric as N
from burin.functions import text as T

#: What several conversions take from a text first.
PARTS: dict[str, Callable[[Column], Column]] = {"words": T.words_of, "number": N.integer_of, "date": N.date_of}
#: Conversions as functions of such a part.
OF_PART: dict[str, tuple[str, Callable[[Column], Column]]] = {
    **{f"case-{c}": ("words", of_words) for c, of_words in T.CASES.items()},
    "number-base": ("number", N.base_lines), "dec-to-roman": ("number", N.to_roman), "timestamp-to-date": ("date", N.timestamp_lines), "date-to-timestamp": ("date", N.iso_lines),
}


def _by_part(to: str) -> Callable[[Column], Column]:
    part, use = OF_PART[to]
    return lambda x: T.let(PARTS[part](x), use)


#: Text in, text out (bytes of base64-to-txt), in the JVM; null is an error.
EXPRESSIONS: dict[str, Callable[[Column], Column]] = {
    **{c: _by_part(c) for c in OF_PART if c.startswith("case-")}, "url-encode": T.url_encode, "url-decode": T.url_decode,
    "html-escape": T.html_escape, "html-unescape": T.unescape, "xml-escape": T.xml_escape, "xml-unescape": T.unescape, "rot13": T.rot13,
    "txt-to-base64": lambda x: T.base64_encode(F.encode(x, "UTF-8")), "base64-to-txt": T.base64_decode,
    "text-stats": T.text_stats, "md-to-txt": T.md_to_txt, "number-base": _by_part("number-base"), "dec-to-roman": _by_part("dec-to-roman"), "roman-to-dec": lambda x: N.from_roman(x).cast("string"),
    "color-convert": N.color_convert, "timestamp-to-date": _by_part("timestamp-to-date"), "date-to-timestamp": _by_part("date-to-timestamp"), "md-table-to-csv": T.md_table_csv,
    "to-sha256": lambda x: F.sha2(x, 256), "sha1": lambda x: F.sha1(x), "sha384": lambda x: F.sha2(x, 384), "sha512": lambda x: F.sha2(x, 512), "uuid-v4": lambda x: F.uuid(),
}
# What a conversion says of an input that it cannot read.
_NO_NUMBER, _NO_DATE = "No pude identificar la base del número (usa decimal, 0x… o 0b…)", "No pude interpretar la fecha (usa formato ISO o epoch en ms)"
_no_roman = lambda number: F.when(number.isNull(), _NO_NUMBER).otherwise("El número debe ser un entero entre 1 y 3999")
ERRORS: dict[str, Callable[[Column], Column]] = {
    "number-base": lambda x: F.lit(_NO_NUMBER),
    "dec-to-roman": lambda x: _no_roman(N.integer_of(x)),
    "roman-to-dec": lambda x: F.when(T.js_trim(x) == "", "El romano está vacío").otherwise(F.concat(F.lit("Carácter romano no válido: "), F.substring(F.upper(F.regexp_extract(T.js_trim(x), f"^{N.ROMAN}*(.)", 1)), 1, 1))),
    "color-convert": lambda x: F.when(T.js_trim(x).startswith("#"), "No entiendo el color hex (esperaba #RRGGBB o #RGB)").otherwise("Formato de color no reconocido (usa #RRGGBB, rgb() o hsl())"),
    "url-decode": lambda x: F.lit("No es una cadena URL válida"), "base64-to-txt": lambda x: F.lit("El texto no es Base64 válido"), "md-table-to-csv": lambda x: F.lit("No se encontró una tabla Markdown"),
    "timestamp-to-date": lambda x: F.lit(_NO_DATE), "date-to-timestamp": lambda x: F.lit(_NO_DATE),
}
#: Text in, text out, by a parser.
TEXT_PARSERS: dict[str, Callable[[str], str]] = {
    "csv-to-json": D.csv_to_json, "json-to-csv": D.json_to_csv, "json-pretty": D.json_pretty, "json-minify": D.json_minify, "json-to-xml": D.json_to_xml, "csv-to-xml": D.csv_to_xml,
    "xml-to-json": D.xml_to_json, "xml-to-csv": D.xml_to_csv, "yaml-to-json": D.yaml_to_json, "json-to-yaml": D.json_to_yaml, "toml-to-json": D.toml_to_json, "json-to-toml": D.json_to_toml,
    "json-to-ts": D.json_to_ts, "md-to-html": D.md_to_html, "html-to-md": D.html_to_md, "rtf-to-txt": D.rtf_to_txt,
}
#: Bytes in, text out.
FILE_READERS: dict[str, Callable[[bytes], str]] = {"docx-to-txt": D.docx_to_txt, "odt-to-txt": D.odt_to_txt, "pptx-to-txt": D.pptx_to_txt, "epub-to-txt": D.epub_to_txt, "xlsx-to-csv": D.xlsx_to_csv, "xlsx-to-json": D.xlsx_to_json, "zip-to-manifest": D.zip_manifest, "docx-to-html": D.docx_to_html, "pdf-to-txt": D.pdf_to_txt, "pdf-to-csv": D.pdf_to_csv}
#: Text in, bytes out.
FILE_WRITERS: dict[str, Callable[[str], bytes]] = {"txt-to-pdf": D.txt_to_pdf, "csv-to-xlsx": D.csv_to_xlsx, "json-to-xlsx": D.json_to_xlsx, "txt-to-docx": D.txt_to_docx, "md-to-pdf": D.md_to_pdf, "html-to-pdf": D.html_to_pdf}
#: Bytes in, bytes out.
FILE_CONVERTERS: dict[str, Callable[[bytes], bytes]] = {"pdf-to-docx": D.pdf_to_docx, "docx-to-pdf": D.docx_to_pdf, "pptx-to-pdf": D.pptx_to_pdf, "to-png": G.png_to_png, "tiff-to-png": G.tiff_to_png, "img-to-pdf": G.image_to_pdf}
#: What no library of this environment can decode or encode; the result is an explicit error.
UNSUPPORTED = ("pdf-to-jpg", "pdf-to-png", "pdf-to-webp", "to-jpg", "to-webp", "img-to-svg", "heic-to-jpg", "heic-to-png", "tiff-to-jpg")


def _guarded(run: Callable, empty: str = "Se necesita un archivo"):
    def one(value):
        if value is None or len(value) == 0:
            return None, empty
        try:
            return run(value), None
        except ValueError as e:
            return None, str(e)
        except Exception as e:  # noqa: BLE001  a malformed file is that row's error, not the job's
            return None, f"{type(e).__name__}: {e}"

    return one


def _udf(run: Callable, kind: str):
    one = _guarded(run)

    @F.pandas_udf(f"result {kind}, error string")
    def apply(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in values], columns=["result", "error"], dtype=object)

    return apply


def result_file(name: Column, to: str, converted: Column) -> Column:
    """struct(name, kind, mime, size, result, error) of a converted file: the name without its extension, and the conversion's own."""
    from burin.operators.catalog import CONVERSIONS
    from burin.sources.detect import EXTENSIONS, mime_of

    ext = {c: e for c, _, e in CONVERSIONS}[to]
    kind = F.lit(EXTENSIONS.get(ext, "unknown"))
    size = F.octet_length(converted["result"]).cast("long")
    return F.struct(F.concat(T.base_name(name), F.lit("." + ext)).alias("name"), kind.alias("kind"), mime_of(kind).alias("mime"), size.alias("size"), converted["result"].alias("result"), converted["error"].alias("error"))


def _outcome(made: Column, empty: Column, error: Column) -> Column:
    said = lambda r: F.when(empty, F.lit("Se necesita un archivo")).when(r.isNull(), error)
    return T.let(made, lambda r: F.struct(F.when(~empty, r).alias("result"), said(r).alias("error")))


def all_converted(rows: DataFrame, value: str, ids: list[str]) -> DataFrame:
    """rows without the text `value`, once for each of the JVM conversions: conversion, result (bytes in hexadecimal) and error as of convert().

    What several of them take from a text, and each result, are columns of their own, so they are computed once a row.
    """
    kept, x = [c for c in rows.columns if c != value], F.col(value)
    parts = {p: f"__{p}" for p in PARTS if any(OF_PART.get(c, ("",))[0] == p for c in ids)}
    read = rows.select("*", (x.isNull() | (F.length(x) == 0)).alias("__empty"), *[PARTS[p](x).alias(name) for p, name in parts.items()])

    def one(to: str) -> Column:
        if to not in OF_PART:
            return _outcome(EXPRESSIONS[to](x), F.col("__empty"), ERRORS[to](x) if to in ERRORS else F.lit("Entrada no válida"))
        part, use = OF_PART[to]
        error = _no_roman(F.col("__number")) if to == "dec-to-roman" else ERRORS[to](x) if to in ERRORS else F.lit("Entrada no válida")
        return _outcome(use(F.col(parts[part])), F.col("__empty"), error)

    def shown(i: int, to: str) -> Column:
        c = F.col(f"__{i}")
        text = F.when(F.typeof(c["result"]) == "binary", F.hex(c["result"].cast("binary"))).otherwise(c["result"].cast("string"))
        return F.struct(F.lit(to).alias("conversion"), text.alias("result"), c["error"].alias("error"))

    made = read.select(*kept, *[one(to).alias(f"__{i}") for i, to in enumerate(ids)])
    return made.select(*kept, F.explode(F.array(*[shown(i, to) for i, to in enumerate(ids)])).alias("__c")).select(*kept, "__c.*")


def convert(value: Column, to: str) -> Column:
    """struct(result, error) of a conversion by its id."""
    if to in EXPRESSIONS:
        error = ERRORS[to](value) if to in ERRORS else F.lit("Entrada no válida")
        return _outcome(EXPRESSIONS[to](value), value.isNull() | (F.length(value) == 0), error)
    if to in TEXT_PARSERS:
        return _udf(TEXT_PARSERS[to], "string")(value)
    if to in FILE_READERS:
        return _udf(FILE_READERS[to], "string")(value)
    if to in FILE_WRITERS or to in FILE_CONVERTERS:
        return _udf(FILE_WRITERS.get(to) or FILE_CONVERTERS[to], "binary")(value)
    if to in UNSUPPORTED:
        return F.struct(F.lit(None).cast("binary").alias("result"), F.lit("unsupported").alias("error"))
    raise ValueError(f"Conversión no disponible: {to}")
