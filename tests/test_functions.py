"""Unit vectors of the conversions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from burin.functions import documents as D
from burin.functions import numeric as N
from burin.functions import text as T
from burin.operators import pages as P
from burin.operators.convert import UNSUPPORTED, convert


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("to", "given", "expected"), [
    ("sha1", "abc", "a9993e364706816aba3e25717850c26c9cd0d89d"), ("rot13", "HELLO", "URYYB"), ("rot13", "URYYB", "HELLO"), ("case-camel", "Hola mundo", "holaMundo"),
    ("case-snake", "Hola mundo", "hola_mundo"), ("case-kebab", "holaMundo", "hola-mundo"), ("case-constant", "hola mundo", "HOLA_MUNDO"), ("dec-to-roman", "1999", "MCMXCIX"), ("roman-to-dec", "mcmxcix", "1999"),
    ("roman-to-dec", "IIII", "4"), ("number-base", "255", "decimal: 255\nhex: 0xff\nbinary: 0b11111111"), ("number-base", "-5", "decimal: -5\nhex: -0x5\nbinary: -0b101"), ("number-base", "0xFF", "decimal: 255\nhex: 0xff\nbinary: 0b11111111"),
    ("color-convert", "rgb(255, 0, 0)", "HEX: #ff0000\nRGB: rgb(255, 0, 0)\nHSL: hsl(0, 100%, 50%)\ncss: #ff0000"), ("color-convert", "hsl(0, 100%, 50%)", "HEX: #ff0000\nRGB: rgb(255, 0, 0)\nHSL: hsl(0, 100%, 50%)\ncss: #ff0000"),
    ("color-convert", "#369", "HEX: #336699\nRGB: rgb(51, 102, 153)\nHSL: hsl(210, 50%, 40%)\ncss: #336699"), ("text-stats", "Hola mundo\nsegunda línea", "Caracteres: 24\nPalabras: 4\nLíneas: 2\nTiempo de lectura: <1 min"),
    ("url-encode", "a b&ñ!'()*~", "a%20b%26%C3%B1!'()*~"), ("url-decode", "a%20b+c", "a b+c"), ("base64-to-txt", "SG9s\nYQ==", b"Hola"), ("base64-to-txt", "//79/A==", b"\xff\xfe\xfd\xfc"), ("number-base", "\t255\n", "decimal: 255\nhex: 0xff\nbinary: 0b11111111"), ("dec-to-roman", "0x10", "XVI"), ("roman-to-dec", "\tXII", "12"), ("date-to-timestamp", "2024-01-02T03:04:05Z", "ISO: 2024-01-02T03:04:05.000Z\nEpoch (ms): 1704164645000"), ("timestamp-to-date", "2024-01-02", "Fecha (UTC): 2024-01-02 00:00:00\nISO: 2024-01-02T00:00:00.000Z\nEpoch (ms): 1704153600000"), ("md-table-to-csv", "|a|b|\n|-|-|\n|1|2|", "a,b\n1,2"), ("html-escape", "<a href='x'>&", "&lt;a href=&#39;x&#39;&gt;&amp;"), ("html-unescape", "&amp;lt;", "&lt;"),
    ("md-to-txt", "---\ntitle: x\n---\n# Hola\n**a** y `b`\n- c", "Hola\na y b\nc"),
])
def test_conversions(spark, to, given, expected):
    got = value(spark, convert(F.lit(given), to))
    assert (got["result"], got["error"]) == (expected, None)


@pytest.mark.parametrize(("to", "given"), [("base64-to-txt", "abc"), ("number-base", "0b2"), ("color-convert", "red"), ("dec-to-roman", "4000"), ("roman-to-dec", "ABC"), ("rot13", "")])
def test_errors_stay_in_their_row(spark, to, given):
    got = value(spark, convert(F.lit(given), to))
    assert got["result"] is None and got["error"]


def test_unsupported_conversions_say_so(spark):
    assert value(spark, convert(F.lit("x"), UNSUPPORTED[0]))["error"] == "unsupported"
    with pytest.raises(ValueError):
        convert(F.lit("x"), "no-such-thing")


def test_names_and_sizes(spark):
    rows = spark.createDataFrame([("a.b.PDF", 0), (".hidden", 1023), ("x", 1536), ("dir/../..ev‮il.txt", 5 << 20)], "n string, s long")
    got = rows.select(T.ext_of(F.col("n")), T.base_name(F.col("n")), T.format_bytes(F.col("s")), T.sanitize_name(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("pdf", "a.b", "0 B", "a.b.PDF"), ("", "documento", "1023 B", "hidden"), ("", "x", "1.5 KB", "x"), ("txt", "dir/../..ev‮il", "5 MB", "evil.txt")]


def test_page_lists(spark):
    rows = spark.createDataFrame([("1-3,5",), ("2,a,4",), ("",), (None,), ("0-2,3-1,7",), ("1-200000",)], "s string")
    assert [r[0] for r in rows.select(P.parse_page_list(F.col("s"))).collect()] == [[1, 2, 3, 5], [2, 4], [], [], [0, 1, 2, 7], []]
    orders = spark.createDataFrame([([3, 1], 4), ([2, 2, 1], 3), ([9, 0], 3), ([], 0)], "o array<int>, n int")
    assert [r[0] for r in orders.select(P.complete_order(F.col("o"), F.col("n"))).collect()] == [[3, 1, 2, 4], [2, 1, 3], [1, 2, 3], []]


def test_durations(spark):
    rows = spark.createDataFrame([(0.0,), (12.5,), (67.0,), (3723.0,)], "s double")
    assert [r[0] for r in rows.select(N.format_duration(F.col("s"))).collect()] == ["0 s", "12,5 s", "1:07", "1:02:03"]


def test_matroska_times_beyond_exact_doubles(spark):
    rows = spark.createDataFrame([(4615000 * 1000003000000,), (4619000 * 1000003000000,), (-1,), (999_999_999,), (None,)], "n long")
    assert [r[0] for r in rows.select(N.matroska_time(F.col("n"))).collect()] == ["2147-03-31 12:17:25", "2147-05-16 19:24:17", "2001-01-01 00:00:00", "2001-01-01 00:00:00", None]


def test_csv_rows():
    assert D.parse_csv("nombre,edad\nAna,30\nLuis,25") == [["nombre", "edad"], ["Ana", "30"], ["Luis", "25"]]
    assert D.parse_csv('a,"b ""c"", d"\r\n\nx') == [["a", 'b "c", d'], [""], ["x"]]
    assert D.parse_csv('ab"c,d"e') == [["abc,de"]]
    assert D.parse_csv('"""q"""') == [['"q"']]
    assert D.parse_csv("") == [] and D.parse_csv("a\n") == [["a"]]


def test_structured_text():
    assert D.json_to_csv('[{"a":1,"b":"x"},{"b":"p,q","c":null},3]') == 'a,b,c\n1,x,\n,"p,q",'
    assert D.json_minify('{"b": 1.0, "2": [true], "1": "ñ"}') == '{"1":"ñ","2":[true],"b":1}'
    assert D.json_to_xml('{"a":[1,2],"b":null}') == '<?xml version="1.0" encoding="UTF-8"?>\n<root><a>1</a><a>2</a><b/></root>'
    assert D.xml_to_json("<a><b>1</b></a>") == '{\n  "a": {\n    "b": "1"\n  }\n}'
    assert D.xml_to_csv("<r><x><k>1</k></x><x><k>2</k></x></r>") == "k\n1\n2"
    assert D.yaml_to_json("a: 1\nb: hola\nc: yes") == '{\n  "a": 1,\n  "b": "hola",\n  "c": "yes"\n}'
    assert D.toml_to_json("a = 1") == '{\n  "a": 1\n}'
    assert D.toml_to_json(D.json_to_toml('{"t":{"x":[1,2]},"s":"q"}')) == D.json_pretty('{"s":"q","t":{"x":[1,2]}}')
    assert D.json_to_ts('{"a":1,"b":["x"]}') == "interface Root {\n  a: number\n  b: string[]\n}\n\nexport default Root"
    for broken in (D.json_pretty, D.xml_to_json, D.toml_to_json):
        with pytest.raises(ValueError):
            broken("{oops")


def test_markdown_and_layout():
    page = D.md_to_html("# A & B\n- x\n- **y**\n\n```\n<c>\n```\n> q")
    assert "<title>A &amp; B</title>" in page and "<ul>\n  <li>x</li>\n  <li><strong>y</strong></li>\n</ul>" in page and "<pre><code>&lt;c&gt;</code></pre>" in page and "<p>&gt; q</p>" in page
    assert D.html_to_md("<h1>T</h1><p>a <b>b</b> <a href='u'>l</a></p><ul><li>x</li></ul>") == "# T\n\na **b** [l](u)\n\n*   x"
    assert D.wrap_text("aaa bbb\n\n" + "c" * 7, 5) == ["aaa", "bbb", "", "ccccc", "cc"]
    assert D.txt_to_pdf("hola").startswith(b"%PDF-1.4") and b"/Count 3" in D.txt_to_pdf("x\n" * 100)


def test_packages():
    assert D.xlsx_to_csv(D.csv_to_xlsx('a,b\n"x,1",7')) == 'a,b\n"x,1",7'
    assert D.docx_to_txt(D.txt_to_docx("Hola\nmundo <&>")) == "Hola\nmundo <&>"
    assert D.zip_manifest(D._zip([("a.txt", b"xy"), ("mimetype", b"m")])) == "mimetype | 1\na.txt | 2"
    assert D.rtf_to_txt("{{bs}rtf1{bs}ansi Hola{bs}par caf{bs}'e9 {bs}u8212?}".replace("{bs}", chr(92))) == "Hola\ncafé —"
    with pytest.raises(ValueError):
        D.docx_to_txt(b"no zip")


def test_pdf_pages():
    from burin.functions import pdf

    body = "\n".join(f"línea (n) {i} \\ x" for i in range(130))
    whole = D.txt_to_pdf(body)
    assert pdf.page_count(whole) == 3 and pdf.to_text(whole).replace("\n\n", "\n") == body
    turned = pdf.with_pages(whole, [3, 1, 9])
    assert pdf.page_count(turned) == 2 and pdf.to_text(turned).startswith("línea (n) 96") and pdf.page_count(pdf.without_pages(whole, [2])) == 2
    assert pdf.page_count(pdf.merged([whole, turned])) == 5 and pdf.to_text(pdf.compressed(whole)) == pdf.to_text(whole)
    assert pdf.to_text(pdf.signed(whole, "Visto ñ")).count("Visto ñ") == 3 and pdf.to_text(pdf.signed(whole, every=False)).count("Firmado") == 1
    for broken in (b"", b"no pdf", whole[:40]):
        with pytest.raises(ValueError):
            pdf.with_pages(broken, [1])
    with pytest.raises(ValueError):
        pdf.without_pages(whole, [1, 2, 3])
    assert D.docx_to_html(D.txt_to_docx("a & b")) == "<p>a &amp; b</p>" and D.md_to_pdf("# x").startswith(b"%PDF")


def test_images():
    import struct
    import zlib

    import numpy as np

    from burin.functions import images, pdf

    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4):
        pixels = rng.integers(0, 256, (7, 5, n), dtype=np.uint8)
        png = images.encode_png(pixels)
        assert (images.decode_png(png) == pixels).all()
        assert (images.decode_png(images.crop_png(png, 3, 2, 9, 3)) == pixels[2:5]).all()
        assert images.decode_png(images.resize_png(png, 10, 3)).shape == (3, 10, n) and (images.resized(pixels, 5, 7) == pixels).all()
        assert pdf.page_count(images.image_to_pdf(png)) == 1
    # Every row filter, against a row encoded by hand.
    pixels = rng.integers(0, 256, (5, 4, 3), dtype=np.uint8)
    flat, rows = pixels.reshape(5, 12).astype(int), []
    for y, method in enumerate((0, 1, 2, 3, 4)):
        up = flat[y - 1] if y else np.zeros(12, int)
        left, corner = np.concatenate([[0] * 3, flat[y][:-3]]), np.concatenate([[0] * 3, up[:-3]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = (np.zeros(12, int), left, up, (left + up) // 2, paeth)[method]
        rows.append(bytes([method]) + bytes(((flat[y] - guess) % 256).astype(np.uint8)))
    png = images.encode_png(pixels)
    at = png.index(b"IDAT")
    body = zlib.compress(b"".join(rows))
    made = png[: at - 4] + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body)) + png[png.index(b"IEND") - 4 :]
    assert (images.decode_png(made) == pixels).all()
    entries = [(256, 3, 1, 4), (257, 3, 1, 5), (259, 3, 1, 1), (273, 4, 1, 8 + 2 + 12 * 5 + 4), (277, 3, 1, 3), (279, 4, 1, 60)]
    head = b"II*\0\x08\0\0\0" + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) if e[0] != 273 else struct.pack("<HHII", 273, 4, 1, 8 + 2 + 12 * len(entries) + 4) for e in entries) + b"\0\0\0\0"
    assert (images.decode_png(images.tiff_to_png(head + pixels.tobytes())) == pixels).all()
    with pytest.raises(ValueError):
        images.decode_png(b"no png")


def test_every_catalogued_conversion_converts_or_says_unsupported(spark):
    from burin.operators.catalog import CONVERSIONS
    from burin.operators.convert import convert

    one = spark.range(1)
    for name, _, _ in CONVERSIONS:
        convert(F.lit("x"), name)
    got = one.select(convert(F.lit("x"), "to-webp").alias("c")).first()["c"]
    assert got["error"] == "unsupported"


@pytest.mark.parametrize(("to", "given", "message"), [("roman-to-dec", "XAB", "Carácter romano no válido: A"), ("color-convert", "#12", "No entiendo el color hex (esperaba #RRGGBB o #RGB)"), ("dec-to-roman", "x", "No pude identificar la base del número (usa decimal, 0x… o 0b…)"), ("base64-to-txt", "a", "El texto no es Base64 válido")])
def test_errors_are_stable(spark, to, given, message):
    from burin.operators.convert import convert

    assert spark.range(1).select(convert(F.lit(given), to).alias("c")).first()["c"]["error"] == message


def test_result_types(spark):
    from burin.sources.detect import mime_of

    got = {k: spark.range(1).select(mime_of(F.lit(k)).alias("m")).first()["m"] for k in ("zip", "mkv", "flac", "tiff", "md", "xml", "m4a")}
    assert got == {"zip": "application/zip", "mkv": "video/x-matroska", "flac": "audio/flac", "tiff": "image/tiff", "md": "text/plain", "xml": "application/xml", "m4a": "application/octet-stream"}


def test_settings_of_tools():
    from burin.operators import config

    assert config.read("meta.strip", {"blocks": ["info"], "x": 1}) == config.Strip("light", ("info",))
    assert config.read("image.resize", {"percentage": 400}).percentage == 400 and config.read("pdf.split", {}).mode == "rango"
    for tool, values in (("meta.strip", {"mode": "x"}), ("crypto.file", {"passphrase": ""}), ("pdf.sign", {"text": "a", "pages": "x"}), ("image.crop", {"width": 0, "height": 1}), ("image.compress", {"quality": 9}), ("pdf.protect", {"status": "add"}), ("convert.any", {"to": "nothing"}), ("none", {})):
        with pytest.raises(config.ConfigError):
            config.read(tool, values)


def test_a_conversion_is_added_by_decorator(spark):
    from burin.operators import config
    from burin.operators import convert as C

    @config.conversion("txt-to-shout", ("txt",), "txt")
    def shout(x):
        return F.upper(x)

    try:
        assert value(spark, convert(F.lit("a"), "txt-to-shout"))["result"] == "A" and config.conversions_of("txt")[-1] == "txt-to-shout"
        assert config.read("convert.any", {"to": "txt-to-shout"}).to == "txt-to-shout"
        with pytest.raises(config.ConfigError):
            config.conversion("rot13", ("txt",), "txt")(shout)
    finally:
        del C.EXPRESSIONS["txt-to-shout"], config._added["txt-to-shout"]


def test_split_plans(spark):
    from burin.operators.pdf_files import split_plan

    plan = lambda **k: value(spark, split_plan(F.lit(5), F.lit(k.get("mode")), F.lit(k.get("text")), F.array(*map(F.lit, k["pages"])) if "pages" in k else None, F.lit(k.get("output"))))
    assert tuple(plan(mode="rango", text="4,9,2-3,4")) == ([4, 2, 3, 4], False, "-recortado.pdf", None)
    assert tuple(plan(mode="pares")) == ([2, 4], False, "-pares.pdf", None) and plan(mode="cada")["suffix"] == "-paginas.zip"
    assert tuple(plan(pages=[3, 3, 9, 1], output="separado")) == ([3, 1], True, "-paginas.zip", None)
    assert plan(text="x")["error"] == "Indica el rango de páginas"


def test_markdown_blocks():
    body = D.md_body_to_html("# T\n- a\n* b\n\n- c\ntext\n```py\nx\n# y\n```\n####### z\n```\nopen")
    assert body == "<h1>T</h1>\n<ul>\n  <li>a</li>\n  <li>b</li>\n</ul>\n<ul>\n  <li>c</li>\n</ul>\n<p>text</p>\n<pre><code>x\n# y</code></pre>\n<p>####### z</p>\n<pre><code>open</code></pre>"


def test_workbooks_keep_types():
    made = D.json_to_xlsx('[{"a": "12", "b": 12, "c": true, "d": null, "e": 1.5}, {"a": "", "f": "x & y"}]')
    assert json.loads(D.xlsx_to_json(made)) == [{"a": "12", "b": 12, "c": True, "e": 1.5}, {"a": "", "f": "x & y"}]
    assert D.xlsx_to_csv(made) == "a,b,c,d,e,f\n12,12,TRUE,,1.5\n,,,,,x & y"
    book = D.csv_to_xlsx("n,n,,z\n1,2.50,TRUE,007\n,,,\nx,-3,,1e3\n1234567890123456789,.5,2024,")
    assert json.loads(D.xlsx_to_json(book)) == [{"n": 1, "n_1": 2.5, "__EMPTY": True, "z": 7}, {"n": "x", "n_1": -3, "z": 1000}, {"n": "1234567890123456789", "n_1": 0.5, "__EMPTY": 2024}]
    wide = [[str(i) for i in range(60)], [i if i % 7 == 0 else None for i in range(60)]]
    assert json.loads(D.xlsx_to_json(D.rows_to_xlsx(wide))) == [{str(i): i for i in range(0, 60, 7)}]
    assert D.xlsx_to_json(D.rows_to_xlsx([])) == "[]"


def test_dates_as_spoken(spark):
    import datetime as dt

    at = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1000)
    want = {
        "Jan 2 2024": at(2024, 1, 2), "January 2, 2024": at(2024, 1, 2), "2 Jan 2024": at(2024, 1, 2), "02-Dec-1999": at(1999, 12, 2), "Tue, 02 Jan 2024 10:20:30 GMT": at(2024, 1, 2, 10, 20, 30),
        "Tue Jan 02 2024 10:20:30 GMT+0100 (CET)": at(2024, 1, 2, 9, 20, 30), "1/2/2024": at(2024, 1, 2), "12/31/2024 11:59 PM": at(2024, 12, 31, 23, 59), "12/31/2024 12:01 am": at(2024, 12, 31, 0, 1),
        "2024/01/02 03:04:05.5": at(2024, 1, 2, 3, 4, 5) + 500, "feb 31 2024": at(2024, 3, 2), "2 Jan 2024 10:00 -05:30": at(2024, 1, 2, 15, 30), "2024-01-02": at(2024, 1, 2), "17": 17,
        "13/1/2024": None, "Jan 32 2024": None, "Jan 2024": None, "1/2/2024 25:00": None, "1/2/2024 13:00 pm": None, "Foo 2 2024": None, "": None, "1/2/2024 10:61": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r["t"]: r["ms"] for r in rows.select("t", N.date_of(F.col("t")).alias("ms")).collect()} == want
