"""Scan, strip, verify: what goes, what stays, and files that cannot be read."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from burin.functions import cleaning, media
from burin.operators import inventory as I
from burin.operators.metadata import SAMPLE_KINDS, sample_file, scan, strip
from burin.sources.artifacts import read_files
from burin.sources.detect import kind_by_magic
from burin.streaming.inventory import inventory_to_table


@pytest.mark.parametrize("kind", SAMPLE_KINDS)
def test_author_is_found_and_removed(kind):
    data = sample_file(kind, "Ana Lopez")
    assert any("Ana Lopez" in e[2] for e in media.scan(data, kind))
    clean = media.strip(data, kind)
    assert b"Ana Lopez" not in clean and not [e for e in media.scan(clean, kind) if e[4] != "never"]
    assert media.strip(clean, kind) == clean


@pytest.mark.parametrize("kind", sorted(media.SCANNERS))
@settings(max_examples=30, deadline=None)
@given(junk=st.binary(max_size=200), cut=st.integers(0, 400))
def test_broken_files_never_raise(kind, junk, cut):
    whole = sample_file(kind, "Ana") if kind in SAMPLE_KINDS else junk
    for data in (junk, whole[:cut], whole[: cut // 2] + junk, b"", None):
        media.scan(data, kind)
        media.strip(data, kind)


def test_orientation_survives():
    clean = media.strip(sample_file("jpg", "Ana Lopez"), "jpg")
    assert ("EXIF IFD0", "Orientation", "6", "low", "never") in media.scan(clean, "jpg")


def test_html_regions():
    page = b'<meta name=author content=x><script>"<meta name=a>"</script><!--<meta name=b>--><meta charset=utf-8><link rel="me" href=y>'
    assert media.strip_html(page) == b'<script>"<meta name=a>"</script><!--<meta name=b>--><meta charset=utf-8>'
    assert media.strip_html(page, ("links",)) == page.replace(b'<link rel="me" href=y>', b"")
    assert media.cut(b"0123456789", [(2, 5), (4, 7), (0, 1)]) == b"1789"


def test_columns_and_detection(spark):
    rows = spark.createDataFrame([(k, bytearray(sample_file(k, "Ana Lopez"))) for k in SAMPLE_KINDS] + [("png", None), ("txt", bytearray(b"x"))], "kind string, bytes binary")
    got = rows.select("kind", F.size(scan(F.col("bytes"), F.col("kind"))).alias("n"), strip(F.col("bytes"), F.col("kind")).alias("s"), kind_by_magic(F.col("bytes")).alias("m")).collect()
    assert all(r["n"] >= 1 for r in got[: len(SAMPLE_KINDS)]) and got[-1]["n"] == got[-2]["n"] == 0 and bytes(got[-1]["s"]) == b"x"
    assert {r["kind"] for r in got if r["m"] == r["kind"]} >= {"png", "jpg", "gif", "mp3", "flac", "wav", "rtf", "docx"}


def test_inventory_of_empty_and_null_pages(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>")], "id int, page string")
    assert {r["id"]: r["n"] for r in rows.select("id", F.size(I.html_entries(F.col("page"))).alias("n")).collect()} == {1: 0, 2: 0, 3: 1}


def test_files_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.html").write_text('<meta name="author" content="Ana">')
    (source / "b.png").write_bytes(sample_file("png", "Ana"))
    assert {(r["name"], r["kind"]) for r in read_files(spark, str(source)).select("name", "kind").collect()} == {("a.html", "html"), ("b.png", "png")}
    stream = inventory_to_table(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ck"))
    stream.awaitTermination(120)
    assert {(r["name"], r["key"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a.html", "author"), ("a.html", "viewport")}


def test_other_app1_segments_stay():
    segment = lambda body: b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body
    other, xmp = segment(b"maker data"), segment(b"http://ns.adobe.com/xap/1.0/\0<x/>")
    data = b"\xff\xd8" + other + xmp + b"\xff\xda\0\x02\0\xff\xd9"
    assert cleaning.clean(data, "jpg", "light", ("xmp",)) == data.replace(xmp, b"")


@pytest.mark.parametrize("kind", [*SAMPLE_KINDS, "md", "html"])
def test_light_mode_without_blocks_changes_no_byte(kind):
    data = sample_file(kind, "Ana Lopez") if kind in SAMPLE_KINDS else b"---\na: b\n---\nx"
    assert cleaning.clean(data, kind, "light") == data


@pytest.mark.parametrize(("kind", "block", "gone"), [("png", "text", b"tEXt"), ("jpg", "text", b"by Ana"), ("gif", "text", b"Ana"), ("mp3", "id3v2", b"TPE1"), ("mp3", "id3v1", b"TAGAna"), ("flac", "vorbis", b"ARTIST"), ("wav", "info", b"IART"), ("rtf", "generator", b"Editor"), ("svg", "comments", b"<!--"), ("svg", "editor", b"data-name"), ("docx", "props", b"docProps/core.xml"), ("epub", "sidecars", b"")])
def test_light_mode_removes_the_named_block_alone(kind, block, gone):
    data = sample_file(kind, "Ana Lopez")
    if kind == "epub":
        with pytest.raises(ValueError, match="entero"):
            cleaning.clean(data, kind, "light", (block,))
        return
    out = cleaning.clean(data, kind, "light", (block,))
    assert gone in data and gone not in out and len(out) < len(data)
    others = [b for b, _ in cleaning.BLOCKS[kind] if b != block]
    assert kind in ("docx",) or all(cleaning.clean(out, kind, "light", (b,)) != out for b in others if cleaning.clean(data, kind, "light", (b,)) != data)


def test_orientation_survives_light_mode_and_is_a_risk_of_deep():
    data = sample_file("jpg", "Ana Lopez")
    out = cleaning.clean(data, "jpg", "light", ("exif",))
    assert ("EXIF IFD0", "Orientation", "6", "low", "never") in media.scan(out, "jpg") and b"by Ana" in out
    assert [r[0] for r in cleaning.risks(data, "jpg")] == ["image-reencode"]


def test_macros_are_a_risk_and_go_in_deep_mode_alone():
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name in ("docProps/core.xml", "docProps/custom.xml", "word/comments.xml", "word/document.xml", "word/vbaProject.bin"):
            z.writestr(name, "<a/>")
    data = held.getvalue()
    names = lambda x: zipfile.ZipFile(io.BytesIO(x)).namelist()
    assert [r[0] for r in cleaning.risks(data, "docx")] == ["office-macros"]
    assert names(cleaning.clean(data, "docx", "light", ("props",))) == ["docProps/custom.xml", "word/comments.xml", "word/document.xml", "word/vbaProject.bin"]
    assert names(cleaning.clean(data, "docx")) == ["word/document.xml"]


def test_verdicts():
    e = ("w", "k", "v", "low", "individual")
    assert cleaning.verdict([], []) == ("unverifiable", 0, [])
    assert cleaning.verdict([e], []) == ("clean", 0, []) and cleaning.verdict([e], [e]) == ("remaining", 1, ["k"])
    assert cleaning.verdict([("w", "k", "", "low", "individual")], [("w", "k", "", "low", "individual")])[0] == "clean"
    with pytest.raises(ValueError, match="próxima"):
        cleaning.clean(b"x", "adei")


@pytest.mark.parametrize("kind", sorted({*cleaning.BLOCKS, *media.STRIPPERS}))
@settings(max_examples=20, deadline=None)
@given(junk=st.binary(min_size=1, max_size=200), cut=st.integers(1, 400))
def test_broken_files_are_cleaned_or_stay(kind, junk, cut):
    whole = sample_file(kind, "Ana") if kind in SAMPLE_KINDS else junk
    for data in (junk, whole[:cut]):
        for blocks in ((), tuple(b for b, _ in cleaning.BLOCKS.get(kind, ()))):
            cleaning.clean(data, kind, "light", blocks)
        cleaning.clean(data, kind)
        cleaning.risks(data, kind)
