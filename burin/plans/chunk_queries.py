"""Files of chunks made from whole documents, read and cleaned in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burin.functions.text import let
from burin.operators import chunks as C
from burin.plans.registry import query, table


def _bytes(x: str) -> Column:
    return F.encode(F.coalesce(F.col(x), F.lit("")), "UTF-8")


def _wav() -> Column:
    """A WAV whose sound is the text of a document; its source, language and number stand in the metadata."""
    info = F.concat(F.lit(b"INFO"), C.riff_chunk("IART", _bytes("source")), C.riff_chunk("ICMT", _bytes("lang")))
    fmt = F.lit(bytes.fromhex("010001004006000040060000" + "01000800"))
    body = F.concat(F.lit(b"WAVE"), C.riff_chunk("fmt ", fmt), C.riff_chunk("LIST", info), C.riff_chunk("bext", F.encode(F.col("doc_id").cast("string"), "UTF-8")), C.riff_chunk("JUNK", F.lit(b"123")), C.riff_chunk("data", _bytes("text")))
    return C.riff_chunk("RIFF", body)


def _png() -> Column:
    """A PNG with the text of a document as a comment and as its picture."""
    text = _bytes("text")
    parts = (("IHDR", F.lit(bytes(13))), ("tEXt", F.concat(F.lit(b"Text\0"), text)), ("gAMA", F.lit(b"\0\0\xb1\x8f")), ("eXIf", _bytes("source")), ("IDAT", text), ("IEND", F.lit(b"")))
    return F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), *[C.png_chunk(k, b) for k, b in parts])


def _kinds(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda k: k["kind"]), ",")


def _only(content: Column, found: Column, kind: str) -> Column:
    return F.sha2(C.payload(content, F.get(F.filter(found, lambda k: k["kind"] == kind), F.lit(0))), 256)


@query("""WITH d AS (SELECT doc_id, coalesce(source, '') AS s, coalesce(lang, '') AS l, CAST(doc_id AS VARCHAR) AS i, strlen(coalesce(text, '')) AS n FROM documents),
e AS (
  SELECT doc_id, 1 AS ord, 'LIST > INFO > IART' AS place, s AS value, NULL AS hex, strlen(s) AS size, 'with-container' AS removal FROM d
  UNION ALL SELECT doc_id, 2, 'LIST > INFO > ICMT', l, NULL, strlen(l), 'with-container' FROM d
  UNION ALL SELECT doc_id, 3, 'RIFF > bext', '', trim(regexp_replace(lower(hex(encode(i))), '(..)', '\\1 ', 'g')), strlen(i), 'individual' FROM d
  UNION ALL SELECT doc_id, 4, 'RIFF > JUNK', '', NULL, 3, 'never' FROM d
  UNION ALL SELECT doc_id, 5, 'fmt ', 'PCM', NULL, NULL, 'never' FROM d UNION ALL SELECT doc_id, 6, 'fmt ', '1', NULL, NULL, 'never' FROM d
  UNION ALL SELECT doc_id, 7, 'fmt ', '1600 Hz', NULL, NULL, 'never' FROM d UNION ALL SELECT doc_id, 8, 'fmt ', '1600 B/s', NULL, NULL, 'never' FROM d
  UNION ALL SELECT doc_id, 9, 'fmt ', '8', NULL, NULL, 'never' FROM d)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, place, value, hex, CAST(size AS BIGINT) AS size, removal FROM e""")
def wav_inventory(spark, d):
    """What a WAV of each document says of itself (without its duration)."""
    made = table(spark, d, "documents").select("doc_id", F.inline(F.array(F.struct(_wav().alias("wav")))))
    rows = made.select("doc_id", F.explode(C.wav_entries(F.col("wav"))).alias("e")).where("e.key <> 'Duración'")
    return rows.select("doc_id", "e.ord", F.col("e.where").alias("place"), "e.value", "e.hex", "e.size", "e.removal")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(source, '')) AS s, strlen(coalesce(lang, '')) AS l, strlen(CAST(doc_id AS VARCHAR)) AS i, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT *, 4 + 24 + 8 + n + n % 2 AS deep, 8 + i + i % 2 AS bext, 12 AS junk FROM d)
SELECT doc_id, 'fmt ,data' AS kinds_deep, 'fmt ,bext,JUNK,data' AS kinds_light, CAST(deep AS BIGINT) AS riff_size_deep, CAST(deep + bext + junk AS BIGINT) AS riff_size_light, sha256(t) AS sound_sha256 FROM p""")
def wav_cleaned(spark, d):
    """WAVs cleaned in deep mode, and in light mode of their information list: chunks, size in the head, and the sound."""
    size = lambda b: C.unsigned(b, 4, 4)
    made = table(spark, d, "documents").select("doc_id", F.inline(F.array(F.struct(_wav().alias("wav")))))
    both = made.select("doc_id", F.inline(F.array(F.struct(C.strip_wav(F.col("wav")).alias("deep"), C.strip_wav(F.col("wav"), ("info",)).alias("light")))))
    sound = let(C.chunks(F.col("deep"), C.WAV), lambda k: F.struct(_kinds(k).alias("kinds"), _only(F.col("deep"), k, "data").alias("sha")))
    return both.withColumn("s", sound).select("doc_id", F.col("s.kinds").alias("kinds_deep"), _kinds(C.chunks(F.col("light"), C.WAV)).alias("kinds_light"), size(F.col("deep")).alias("riff_size_deep"), size(F.col("light")).alias("riff_size_light"), F.col("s.sha").alias("sound_sha256"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(source, '')) AS s, strlen(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, 'IHDR,tEXt,gAMA,eXIf,IDAT,IEND' AS kinds, 'IHDR,gAMA,IDAT,IEND' AS kinds_light, 'IHDR,IDAT,IEND' AS kinds_deep,
  CAST(8 + 6 * 12 + 13 + 5 + n + 4 + s + n AS BIGINT) AS n_bytes, CAST(8 + 4 * 12 + 13 + 4 + n AS BIGINT) AS n_light, CAST(8 + 3 * 12 + 13 + n AS BIGINT) AS n_deep, sha256(t) AS picture_sha256 FROM d""")
def png_cleaned(spark, d):
    """PNGs of whole documents, cleaned of comments and EXIF in light mode and of all that is not the picture in deep mode."""
    made = table(spark, d, "documents").select("doc_id", F.inline(F.array(F.struct(_png().alias("png")))))
    both = made.select("doc_id", "png", F.inline(F.array(F.struct(C.strip_png(F.col("png"), ("text", "exif")).alias("light"), C.strip_png(F.col("png")).alias("deep")))))
    kinds = lambda x: _kinds(C.chunks(F.col(x), C.PNG))
    size = lambda x: F.octet_length(x).cast("long")
    return both.select("doc_id", kinds("png").alias("kinds"), kinds("light").alias("kinds_light"), kinds("deep").alias("kinds_deep"), size("png").alias("n_bytes"), size("light").alias("n_light"), size("deep").alias("n_deep"), _only(F.col("deep"), C.chunks(F.col("deep"), C.PNG), "IDAT").alias("picture_sha256"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, CAST((n + 65518) // 65519 AS BIGINT) AS n_parts, CAST(8 + n + 18 * ((n + 65518) // 65519) AS BIGINT) AS n_bytes, CASE WHEN n > 0 THEN sha256(t) END AS profile_sha256 FROM d""")
def jpeg_profiles(spark, d):
    """Whole documents as colour profiles of JPEGs: put in as numbered parts and read again in their order."""
    made = table(spark, d, "documents").select("doc_id", F.inline(F.array(F.struct(C.with_icc(F.lit(b"\xff\xd8\xff\xda\0\x02\0\0"), _bytes("text")).alias("jpeg")))))
    parts = F.size(F.filter(C.chunks(F.col("jpeg"), C.JPEG), lambda k: k["kind"] == "E2")).cast("long")
    return made.select("doc_id", parts.alias("n_parts"), F.octet_length("jpeg").cast("long").alias("n_bytes"), F.sha2(C.icc_of_jpeg(F.col("jpeg")), 256).alias("profile_sha256"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN coalesce(source, '') END AS name, CAST(CASE WHEN doc_id % 5 <> 0 THEN doc_id % 2 * 8 END AS INTEGER) AS method FROM documents""")
def zip_first_members(spark, d):
    """Local headers of packages, each fifth of them cut off, whose first member holds a whole document."""
    name = _bytes("source")
    two = lambda x: C.little(x, 2)
    head = F.concat(F.lit(b"PK\x03\x04\x14\0\0\0"), two(F.col("doc_id") % 2 * 8), F.lit(bytes(16)), two(F.octet_length(name)), F.lit(b"\0\0"), name, _bytes("text"))
    cut = F.when(F.col("doc_id") % 5 == 0, F.substring(head, 1, 29)).otherwise(head)
    return table(spark, d, "documents").select("doc_id", C.first_local_entry(cut).alias("e")).select("doc_id", "e.name", "e.method")
