"""PNG, WAV and JPEG in the JVM against readers that go chunk by chunk."""

from __future__ import annotations

import random
import struct
import zlib

from pyspark.sql import functions as F

from burin.operators import chunks as C

SIGNATURE = b"\x89PNG\r\n\x1a\n"
NAMES = [b"IHDR", b"tEXt", b"IDAT", b"eXIf", b"iCCP", b"gAMA", b"tIME", b"IEND", b"zTXt", b"prVt"]
PARTS = [b"fmt ", b"data", b"LIST", b"bext", b"JUNK", b"PAD ", b"cue ", b"iXML", b"xxxx"]


def png(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def riff(kind, body):
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def broken(rng, data):
    """The bytes whole, cut off, or with a byte changed."""
    how = rng.randrange(4)
    if how == 0:
        return data[: rng.randrange(len(data) + 1)]
    if how == 1 and data:
        at = rng.randrange(len(data))
        return data[:at] + bytes([rng.randrange(256)]) + data[at + 1 :]
    return data


def some(rng, n):
    return bytes(rng.randrange(256) for _ in range(rng.randrange(n)))


def png_files(rng):
    return [broken(rng, SIGNATURE + b"".join(png(rng.choice(NAMES), some(rng, 40)) for _ in range(rng.randrange(12))) + some(rng, 6)) for _ in range(120)] + [b"", SIGNATURE, b"x" * 40]


def wav_files(rng):
    out = []
    for _ in range(150):
        info = b"INFO" + b"".join(riff(rng.choice([b"IART", b"ICMT", b"IXYZ"]), rng.choice([b" a\t b ", b"", b"\xe9" * 230, some(rng, 9)])) for _ in range(rng.randrange(4)))
        body = b"WAVE"
        for _ in range(rng.randrange(9)):
            kind = rng.choice(PARTS)
            fmt = struct.pack("<HHIIHH", rng.choice([1, 85]), rng.randrange(3), rng.choice([0, 8000]), rng.choice([0, 16000]), 1, rng.choice([0, 8]))
            body += riff(kind, rng.choice([info, info[:7], b"adtl" + some(rng, 9), info[:3]]) if kind == b"LIST" else fmt[: rng.choice([16, 16, 9])] if kind == b"fmt " else some(rng, 60))
        out.append(broken(rng, b"RIFF" + struct.pack("<I", len(body)) + body + some(rng, 5)))
    return [*out, b"", b"RIFF", b"RIFF\0\0\0\0WAVE", b"RIFF\0\0\0\0WEBPxxxx"]


def read_png(data):
    out, at = [], 8
    while data.startswith(SIGNATURE) and at + 8 <= len(data):
        end = at + 12 + int.from_bytes(data[at : at + 4], "big")
        if end > len(data):
            break
        out.append((data[at + 4 : at + 8].decode("latin-1"), at, at + 8, end - 4, end))
        at = end
    return out


def read_riff(data, at, end):
    out = []
    while at + 8 <= end:
        stop = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        if stop > end:
            break
        out.append((data[at : at + 4].decode("latin-1"), at, at + 8, stop, min(stop + stop % 2 if at % 2 == 0 else stop + (stop - at - 8) % 2, end)))
        at = out[-1][-1]
    return out


def read_jpeg(data):
    out, at = [], 2
    while data.startswith(b"\xff\xd8") and at + 4 <= len(data):
        mark = data[at + 1]
        if data[at] != 0xFF:
            at += 1
        elif mark in (0xD8, 1) or 0xD0 <= mark <= 0xD7:
            at += 2
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if mark in (0xD9, 0xDA) or size < 2 or at + 2 + size > len(data):
                break
            out.append((f"{mark:02X}", at, at + 4, at + 2 + size, at + 2 + size))
            at += 2 + size
    return out


def table(spark, files):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(files)], "i int, b binary").repartition(4)


def listed(spark, files, layout):
    return {r["i"]: [tuple(k) for k in r["k"]] for r in table(spark, files).select("i", C.chunks(F.col("b"), layout).alias("k")).collect()}


def results(spark, files, column):
    return {r["i"]: bytes(r["x"]) for r in table(spark, files).select("i", column.alias("x")).collect()}


def test_chunks_equal_a_reader_that_goes_chunk_by_chunk(spark):
    rng = random.Random(2)
    pngs, wavs = png_files(rng), wav_files(rng)
    segment = lambda m, b: bytes([255, m]) + struct.pack(">H", len(b) + 2) + b
    jpegs = [broken(rng, b"\xff\xd8" + b"".join(rng.choice([segment(0xE1, some(rng, 30)), segment(0xFE, some(rng, 9)), b"\xff\xd0", b"\0", b"\xff", segment(0xE2, b"x" * 300)]) for _ in range(rng.randrange(9))) + b"\xff\xda\0\x02zz") for _ in range(150)]
    assert listed(spark, pngs, C.PNG) == {i: read_png(b) for i, b in enumerate(pngs)}
    want = {i: read_riff(b, 12, len(b)) if b[:4] == b"RIFF" and b[8:12] == b"WAVE" else [] for i, b in enumerate(wavs)}
    assert listed(spark, wavs, C.WAV) == want and sum(map(len, want.values())) > 300
    assert listed(spark, jpegs, C.JPEG) == {i: read_jpeg(b) for i, b in enumerate(jpegs)}


def test_cleaned_images_keep_every_other_byte(spark):
    files = png_files(random.Random(3))
    every = {k for b in C.PNG_BLOCKS.values() for k in b} | set(C.PNG_ANCILLARY)
    for blocks, gone in ((None, every), (("text",), set(C.PNG_BLOCKS["text"])), (("exif", "icc"), {"eXIf", "iCCP"}), ((), set())):
        got = results(spark, files, C.strip_png(F.col("b"), blocks))
        for i, b in enumerate(files):
            cuts = [(s, e) for k, s, _, _, e in read_png(b) if k in gone]
            assert got[i] == b"".join(b[x:y] for x, y in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(b)], strict=True))


def test_cleaned_sounds(spark):
    files = wav_files(random.Random(5))
    for blocks in (None, ("info",), ("tech",), ("info", "tech"), ()):
        got = results(spark, files, C.strip_wav(F.col("b"), blocks))
        for i, b in enumerate(files):
            if blocks == () or b[:4] != b"RIFF" or b[8:12] != b"WAVE":
                assert got[i] == b
                continue
            own, body, at = read_riff(b, 12, len(b)), b"", 12
            for kind, start, inside, stop, at in own:
                info = kind == "LIST" and stop - inside >= 4 and b[inside : inside + 4] == b"INFO"
                if not (info and (blocks is None or "info" in blocks) or kind in C.WAV_TECHNICAL and (blocks is None or "tech" in blocks) or kind in C.WAV_PADDING and blocks is None):
                    body += b[start:at]
            body += b"" if blocks is None else b[at:]
            assert got[i] == b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def test_inventory_of_a_sound(spark):
    fmt = struct.pack("<HHIIHH", 1, 2, 8000, 16000, 2, 8)
    info = b"INFO" + riff(b"IART", "Ana  María ".encode("latin-1")) + riff(b"IXYZ", b"") + riff(b"ICMT", b"c" * 300)
    body = b"WAVE" + riff(b"fmt ", fmt) + riff(b"LIST", info) + riff(b"bext", bytes(range(40))) + riff(b"JUNK", b"12") + riff(b"data", b"x" * 24000)
    files = [b"RIFF" + struct.pack("<I", len(body)) + body, b"RIFF....WAVE", b"", b"none"]
    got = {r["i"]: [tuple(e) for e in r["e"]] for r in table(spark, files).select("i", C.wav_entries(F.col("b")).alias("e")).collect()}
    never = [("Formato", "PCM"), ("Canales", "2"), ("Frecuencia de muestreo", "8000 Hz"), ("Tasa de bytes", "16000 B/s"), ("Bits por muestra", "8"), ("Duración", "1,5 s")]
    assert got[0] == [
        (1, "LIST > INFO > IART", "IART", "Artista", "Ana María", None, 11, "medium", "with-container"),
        (2, "LIST > INFO > IXYZ", "IXYZ", None, "", None, 0, "medium", "with-container"),
        (3, "LIST > INFO > ICMT", "ICMT", "Comentario", "c" * 200 + "…", None, 300, "medium", "with-container"),
        (4, "RIFF > bext", "bext", "Bloque técnico", "", bytes(range(32)).hex(" ") + "…", 40, "low", "individual"),
        (5, "RIFF > JUNK", "JUNK", "Relleno", "", None, 2, "low", "never"),
        *((6 + i, "fmt ", k, k, v, None, None, "low", "never") for i, (k, v) in enumerate(never)),
    ]
    assert got[1] == got[2] == got[3] == []


def test_profiles_survive_a_round_trip_in_order(spark):
    rng = random.Random(8)
    segment = lambda m, b: bytes([255, m]) + struct.pack(">H", len(b) + 2) + b
    profile = bytes(rng.randrange(256) for _ in range(C.ICC_PART * 2 + 77))
    plain = b"\xff\xd8" + segment(0xFE, b"note") + b"\xff\xda\0\x02pixels"
    part = lambda n, b: segment(0xE2, b"ICC_PROFILE\0" + bytes([n, 3]) + b)
    mixed = b"\xff\xd8" + part(3, b"c") + part(1, b"a") + segment(0xE2, b"other") + part(2, b"b") + plain[2:]
    df = spark.createDataFrame([(0, bytearray(plain), bytearray(profile)), (1, bytearray(plain), bytearray(b"")), (2, bytearray(b"none"), bytearray(b"p")), (3, bytearray(mixed), None), (4, None, None)], "i int, b binary, p binary")
    rows = {r["i"]: r for r in df.withColumn("w", C.with_icc(F.col("b"), F.col("p"))).withColumn("back", C.icc_of_jpeg(F.col("w"))).collect()}
    assert bytes(rows[0]["back"]) == profile and bytes(rows[0]["w"]).endswith(plain[2:]) and len(rows[0]["w"]) == len(plain) + len(profile) + 3 * 18
    assert bytes(rows[1]["w"]) == plain and bytes(rows[2]["w"]) == b"none" and rows[1]["back"] is None
    assert bytes(rows[3]["back"]) == b"abc" and rows[4]["w"] is None and rows[4]["back"] is None


def test_chunks_are_made_as_they_are_read(spark):
    body = bytes(range(200)) * 2 + b"x"
    r = spark.createDataFrame([(bytearray(body),)], "b binary").select(C.png_chunk("tEXt", F.col("b")).alias("p"), C.riff_chunk("data", F.col("b")).alias("w")).first()
    assert bytes(r["p"]) == png(b"tEXt", body) and bytes(r["w"]) == riff(b"data", body)


def test_first_member_by_its_local_header(spark):
    import io
    import zipfile

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("b", "x" * 99, zipfile.ZIP_DEFLATED)
    data = made.getvalue()
    files = [data, data[:34], b"PK\3\4", b"", b"x" * 50]
    got = {r["i"]: r["e"] and tuple(r["e"]) for r in table(spark, files).select("i", C.first_local_entry(F.col("b")).alias("e")).collect()}
    assert got == {0: ("mimetype", 0), 1: None, 2: None, 3: None, 4: None}


def test_many_chunks_take_near_linear_time_without_python(spark):
    data = SIGNATURE + png(b"tEXt", b"k\0v") * 60_000
    df = spark.createDataFrame([(1, bytearray(data))], "i int, b binary")
    assert df.select(F.size(C.chunks(F.col("b"), C.PNG))).first()[0] == 60_000
    plan = df.select(C.strip_png(F.col("b")), C.strip_wav(F.col("b")), C.wav_entries(F.col("b")), C.icc_of_jpeg(F.col("b")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
