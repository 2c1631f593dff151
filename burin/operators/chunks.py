"""Files made of chunks, in the JVM: PNG, WAV and JPEG are walked, read, cleaned and put together.

aggregate() has no early end, so a walk is two of them, one inside the other, each as long as the
square root of the most chunks that the bytes could hold: after the last chunk only the outer one
counts on, and places are appended to arrays of that length at most.

A walk ends at the first chunk that the bytes do not hold whole. Bytes without the signature have
no chunks; null bytes have null. A cleaning changes nothing but the chunks that it takes (and the
size in the head of a WAV): what cannot be read stays, unless said otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from burin.functions.numeric import format_duration
from burin.functions.text import JS_SPACE, let, short_hex
from burin.operators.html import _apply, _let, subtract

_CHUNK = "struct<kind:string,start:int,body:int,stop:int,end:int>"
CHUNKS = f"array<{_CHUNK}>"
ENTRIES = "array<struct<ord:int,where:string,key:string,label:string,value:string,hex:string,size:bigint,sensitivity:string,removal:string>>"
_BARE = ENTRIES.replace("ord:int,", "")


def _number(at: str, n: int, little: bool = False) -> str:
    """The unsigned integer of n bytes of c.bytes at a place."""
    digits = ", ".join(f"substring(h, {2 * k + 1}, 2)" for k in (reversed(range(n)) if little else range(n)))
    return _let("h", f"hex(substring(c.bytes, {at} + 1, {n}))", f"CAST(conv(concat({digits}), 16, 10) AS bigint)")


def _name(at: str) -> str:
    return f"decode(substring(c.bytes, {at} + 1, 4), 'ISO-8859-1')"


@dataclass(frozen=True)
class Layout:
    """How chunks follow each other: chunk is SQL at the place w.at of c.bytes.

    It gives (kind, body, stop, whole, end): the payload is body to stop, the chunk must be held
    up to `whole`, the next one starts at `end`; an empty kind is passed over, null ends the walk.
    """

    signature: str
    first: int
    head: int
    least: int
    chunk: str


def _sized(kind: str, size: str, body: int, tail: str, padding: str) -> str:
    stop = f"w.at + {body} + z"
    return _let("z", size, f"named_struct('kind', {kind}, 'body', w.at + {body}, 'stop', {stop}, 'whole', {stop}{tail}, 'end', {stop}{tail}{padding})")


_RIFF = _sized(_name("w.at"), _number("w.at + 4", 4, little=True), 8, "", " + z % 2")
# Bytes between segments and markers without a length (start, restarts, TEM) are passed over; the picture (SOS) and the end are not walked.
_SEGMENT = f"""CASE WHEN hex(substring(c.bytes, w.at + 1, 1)) <> 'FF' THEN named_struct('kind', '', 'body', w.at, 'stop', w.at + 1L, 'whole', w.at + 1L, 'end', w.at + 1L) ELSE {_let("m", "hex(substring(c.bytes, w.at + 2, 1))", f'''CASE
  WHEN m IN ('DA', 'D9') THEN NULL
  WHEN m IN ('D8', '01') OR m BETWEEN 'D0' AND 'D7' THEN named_struct('kind', '', 'body', w.at, 'stop', w.at + 2L, 'whole', w.at + 2L, 'end', w.at + 2L)
  ELSE {_let("z", _number("w.at + 2", 2), "CASE WHEN z >= 2 THEN named_struct('kind', m, 'body', w.at + 4, 'stop', w.at + 2 + z, 'whole', w.at + 2 + z, 'end', w.at + 2 + z) END")} END''')} END"""

PNG = Layout("startswith(c.bytes, X'89504E470D0A1A0A')", 8, 8, 12, _sized(_name("w.at + 4"), _number("w.at", 4), 8, " + 4", ""))
WAV = Layout("startswith(c.bytes, X'52494646') AND substring(c.bytes, 9, 4) = X'57415645'", 12, 8, 8, _RIFF)
#: What a LIST of a WAV holds after its type.
INFO = Layout("true", 0, 8, 8, _RIFF)
JPEG = Layout("startswith(c.bytes, X'FFD8')", 2, 4, 1, _SEGMENT)


def _walk(layout: Layout) -> str:
    """SQL of the chunks of c (bytes and their number n)."""
    found = "named_struct('kind', k.kind, 'start', w.at, 'body', CAST(k.body AS int), 'stop', CAST(k.stop AS int), 'end', CAST(least(k.end, c.n) AS int))"
    step = f"""CASE WHEN NOT w.open THEN w ELSE {_let("k", f"CASE WHEN w.at + {layout.head} <= c.n THEN {layout.chunk} END", f'''CASE
      WHEN k IS NULL OR k.whole > c.n THEN named_struct('at', w.at, 'open', false, 'out', w.out)
      ELSE named_struct('at', CAST(least(k.end, c.n) AS int), 'open', true, 'out', CASE WHEN k.kind = '' THEN w.out ELSE concat(w.out, array({found})) END) END''')} END"""
    inner = f"aggregate(sequence(1, steps), named_struct('at', s.at, 'open', true, 'out', CAST(array() AS {CHUNKS})), (w, i) -> {step})"
    outer = f"""aggregate(sequence(1, steps), named_struct('at', {layout.first}, 'open', {layout.signature}, 'out', CAST(array() AS array<{CHUNKS}>)),
      (s, i) -> CASE WHEN NOT s.open THEN s ELSE {_let("r", inner, "named_struct('at', r.at, 'open', r.open, 'out', concat(s.out, array(r.out)))")} END, s -> flatten(s.out))"""
    return f"CASE WHEN c.bytes IS NOT NULL THEN {_let('steps', f'CAST(ceil(sqrt(c.n / {layout.least}.0D)) AS int) + 1', outer)} END"


def chunks(content: Column, layout: Layout) -> Column:
    """Whole chunks in order: kind, start, body and stop of the payload, end with what pads it."""
    return _apply(F.struct(content.alias("bytes"), F.octet_length(content).alias("n")), "c", _walk(layout))


def payload(content: Column, chunk: Column) -> Column:
    return F.substring(content, chunk["body"] + 1, chunk["stop"] - chunk["body"])


def _regions(found: Column) -> Column:
    return F.transform(found, lambda k: F.struct(k["start"].alias("start"), k["end"].alias("end")))


# Chunks of a PNG by block, and those that a deep cleaning takes besides.
PNG_BLOCKS = {"exif": ("eXIf",), "icc": ("iCCP",), "text": ("tEXt", "zTXt", "iTXt", "tIME")}
PNG_ANCILLARY = ("sRGB", "gAMA", "cHRM", "pHYs", "bKGD", "sPLT", "hIST", "pCAL", "sCAL", "oFFs")
# Technical chunks of a WAV, padding, and the names and sensitivities of an INFO list's entries.
WAV_TECHNICAL = ("bext", "iXML", "cue ", "acid", "smpl")
WAV_PADDING = ("JUNK", "PAD ")
WAV_INFO = {
    "INAM": ("Título", "low"), "IART": ("Artista", "medium"), "ICMT": ("Comentario", "medium"), "ICRD": ("Fecha", "low"),
    "IENG": ("Ingeniero", "medium"), "ISFT": ("Software", "low"), "ICOP": ("Copyright", "medium"), "IKEY": ("Palabras clave", "low"),
}


def strip_png(content: Column, blocks: tuple[str, ...] | None = None) -> Column:
    """A PNG without the chunks of the named blocks, or (None) without all that is not the picture; the rest byte for byte."""
    gone = [k for b in blocks for k in PNG_BLOCKS[b]] if blocks is not None else [k for b in PNG_BLOCKS.values() for k in b] + list(PNG_ANCILLARY)
    return let(content, lambda b: subtract(b, _regions(F.filter(chunks(b, PNG), lambda k: k["kind"].isin(*gone))))) if gone else content


def little(n: Column, size: int = 4) -> Column:
    return let(F.lpad(F.hex(n), 2 * size, "0"), lambda h: F.unhex(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(size))])))


def _is_info(content: Column, k: Column) -> Column:
    return (k["kind"] == "LIST") & (k["stop"] - k["body"] >= 4) & (F.substring(content, k["body"] + 1, F.lit(4)) == F.lit(b"INFO"))


def strip_wav(content: Column, blocks: tuple[str, ...] | None = None) -> Column:
    """A WAV without its information list (`info`) and technical chunks (`tech`), sizes and padding right; other files as they are.

    Without blocks (None, deep) padding chunks go too, and what follows the last whole chunk.
    """
    if blocks == ():
        return content
    info, tech = blocks is None or "info" in blocks, blocks is None or "tech" in blocks
    names = (WAV_TECHNICAL if tech else ()) + (WAV_PADDING if blocks is None else ())

    def clean(b: Column, found: Column) -> Column:
        gone = lambda k: (F.lit(info) & _is_info(b, k)) | (k["kind"].isin(*names) if names else F.lit(False))
        regions = _regions(F.filter(found, gone))
        if blocks is None:
            last = F.coalesce(F.get(found, F.size(found) - 1)["end"], F.lit(WAV.first))
            regions = F.concat(regions, F.array(F.struct(last.alias("start"), F.octet_length(b).alias("end"))))
        sized = let(subtract(b, regions), lambda x: F.concat(F.substring(x, 1, 4), little(F.octet_length(x) - 8), F.substring(x, F.lit(9), F.octet_length(x))))
        return F.when(F.startswith(b, F.lit(b"RIFF")) & (F.substring(b, 9, 4) == F.lit(b"WAVE")), sized).otherwise(b)

    return let(content, lambda b: let(chunks(b, WAV), lambda found: clean(b, found)))


def _row(where: Column, key: Column, label: Column, value: Column, hexed: Column, size: Column, sensitivity: Column, removal: str) -> Column:
    return F.struct(where.alias("where"), key.alias("key"), label.alias("label"), value.alias("value"), hexed.alias("hex"), size.cast("long").alias("size"), sensitivity.alias("sensitivity"), F.lit(removal).alias("removal"))


def _shown(raw: Column) -> Column:
    """Latin-1 text with white space as single blanks, cut after 200 characters."""
    plain = F.regexp_replace(F.regexp_replace(F.decode(raw, "ISO-8859-1"), f"{JS_SPACE}+", " "), "^ | $", "")
    return let(plain, lambda v: F.when(F.length(v) > 200, F.concat(F.substring(v, 1, 200), F.lit("…"))).otherwise(v))


def _told(names: tuple[tuple[str, str], ...], key: Column, otherwise: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names for x in pair])[key], otherwise)


def unsigned(b: Column, at: int, n: int) -> Column:
    """A little-endian integer of the bytes at a place."""
    return let(F.hex(F.substring(b, at + 1, n)), lambda h: F.conv(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(n))]), 16, 10).cast("long"))


def _format_rows(fmt: Column, data_size: Column) -> Column:
    """What the `fmt ` chunk says, none where it is too short or has neither a rate nor bytes a second."""
    numbers = F.struct(*[unsigned(fmt, at, n).alias(x) for x, at, n in (("tag", 0, 2), ("channels", 2, 2), ("rate", 4, 4), ("speed", 8, 4), ("bits", 14, 2))])
    return F.when(F.octet_length(fmt) >= 16, let(F.struct(numbers.alias("n"), data_size.alias("data_size")), lambda x: _technical(x["n"], x["data_size"]))).otherwise(F.array().cast(_BARE))


def _technical(n: Column, data_size: Column) -> Column:
    null = F.lit(None).cast("string")
    tag, channels, rate, speed, bits = (n[x] for x in ("tag", "channels", "rate", "speed", "bits"))
    hexed = F.concat(F.lit("0x"), F.lpad(F.hex(tag), 4, "0"))
    lasts = F.when(speed > 0, F.coalesce(data_size, F.lit(0)) / speed).otherwise(F.lit(0.0))
    fields = (
        ("Formato", F.when(tag == 1, F.lit("PCM")).otherwise(hexed)), ("Canales", F.when(channels > 0, channels.cast("string"))),
        ("Frecuencia de muestreo", F.when(rate > 0, F.concat(rate.cast("string"), F.lit(" Hz")))), ("Tasa de bytes", F.when(speed > 0, F.concat(speed.cast("string"), F.lit(" B/s")))),
        ("Bits por muestra", F.when(bits > 0, bits.cast("string"))), ("Duración", format_duration(lasts)),
    )
    rows = F.array(*[_row(F.lit("fmt "), F.lit(n), F.lit(n), v, null, F.lit(None), F.lit("low"), "never") for n, v in fields])
    kept = F.filter(rows, lambda r: r["value"].isNotNull())
    return F.when((rate > 0) | (speed > 0), kept).otherwise(F.array().cast(_BARE))


def wav_entries(content: Column) -> Column:
    """Inventory of a WAV: information list, technical chunks with the head of their bytes, padding, then what is never removed."""
    null = F.lit(None).cast("string")
    labels = tuple((k, v[0]) for k, v in WAV_INFO.items())
    levels = tuple((k, v[1]) for k, v in WAV_INFO.items())

    def own(b: Column, k: Column) -> Column:
        inside = F.substring(b, k["body"] + 5, k["stop"] - k["body"] - 4)
        named = lambda x, j: _row(F.concat(F.lit("LIST > INFO > "), j["kind"]), j["kind"], _told(labels, j["kind"], null), _shown(payload(x, j)), null, j["stop"] - j["body"], _told(levels, j["kind"], F.lit("medium")), "with-container")
        listed = let(inside, lambda x: F.transform(chunks(x, INFO), lambda j: named(x, j)))
        where, size = F.concat(F.lit("RIFF > "), F.trim(k["kind"])), k["stop"] - k["body"]
        technical = F.array(_row(where, F.trim(k["kind"]), F.lit("Bloque técnico"), F.lit(""), short_hex(payload(b, k)), size, F.lit("low"), "individual"))
        padding = F.array(_row(where, F.trim(k["kind"]), F.lit("Relleno"), F.lit(""), null, size, F.lit("low"), "never"))
        return F.when(_is_info(b, k), listed).when(k["kind"].isin(*WAV_TECHNICAL), technical).when(k["kind"].isin(*WAV_PADDING), padding).otherwise(F.slice(padding, 1, 0))

    def every(b: Column, found: Column) -> Column:
        last = lambda name: F.get(F.reverse(F.filter(found, lambda k: k["kind"] == name)), F.lit(0))
        rows = F.concat(F.flatten(F.transform(found, lambda k: own(b, k))), F.coalesce(let(payload(b, last("fmt ")), lambda x: _format_rows(x, last("data")["stop"] - last("data")["body"])), F.array().cast(_BARE)))
        return F.transform(rows, lambda r, i: F.struct((i + 1).alias("ord"), *[r[n].alias(n) for n in ("where", "key", "label", "value", "hex", "size", "sensitivity", "removal")]))

    return F.coalesce(let(content, lambda b: let(chunks(b, WAV), lambda found: every(b, found))).cast(ENTRIES), F.array().cast(ENTRIES))


def png_chunk(kind: str, body: Column) -> Column:
    """A chunk of a PNG: length, kind, body and CRC-32."""
    word = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))
    return let(F.concat(F.lit(kind.encode()), body), lambda named: F.concat(word(F.octet_length(named) - 4), named, word(F.crc32(named))))


def riff_chunk(kind: str, body: Column) -> Column:
    """A chunk of a RIFF file: kind, size, body, and a zero after an odd one."""
    padding = lambda b: F.when(F.octet_length(b) % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b""))
    return let(body, lambda b: F.concat(F.lit(kind.encode()), little(F.octet_length(b)), b, padding(b)))


def icc_of_jpeg(content: Column) -> Column:
    """The colour profile of a JPEG: its APP2 parts in the order of their numbers (ties as they stand); null without one."""

    def joined(b: Column, found: Column) -> Column:
        parts = F.filter(found, lambda k: (k["kind"] == "E2") & (F.substring(b, k["body"] + 1, F.lit(12)) == F.lit(b"ICC_PROFILE\0")) & (k["stop"] - k["body"] >= 12))
        numbered = F.array_sort(F.transform(parts, lambda k, i: F.struct(F.coalesce(F.conv(F.nullif(F.hex(F.substring(b, k["body"] + 13, F.when(k["stop"] - k["body"] > 12, 1).otherwise(0))), F.lit("")), 16, 10).cast("int"), F.lit(0)).alias("nth"), i.alias("i"), k["body"].alias("body"), k["stop"].alias("stop"))))
        text = F.array_join(F.transform(numbered, lambda k: F.decode(F.substring(b, k["body"] + 15, F.greatest(k["stop"] - k["body"] - 14, F.lit(0))), "ISO-8859-1")), "")
        return F.when(F.size(parts) > 0, F.encode(text, "ISO-8859-1"))

    return let(content, lambda b: let(chunks(b, JPEG), lambda found: joined(b, found)))


#: The most bytes of a profile in one APP2 part.
ICC_PART = 65_519


def with_icc(content: Column, profile: Column) -> Column:
    """A JPEG with a colour profile, in numbered parts after its start; other bytes, and an empty or null profile, change nothing."""
    n = F.ceil(F.octet_length(profile) / ICC_PART).cast("int")
    byte = lambda x: F.unhex(F.lpad(F.hex(x % 256), 2, "0"))

    def part(i: Column) -> Column:
        data = F.substring(profile, (i - 1) * ICC_PART + 1, F.lit(ICC_PART))
        size = F.octet_length(data) + 16
        return F.decode(F.concat(F.lit(b"\xff\xe2"), F.unhex(F.lpad(F.hex(size), 4, "0")), F.lit(b"ICC_PROFILE\0"), byte(i), byte(n), data), "ISO-8859-1")

    parts = F.encode(F.array_join(F.transform(F.sequence(F.lit(1), n), part), ""), "ISO-8859-1")
    fits = F.startswith(content, F.lit(b"\xff\xd8")) & (F.octet_length(profile) > 0)
    return F.when(fits, F.concat(F.substring(content, 1, 2), parts, F.substring(content, F.lit(3), F.octet_length(content)))).otherwise(content)


def first_local_entry(content: Column) -> Column:
    """struct(name, method) of the first member of a ZIP by its local header; null for other bytes or a name that is cut off."""
    held = F.startswith(content, F.lit(b"PK\x03\x04")) & (F.octet_length(content) >= 30)
    made = lambda size: F.when(held & (size + 30 <= F.octet_length(content)), F.struct(F.decode(F.substring(content, F.lit(31), size), "UTF-8").alias("name"), unsigned(content, 8, 2).cast("int").alias("method")))
    return let(unsigned(content, 26, 2).cast("int"), made)
