"""Metadata of binary and markup formats: scanners and strippers over bytes, plain Python.

scan_* give entries (where, key, value, sensitivity, removal); strip_* give bytes without
the removable ones and all else byte for byte. A file that a scanner cannot read has an
empty inventory, and a stripper returns it as it is. Nothing here raises.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

from burin.functions import html_tokens as T

Entry = tuple[str, str, str, str, str]
GONE, KEPT = "individual", "never"


def shown(value: str, most: int = 400) -> str:
    value = " ".join(value.split())
    return value[:most] + "…" if len(value) > most else value


def text_of(raw: bytes, encoding: str = "utf-8") -> str:
    return raw.decode(encoding, "replace").replace("\0", " ")


def cut(data: bytes, regions: list[tuple[int, int]]) -> bytes:
    """data without the regions, which may overlap."""
    out, at = [], 0
    for a, b in sorted(regions):
        if b > at:
            out.append(data[at : max(a, at)])
            at = b
    return b"".join([*out, data[at:]])


# --- HTML ------------------------------------------------------------------------------------

_PIECES, _WHOLE, _NAME = (re.compile(p.replace(r"\z", r"\Z").encode()) for p in (T.PIECES, T.WHOLE, T.NAME))
_ATTRIBUTE = re.compile(T.ATTRIBUTE.removeprefix(r"\G").encode())


def html_attributes(tag: bytes) -> dict[bytes, bytes]:
    """The first value of each attribute of a start tag, names in lower case."""
    inner, at, out = re.sub(rb"\A<[^ \t\n\r/>]++", b"", tag)[:-1], 0, {}
    while (m := _ATTRIBUTE.match(inner, at)) and m[0]:
        name, _, value = m[0].partition(b"=")
        value = value.lstrip(b" \t\n\r")
        if value[:1] in (b'"', b"'"):
            value = value[1:].removesuffix(value[:1])
        if name := name.strip(b" \t\n\r").lower():
            out.setdefault(name, value)
        at = m.end()
    return out


def html_readable(page: bytes) -> bool:
    """Whether a page ends with a whole token."""
    last = None
    for last in _PIECES.finditer(page):
        pass
    return last is None or bool(_WHOLE.match(last[0]))


def html_removable(page: bytes) -> Iterator[tuple[str, int, int]]:
    """(block, start, end) of meta tags that carry metadata and of authorship links; none of a page whose last token has no end."""
    pieces = list(_PIECES.finditer(page))
    if not pieces or not _WHOLE.match(pieces[-1][0]):
        return
    for tag in pieces:
        name = _NAME.match(tag[0])
        kind = name[1].lower() if name else b""
        if kind not in (b"meta", b"link"):
            continue
        have = html_attributes(tag[0])
        if kind == b"link":
            if {b"author", b"me", b"publisher"} & set(have.get(b"rel", b"").lower().split()):
                yield "links", *tag.span()
        elif b"charset" not in have and b"http-equiv" not in have and have.get(b"name", b"").strip().lower() != b"viewport":
            if any(have.get(k, b"").strip() for k in (b"name", b"property", b"itemprop")):
                yield "meta", *tag.span()


def strip_html(page: bytes, blocks: tuple[str, ...] = ("meta", "links")) -> bytes:
    return cut(page, [(a, b) for block, a, b in html_removable(page) if block in blocks])


# --- PNG -------------------------------------------------------------------------------------

_PNG = b"\x89PNG\r\n\x1a\n"


def png_chunks(data: bytes) -> list[tuple[bytes, int, int]]:
    """(type, start, end) of whole chunks."""
    out, at = [], 8
    while data.startswith(_PNG) and at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + size > len(data):
            break
        out.append((kind, at, at + 12 + size))
        at += 12 + size
    return out


def scan_png(data: bytes) -> list[Entry]:
    out: list[Entry] = []
    for kind, a, b in png_chunks(data):
        body = data[a + 8 : b - 4]
        if kind == b"IHDR" and len(body) >= 8:
            out.append(("IHDR", "size", "{}x{}".format(*struct.unpack(">II", body[:8])), "low", KEPT))
        elif kind in (b"tEXt", b"zTXt", b"iTXt"):
            key, _, rest = body.partition(b"\0")
            if kind == b"zTXt":
                rest = _inflated(rest[1:])
            elif kind == b"iTXt":
                packed, rest = rest[:1] == b"\1", rest[2:].split(b"\0", 2)[-1]
                rest = _inflated(rest) if packed else rest
            where = "XMP" if key == b"XML:com.adobe.xmp" else f"PNG > {kind.decode()}"
            out.append((where, text_of(key, "latin-1"), shown(text_of(rest)), "medium", GONE))
        elif kind == b"eXIf":
            out.append(("EXIF IFD0", "eXIf", f"{len(body)} bytes", "high", GONE))
        elif kind == b"tIME" and len(body) == 7:
            out.append(("PNG > tIME", "tIME", "{}-{:02}-{:02} {:02}:{:02}:{:02}".format(*struct.unpack(">HBBBBB", body)), "medium", GONE))
        elif kind == b"iCCP":
            out.append(("ICC", "iCCP", text_of(body.partition(b"\0")[0], "latin-1"), "low", KEPT))
    return out


def _inflated(raw: bytes) -> bytes:
    try:
        return zlib.decompressobj().decompress(raw, 1 << 20)
    except zlib.error:
        return b""


def strip_png(data: bytes) -> bytes:
    return cut(data, [(a, b) for kind, a, b in png_chunks(data) if kind in (b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME")])


# --- JPEG ------------------------------------------------------------------------------------


def jpeg_segments(data: bytes) -> list[tuple[int, int, int]]:
    """(marker, start, end) of the segments before the image data."""
    out, at = [], 2
    while data.startswith(b"\xff\xd8") and at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker in (0xDA, 0xD9):
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if size < 2 or at + 2 + size > len(data):
            break
        out.append((marker, at, at + 2 + size))
        at += 2 + size
    return out


# Names and sensitivity of common TIFF and EXIF tags.
_TIFF_TAGS = {
    0x010E: ("ImageDescription", "medium"), 0x010F: ("Make", "medium"), 0x0110: ("Model", "medium"), 0x0112: ("Orientation", "low"), 0x0131: ("Software", "medium"), 0x0132: ("ModifyDate", "medium"),
    0x013B: ("Artist", "high"), 0x8298: ("Copyright", "medium"), 0x9003: ("DateTimeOriginal", "medium"), 0x9004: ("CreateDate", "medium"), 0xA420: ("ImageUniqueID", "high"), 0xA430: ("OwnerName", "high"), 0xA431: ("SerialNumber", "high"),
}
_TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_TIFF_POINTERS = {0x8769: "EXIF SubIFD", 0x8825: "EXIF GPS", 0xA005: "EXIF Interop"}
#: Directories of a TIFF structure that are followed.
MOST_DIRECTORIES = 256


def scan_tiff(data: bytes, root: str = "IFD0") -> list[Entry]:
    """Entries of the directories of a TIFF structure; cycles end it."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return []
    order = "<" if data[:2] == b"II" else ">"
    out: list[Entry] = []
    todo, seen = [(root, struct.unpack(order + "I", data[4:8])[0])], set()
    while todo and len(seen) < MOST_DIRECTORIES:
        where, at = todo.pop(0)
        if at in seen or at + 2 > len(data) or at == 0:
            continue
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        for k in range(n):
            e = at + 2 + 12 * k
            if e + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", data, e)
            size = _TIFF_SIZES.get(kind, 0) * count
            place = e + 8 if size <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
            if not size or place + size > len(data):
                continue
            if tag in _TIFF_POINTERS:
                todo.append((_TIFF_POINTERS[tag], struct.unpack_from(order + "I", data, e + 8)[0]))
                continue
            name, sensitivity = _TIFF_TAGS.get(tag, (f"Tag 0x{tag:04X}", "high" if where == "EXIF GPS" else "medium"))
            kept = tag == 0x0112 or tag not in _TIFF_TAGS and where.startswith("IFD")
            out.append((where, name, _tiff_value(data, order, kind, min(count, 32), place, size), sensitivity, KEPT if kept else GONE))
        after = at + 2 + 12 * n
        if after + 4 <= len(data) and (following := struct.unpack_from(order + "I", data, after)[0]):
            todo.append((f"IFD{len(seen)}", following))
    return out


def _tiff_value(data: bytes, order: str, kind: int, count: int, place: int, size: int) -> str:
    if kind == 2:
        return shown(text_of(data[place : place + min(size, 512)].rstrip(b"\0")))
    if kind in (1, 6, 7):
        return data[place : place + min(size, 32)].hex(" ")
    code = {3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
    if code:
        return ", ".join(str(v) for v in struct.unpack_from(f"{order}{count}{code}", data, place))
    pairs = struct.unpack_from(f"{order}{2 * min(count, 8)}{'I' if kind == 5 else 'i'}", data, place)
    return ", ".join(f"{a / b:.6f}".rstrip("0").rstrip(".") if b else "0" for a, b in zip(pairs[::2], pairs[1::2], strict=True))


def scan_jpeg(data: bytes) -> list[Entry]:
    out: list[Entry] = []
    for marker, a, b in jpeg_segments(data):
        body = data[a + 4 : b]
        if marker == 0xE1 and body.startswith(b"Exif\0\0"):
            out += [("EXIF " + w if w.startswith("IFD") else w, *rest) for w, *rest in scan_tiff(body[6:])]
        elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            out += scan_xmp(body[29:])
        elif marker == 0xE2 and body.startswith(b"ICC_PROFILE\0"):
            out.append(("ICC", "ICC_PROFILE", f"{len(body)} bytes", "low", KEPT))
        elif marker == 0xED:
            out.append(("IPTC", "APP13", f"{len(body)} bytes", "medium", KEPT))
        elif marker == 0xFE:
            out.append(("JPEG > COM", "COM", shown(text_of(body)), "medium", GONE))
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            height, width = struct.unpack(">HH", body[1:5])
            out.append(("SOF", "size", f"{width}x{height}", "low", KEPT))
    return out


def scan_xmp(raw: bytes) -> list[Entry]:
    text = text_of(raw)
    found = re.findall(r"<([a-zA-Z]\w*:[A-Z]\w*)>\s*(?:<rdf:(?:Alt|Seq|Bag)>\s*<rdf:li[^>]*>)?([^<]+)", text) + re.findall(r"\s((?!xmlns|rdf|x)[a-zA-Z]\w*:[A-Z]\w*)=\"([^\"]*)\"", text)
    return [("XMP", k, shown(v), "medium", GONE) for k, v in found if v.strip()]


def strip_jpeg(data: bytes) -> bytes:
    """Without EXIF, XMP and comments; an Orientation other than 1 comes back in a minimal EXIF segment."""
    regions, turn = [], 1
    for marker, a, b in jpeg_segments(data):
        body = data[a + 4 : b]
        if marker == 0xFE or marker == 0xE1:
            regions.append((a, b))
            for _, name, value, *_ in scan_tiff(body[6:]) if body.startswith(b"Exif\0\0") else []:
                turn = int(value.split(",")[0]) if name == "Orientation" and value[:1].isdigit() else turn
    out = cut(data, regions)
    if turn != 1 and regions:
        tiff = b"MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01" + struct.pack(">HH", turn, 0) + b"\0\0\0\0"
        body = b"Exif\0\0" + tiff
        out = out[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + out[2:]
    return out


# --- RIFF: WebP, WAV, AVI --------------------------------------------------------------------


def riff_chunks(data: bytes, at: int = 12, end: int | None = None) -> list[tuple[bytes, int, int]]:
    """(id, start, end with padding) of chunks."""
    out, end = [], len(data) if end is None else end
    while at + 8 <= end:
        kind, size = struct.unpack("<4sI", data[at : at + 8])
        stop = min(at + 8 + size + size % 2, end)
        out.append((kind, at, stop))
        at = stop
    return out


def scan_riff(data: bytes) -> list[Entry]:
    if data[:4] != b"RIFF":
        return []
    out: list[Entry] = []
    for kind, a, b in riff_chunks(data):
        size = struct.unpack("<I", data[a + 4 : a + 8])[0]
        body = data[a + 8 : min(a + 8 + size, b)]
        if kind == b"LIST" and body[:4] == b"INFO":
            for key, x, y in riff_chunks(data, a + 12, a + 8 + len(body)):
                n = struct.unpack("<I", data[x + 4 : x + 8])[0]
                out.append((f"LIST > INFO > {text_of(key, 'latin-1')}", text_of(key, "latin-1"), shown(text_of(data[x + 8 : min(x + 8 + n, y)]).rstrip(" ")), "high" if key == b"IART" else "medium", GONE))
        elif kind in (b"bext", b"iXML", b"cue ", b"acid", b"smpl", b"IDIT", b"JUNK"):
            out.append((f"RIFF > {text_of(kind, 'latin-1').strip()}", text_of(kind, "latin-1").strip(), f"{len(body)} bytes", "medium", GONE))
        elif kind == b"EXIF":
            out += [("EXIF " + w if w.startswith("IFD") else w, *rest) for w, *rest in scan_tiff(body.removeprefix(b"Exif\0\0"))]
        elif kind == b"XMP ":
            out += scan_xmp(body)
        elif kind == b"fmt " and len(body) >= 16:
            channels, rate = struct.unpack("<HI", body[2:8])
            out.append(("fmt", "format", f"{channels} ch, {rate} Hz", "low", KEPT))
        elif kind == b"VP8X" and len(body) >= 10:
            out.append(("VP8X", "size", f"{1 + int.from_bytes(body[4:7], 'little')}x{1 + int.from_bytes(body[7:10], 'little')}", "low", KEPT))
    return out


def strip_riff(data: bytes) -> bytes:
    """Without information and EXIF chunks; sizes and the VP8X flags follow, padding stays."""
    if data[:4] != b"RIFF":
        return data
    gone = (b"bext", b"iXML", b"cue ", b"acid", b"smpl", b"IDIT", b"JUNK", b"EXIF", b"XMP ")
    regions = [(a, b) for kind, a, b in riff_chunks(data) if kind in gone or kind == b"LIST" and data[a + 8 : a + 12] == b"INFO"]
    if not regions:
        return data
    out = bytearray(cut(data, regions))
    struct.pack_into("<I", out, 4, len(out) - 8)
    for kind, a, _ in riff_chunks(bytes(out)):
        if kind == b"VP8X":
            out[a + 8] &= ~0x0C & 0xFF
    return bytes(out)


# --- GIF -------------------------------------------------------------------------------------


def gif_blocks(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the blocks after the header."""
    if data[:4] != b"GIF8" or len(data) < 13:
        return []
    at = 13 + (3 << ((data[10] & 7) + 1) if data[10] & 0x80 else 0)
    out = []

    def subblocks(k: int) -> int:
        while k < len(data) and data[k]:
            k += data[k] + 1
        return k + 1

    while at < len(data) and data[at] in (0x21, 0x2C):
        start = at
        if data[at] == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            kind = {0xFE: "comment", 0x01: "plain text", 0xFF: "application"}.get(label, "extension")
            at = subblocks(at + 2)
            if kind == "application" and data[start + 3 : start + 14] == b"XMP DataXMP":
                kind = "xmp"
        else:
            kind = "image"
            packed = data[at + 9] if at + 9 < len(data) else 0
            at = subblocks(at + 11 + (3 << ((packed & 7) + 1) if packed & 0x80 else 0))
        out.append((kind, start, min(at, len(data))))
    return out


def scan_gif(data: bytes) -> list[Entry]:
    blocks = gif_blocks(data)
    out: list[Entry] = []
    for kind, a, b in blocks:
        if kind == "comment":
            parts, k = [], a + 2
            while k < b and data[k]:
                parts.append(data[k + 1 : k + 1 + data[k]])
                k += data[k] + 1
            out.append(("GIF > Comentario", "comment", shown(text_of(b"".join(parts), "latin-1")), "medium", GONE))
        elif kind in ("plain text", "xmp"):
            out.append((f"GIF > {kind}", kind, f"{b - a} bytes", "medium", GONE))
    if blocks:
        out.append(("LSD", "size", "{}x{}".format(*struct.unpack("<HH", data[6:10])), "low", KEPT))
    return out


def strip_gif(data: bytes) -> bytes:
    return cut(data, [(a, b) for kind, a, b in gif_blocks(data) if kind in ("comment", "plain text", "xmp")])


# --- MP3 and FLAC ----------------------------------------------------------------------------


def _synchsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def id3_region(data: bytes) -> int:
    """End of a leading ID3v2 tag; 0 without one."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    return min(len(data), 10 + _synchsafe(data[6:10]) + (10 if data[5] & 0x10 else 0))


_ID3_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def scan_mp3(data: bytes) -> list[Entry]:
    out: list[Entry] = []
    end, at, version = id3_region(data), 10, data[3] if len(data) > 3 else 0
    while end and at + 10 <= end and data[at : at + 4].strip(b"\0"):
        name = text_of(data[at : at + 4], "latin-1")
        size = _synchsafe(data[at + 4 : at + 8]) if version == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(at + 10 + size, end)]
        if name.startswith("T") and body:
            value = shown(body[1:].decode(_ID3_ENCODINGS.get(body[0], "latin-1"), "replace").replace("\0", " "))
        else:
            value = f"{len(body)} bytes"
        out.append((f"ID3v2 > {name}", name, value, "high" if name in ("APIC", "TPE1", "TCOM") else "medium", GONE))
        at += 10 + size
    if len(data) >= 128 and data[-128:-125] == b"TAG":
        for name, a, b in (("TITLE", 3, 33), ("ARTIST", 33, 63), ("ALBUM", 63, 93), ("YEAR", 93, 97), ("COMMENT", 97, 127)):
            if value := shown(text_of(data[-128:][a:b].rstrip(b"\0 "), "latin-1")):
                out.append((f"ID3v1 > {name}", name, value, "medium", GONE))
    for key, value in ape_items(data):
        out.append((f"APE > {key}", key, value, "medium", GONE))
    if end or data[:1] == b"\xff":
        out.append(("MPEG", "format", "MP3", "low", KEPT))
    return out


def ape_region(data: bytes) -> tuple[int, int] | None:
    at = data.rfind(b"APETAGEX", max(0, len(data) - (256 << 10)))
    if at < 0 or at + 32 > len(data):
        return None
    size, _, flags = struct.unpack("<III", data[at + 12 : at + 24])
    if flags & 0x20000000:
        return at, min(len(data), at + 32 + size)
    start = at + 32 - size - (32 if flags & 0x80000000 else 0)
    return (start, at + 32) if start >= 0 else None


def ape_items(data: bytes) -> list[tuple[str, str]]:
    region = ape_region(data)
    if not region:
        return []
    at, end = region
    at += 32 if data[at : at + 8] == b"APETAGEX" else 0
    out = []
    while at + 9 <= end and data[at : at + 8] != b"APETAGEX":
        size = struct.unpack("<I", data[at : at + 4])[0]
        stop = data.find(b"\0", at + 8, end)
        if stop < 0 or stop + 1 + size > end:
            break
        out.append((text_of(data[at + 8 : stop]), shown(text_of(data[stop + 1 : stop + 1 + size]))))
        at = stop + 1 + size
    return out


def strip_mp3(data: bytes) -> bytes:
    regions = [(0, id3_region(data))]
    if region := ape_region(data):
        regions.append(region)
    if len(data) >= 128 and data[-128:-125] == b"TAG":
        regions.append((len(data) - 128, len(data)))
    return cut(data, regions)


def flac_blocks(data: bytes) -> list[tuple[int, int, int]]:
    out, at = [], 4
    while data[:4] == b"fLaC" and at + 4 <= len(data):
        stop = at + 4 + int.from_bytes(data[at + 1 : at + 4], "big")
        if stop > len(data):
            break
        out.append((data[at] & 0x7F, at, stop))
        if data[at] & 0x80:
            break
        at = stop
    return out


def scan_flac(data: bytes) -> list[Entry]:
    out: list[Entry] = []
    for kind, a, b in flac_blocks(data):
        body = data[a + 4 : b]
        if kind == 4 and len(body) >= 8:
            at = 4 + struct.unpack("<I", body[:4])[0]
            n = struct.unpack("<I", body[at : at + 4])[0] if at + 4 <= len(body) else 0
            at += 4
            for _ in range(n):
                if at + 4 > len(body):
                    break
                size = struct.unpack("<I", body[at : at + 4])[0]
                key, _, value = text_of(body[at + 4 : at + 4 + size]).partition("=")
                out.append((f"Vorbis comment > {key.upper()}", key.upper(), shown(value), "high" if key.upper() == "ARTIST" else "medium", GONE))
                at += 4 + size
        elif kind == 6:
            out.append(("FLAC > PICTURE", "PICTURE", f"{len(body)} bytes", "high", GONE))
        elif kind == 1:
            out.append(("FLAC > PADDING", "PADDING", f"{len(body)} bytes", "low", KEPT))
        elif kind == 0 and len(body) >= 18:
            out.append(("STREAMINFO", "rate", f"{int.from_bytes(body[10:13], 'big') >> 4} Hz", "low", KEPT))
    return out


def strip_flac(data: bytes) -> bytes:
    """Without comments and pictures; the last block is marked anew."""
    blocks = flac_blocks(data)
    kept = [(k, a, b) for k, a, b in blocks if k not in (4, 6)]
    if not blocks or len(kept) == len(blocks) or not kept:
        return data
    out = bytearray(b"fLaC")
    for i, (kind, a, b) in enumerate(kept):
        out += bytes([kind | (0x80 if i == len(kept) - 1 else 0)]) + data[a + 1 : b]
    return bytes(out) + data[blocks[-1][2] :]


# --- SVG, RTF and packages -------------------------------------------------------------------

_SVG_GONE = re.compile(r"(?is)<!--.*?-->|<\?(?!xml\s).*?\?>|<metadata\b[^>]*>.*?</metadata>|<metadata\b[^>]*/>|<(title|desc)\b[^>]*>.*?</\1>|<((?:sodipodi|inkscape):[\w-]+)\b[^>]*(?:/>|>.*?</\2>)")
_SVG_ATTRIBUTES = re.compile(r"""\s(?:(?:sodipodi|inkscape):[\w-]+|data-name)\s*=\s*(?:"[^"]*"|'[^']*')""")


def _svg(data: bytes) -> str | None:
    from xml.etree import ElementTree

    text = text_of(data)
    try:
        ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return None
    return text


def scan_svg(data: bytes) -> list[Entry]:
    text = _svg(data)
    if text is None:
        return []
    out: list[Entry] = []
    for m in _SVG_GONE.finditer(text):
        where = "comentario XML" if m[0].startswith("<!--") else "instrucción <?…?>" if m[0].startswith("<?") else f"svg > {m[1] or m[2] or 'metadata'}"
        out.append((where, where.removeprefix("svg > "), shown(re.sub(r"<[^>]+>", " ", m[0].removeprefix("<!--").removesuffix("-->"))) or "Presente", "medium", GONE))
    for m in _SVG_ATTRIBUTES.finditer(text):
        name, _, value = m[0].strip().partition("=")
        out.append((f"atributo @{name.strip()}", name.strip(), shown(value.strip()[1:-1]), "low", GONE))
    out.append(("svg", "root", "svg", "low", KEPT))
    return out


def strip_svg(data: bytes) -> bytes:
    text = _svg(data)
    return data if text is None else _SVG_ATTRIBUTES.sub("", _SVG_GONE.sub("", text)).encode()


def rtf_groups(data: bytes) -> list[tuple[str, int, int]]:
    """Outermost info and generator groups; empty if braces do not balance."""
    text, out, stack, at = data.decode("latin-1"), [], [], 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if c == "{":
            stack.append(at)
        elif c == "}":
            if not stack:
                return []
            start = stack.pop()
            m = re.match(r"\{\\(?:\*\\)?(info|generator)\b", text[start : start + 20])
            if m:
                out = [g for g in out if g[1] < start] + [(m[1], start, at + 1)]
        at += 1
    return [] if stack else out


def scan_rtf(data: bytes) -> list[Entry]:
    out: list[Entry] = []
    for kind, a, b in rtf_groups(data):
        body = data[a:b].decode("latin-1")
        if kind == "info":
            for key, value in re.findall(r"\{\\(?:\*\\)?(\w+?)(?:\s|(?=\\))([^{}]*)\}", body):
                out.append((f"info > \\{key}", key, shown(value), "high" if key in ("author", "operator") else "medium", GONE))
        else:
            out.append(("destino \\*\\generator", "generator", shown(re.sub(r"^\{\\\*\\generator\s*|\}$", "", body)), "medium", GONE))
    if data.startswith(b"{\\rtf"):
        out.append(("cabecera", "version", "RTF", "low", KEPT))
    return out


def strip_rtf(data: bytes) -> bytes:
    return cut(data, [(a, b) for _, a, b in rtf_groups(data)])


def scan_office(data: bytes) -> list[Entry]:
    out: list[Entry] = []
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
        for name in package.namelist():
            if name in ("docProps/core.xml", "docProps/app.xml", "meta.xml") or name.endswith(".opf"):
                for key, value in re.findall(r"<([\w:-]+)(?:\s[^>]*)?>([^<]+)</\1>", text_of(package.read(name))):
                    if value.strip():
                        out.append((f"{name} > {key}" if name == "meta.xml" else name, key, shown(value), "high" if re.search("creator|author|lastModifiedBy", key) else "medium", GONE))
            elif name == "docProps/custom.xml" or re.search(r"comments\w*\.xml$|Thumbnails/|docProps/thumbnail", name):
                out.append((name, name.rsplit("/", 1)[-1], f"{package.getinfo(name).file_size} bytes", "medium", GONE))
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, zlib.error):
        return []
    return out


def strip_office(data: bytes) -> bytes:
    """Without property parts, thumbnails and comments; relations and content types follow, mimetype stays first."""
    gone = re.compile(r"^(?:docProps/.*|Thumbnails/.*|(?:word|xl|ppt)/comments\w*\.xml|customXml/.*)$")
    out = io.BytesIO()
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
        with zipfile.ZipFile(out, "w") as z:
            for item in package.infolist():
                if gone.match(item.filename):
                    continue
                body = package.read(item.filename)
                if item.filename in ("_rels/.rels", "[Content_Types].xml") or item.filename.endswith(".rels") or item.filename == "META-INF/manifest.xml":
                    body = re.sub(rb"<(?:Relationship|Override|manifest:file-entry)\b[^>]*(?:docProps/|comments\w*\.xml|Thumbnails/|customXml/)[^>]*/>", b"", body)
                elif item.filename == "meta.xml":
                    body = re.sub(rb"(?s)(<office:meta\b[^>]*>).*?(</office:meta>)", rb"\1\2", body)
                z.writestr(zipfile.ZipInfo(item.filename, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_STORED if item.filename == "mimetype" else zipfile.ZIP_DEFLATED)
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, zlib.error):
        return data
    return out.getvalue()


# --- ISO base media (MP4, MOV, M4A) ----------------------------------------------------------


def boxes(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[bytes, int, int, int]]:
    """(type, start, body, end) of the boxes of a range."""
    out, end = [], len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = at + 8
        if size == 1 and at + 16 <= end:
            size, body = struct.unpack(">Q", data[at + 8 : at + 16])[0], at + 16
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            break
        out.append((kind, at, body, stop))
        at = stop
    return out


def _udta(data: bytes) -> list[tuple[str, int, int, int]]:
    """(path, start, body, end) of metadata boxes under moov and its tracks."""
    out = []
    for kind, _, body, stop in boxes(data):
        if kind == b"moov":
            for sub, a, b, c in boxes(data, body, stop):
                if sub in (b"udta", b"meta"):
                    out.append((f"moov > {sub.decode()}", a, b, c))
                elif sub == b"trak":
                    out += [(f"moov > trak > {x.decode('latin-1')}", p, q, r) for x, p, q, r in boxes(data, b, c) if x in (b"udta", b"meta")]
    return out


def scan_iso(data: bytes) -> list[Entry]:
    out: list[Entry] = []
    for path, _, body, stop in _udta(data):
        for m in re.finditer(rb"data\0\0\0\x01\0\0\0\0", data[body:stop]):
            at = body + m.start() - 4
            size = struct.unpack(">I", data[at : at + 4])[0]
            key = text_of(data[at - 4 : at], "latin-1")
            out.append((f"{path} > {key}", key, shown(text_of(data[at + 16 : at + size])), "high" if "ART" in key else "medium", GONE))
        if not any(e[0].startswith(path) for e in out):
            out.append((path, path.rsplit(" ", 1)[-1], f"{stop - body} bytes", "medium", GONE))
    for kind, _, body, stop in boxes(data):
        if kind == b"ftyp":
            out.append(("ftyp", "brand", text_of(data[body : body + 4], "latin-1"), "low", KEPT))
    return out


def strip_iso(data: bytes) -> bytes:
    """Metadata boxes become `free` boxes of the same size, so no offset moves."""
    out = bytearray(data)
    for _, a, body, stop in _udta(data):
        out[a + 4 : a + 8] = b"free"
        out[body:stop] = bytes(stop - body)
    return bytes(out)


# --- Matroska --------------------------------------------------------------------------------

# Element numbers of the container.
_SEGMENT, _INFO, _TAGS, _TAG, _SIMPLE, _ATTACHMENTS, _FILE, _VOID = 0x18538067, 0x1549A966, 0x1254C367, 0x7373, 0x67C8, 0x1941A469, 0x61A7, 0xEC
_TAG_NAME, _TAG_STRING, _FILE_NAME, _DATE = 0x45A3, 0x4487, 0x466E, 0x4461
_INFO_TEXT = {0x7BA9: "Title", 0x4D80: "MuxingApp", 0x5741: "WritingApp"}


def _vint(data: bytes, at: int, marked: bool) -> tuple[int, int]:
    """(value, length) of a variable-length integer; marked keeps its length bits."""
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or at + length > len(data):
        raise ValueError("bad integer")
    raw = int.from_bytes(data[at : at + length], "big")
    return (raw if marked else raw & ((1 << 7 * length) - 1)), length


def elements(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int, int]]:
    """(number, start, body, end) of the elements of a range; an unknown size reaches to its end."""
    out, end = [], len(data) if end is None else end
    while at < end:
        try:
            number, n = _vint(data, at, True)
            size, m = _vint(data, at + n, False)
        except (ValueError, IndexError):
            break
        body = at + n + m
        stop = end if size == (1 << 7 * m) - 1 else body + size
        if stop > end:
            break
        out.append((number, at, body, stop))
        at = stop
    return out


def _segment_parts(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    for number, _, body, stop in elements(data):
        if number == _SEGMENT:
            yield from elements(data, body, stop)


def scan_mkv(data: bytes) -> list[Entry]:
    out: list[Entry] = []
    for number, _, body, stop in _segment_parts(data):
        if number == _INFO:
            for n, _, b, e in elements(data, body, stop):
                if n in _INFO_TEXT:
                    out.append(("Segment > Info", _INFO_TEXT[n], shown(text_of(data[b:e])), "medium", GONE))
                elif n == _DATE:
                    out.append(("Segment > Info", "DateUTC", str(int.from_bytes(data[b:e], "big", signed=True)), "medium", GONE))
        elif number == _TAGS:
            for _, _, b, e in (x for x in elements(data, body, stop) if x[0] == _TAG):
                for _, _, c, f in (x for x in elements(data, b, e) if x[0] == _SIMPLE):
                    have = {n: text_of(data[p:q]) for n, _, p, q in elements(data, c, f)}
                    key = have.get(_TAG_NAME, "")
                    out.append(("Tags > Tag > SimpleTag", key, shown(have.get(_TAG_STRING, "")), "high" if key.upper() == "ARTIST" else "medium", GONE))
        elif number == _ATTACHMENTS:
            for _, _, b, e in (x for x in elements(data, body, stop) if x[0] == _FILE):
                name = next((text_of(data[p:q]) for n, _, p, q in elements(data, b, e) if n == _FILE_NAME), "")
                out.append(("Segment > Attachments > AttachedFile", "FileName", shown(name), "high", GONE))
    if elements(data)[:1] and elements(data)[0][0] == 0x1A45DFA3:
        out.append(("EBML", "format", "Matroska", "low", KEPT))
    return out


def _void(size: int) -> bytes:
    """A void element of `size` bytes, 2 at least."""
    if size < 9:
        return bytes([_VOID, 0x80 | (size - 2)]) + bytes(size - 2)
    return bytes([_VOID, 0x01]) + (size - 9).to_bytes(7, "big") + bytes(size - 9)


def strip_mkv(data: bytes) -> bytes:
    """Tags, attachments and the information's texts and date become voids of the same size."""
    out = bytearray(data)
    for number, start, body, stop in _segment_parts(data):
        gone = [(start, stop)] if number in (_TAGS, _ATTACHMENTS) else [(a, e) for n, a, _, e in elements(data, body, stop) if n in _INFO_TEXT or n == _DATE] if number == _INFO else []
        for a, b in gone:
            out[a:b] = _void(b - a)
    return bytes(out)


# --- TIFF, EPUB, PDF -------------------------------------------------------------------------


def strip_tiff(data: bytes) -> bytes:
    """Metadata tags leave their directories and their values are zeroed; image offsets do not move."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return data
    order, out = "<" if data[:2] == b"II" else ">", bytearray(data)
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    todo = [(at, False)]
    while todo and len(seen) < MOST_DIRECTORIES:
        at, whole = todo.pop()
        if not at or at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * n > len(data):
            continue
        kept = []
        for k in range(n):
            e = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, e)
            if tag in _TIFF_POINTERS:
                todo.append((struct.unpack_from(order + "I", data, e + 8)[0], True))
            if whole or tag in _TIFF_POINTERS or tag in _TIFF_TAGS and tag != 0x0112:
                size = _TIFF_SIZES.get(kind, 0) * count
                place = struct.unpack_from(order + "I", data, e + 8)[0]
                if size > 4 and place + size <= len(data):
                    out[place : place + size] = bytes(size)
            else:
                kept.append(data[e : e + 12])
        following = data[at + 2 + 12 * n : at + 6 + 12 * n]
        body = struct.pack(order + "H", len(kept)) + b"".join(kept) + (b"\0\0\0\0" if whole else following)
        out[at : at + 6 + 12 * n] = body.ljust(6 + 12 * n, b"\0")
        if not whole:
            todo.append((struct.unpack(order + "I", following)[0], False))
    return bytes(out)


# What a package must keep, and files that readers leave beside it.
_EPUB_KEPT = ("identifier", "title", "language")
_SIDECARS = re.compile(r"^(?:META-INF/(?:calibre_bookmarks\.txt|com\.apple\.ibooks\.display-options\.xml)|iTunesMetadata\.plist)$")
_OPF_LEAF = re.compile(r"<((?:dc|dcterms):([\w-]+)|meta)\b([^>]*?)(?:/>|>([^<]*)</\1>)")
_EPOCH = "1970-01-01T00:00:00Z"


def _dated(name: str, attributes: str) -> bool:
    return name in ("date", "modified") or 'property="dcterms:modified"' in attributes


def scan_epub(data: bytes) -> list[Entry]:
    out: list[Entry] = []
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
        for name in package.namelist():
            if name.endswith(".opf"):
                for m in _OPF_LEAF.finditer(text_of(package.read(name))):
                    key = m[1] if m[2] else next(iter(re.findall(r'(?:property|name)="([^"]*)"', m[3])), "meta")
                    value = shown(m[4] or next(iter(re.findall(r'content="([^"]*)"', m[3])), ""))
                    kept = m[2] in _EPUB_KEPT or _dated(m[2] or "", m[3]) and value.startswith("1970-01-01")
                    out.append((f"OPF > metadata > {m[1]}", key, value, "high" if m[2] in ("creator", "contributor") else "medium", KEPT if kept else GONE))
            elif _SIDECARS.match(name):
                out.append((f"sidecar: {name}", name.rsplit("/", 1)[-1], f"{package.getinfo(name).file_size} bytes", "medium", GONE))
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, zlib.error):
        return []
    return out


def _clean_opf(text: str) -> str:
    """Personal elements go, dates become the epoch, and what refines a gone element goes with it."""
    gone: set[str] = set()

    def once(m: re.Match) -> str:
        if m[2] in _EPUB_KEPT:
            return m[0]
        if _dated(m[2] or "", m[3]):
            return m[0].replace(f">{m[4]}<", f">{_EPOCH}<") if m[4] else m[0]
        refines = re.search(r'refines="#([^"]*)"', m[3])
        if not m[2] and refines and refines[1] not in gone:
            return m[0]
        gone.update(re.findall(r'\bid="([^"]*)"', m[3]))
        return ""

    while True:
        before = len(gone)
        out = _OPF_LEAF.sub(once, text)
        if len(gone) == before:
            return out
        text = out


def strip_epub(data: bytes) -> bytes:
    out = io.BytesIO()
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
        with zipfile.ZipFile(out, "w") as z:
            for item in sorted(package.infolist(), key=lambda i: i.filename != "mimetype"):
                if _SIDECARS.match(item.filename):
                    continue
                body = package.read(item.filename)
                if item.filename.endswith(".opf"):
                    body = _clean_opf(text_of(body)).encode()
                z.writestr(zipfile.ZipInfo(item.filename, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_STORED if item.filename == "mimetype" else zipfile.ZIP_DEFLATED)
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, zlib.error):
        return data
    return out.getvalue()


def scan_pdf(data: bytes) -> list[Entry]:
    """Document information, XMP properties and the page count."""
    from burin.functions import pdf

    try:
        doc = pdf.Document(data)
    except ValueError as e:
        return [("trailer", "Encrypt", str(e), "low", KEPT)] if b"/Encrypt" in data else []
    out: list[Entry] = [("info dictionary", k, shown(v), "high" if k == "Author" else "medium", GONE) for k, v in doc.info().items()]
    for value in doc.objects.values():
        if isinstance(value, pdf.Stream) and value.info.get("Type") == "Metadata":
            out += scan_xmp(value.decoded())
    out.append(("page tree", "pages", str(len(doc.pages)), "low", KEPT))
    return out


def strip_pdf(data: bytes) -> bytes:
    """Pages rewritten without document information and metadata streams."""
    from burin.functions import pdf

    doc, out = pdf.Document(data), pdf.Writer()
    for page in doc.pages:
        out.page(doc, {k: v for k, v in page.items() if k not in ("Metadata", "PieceInfo", "LastModified")})
    return out.bytes() if out.kids else data


SCANNERS: dict[str, Callable[[bytes], list[Entry]]] = {
    "png": scan_png, "jpg": scan_jpeg, "tiff": scan_tiff, "webp": scan_riff, "wav": scan_riff, "avi": scan_riff, "gif": scan_gif, "mp3": scan_mp3, "flac": scan_flac, "svg": scan_svg, "rtf": scan_rtf,
    "docx": scan_office, "xlsx": scan_office, "pptx": scan_office, "odt": scan_office, "epub": scan_epub, "mkv": scan_mkv, "webm": scan_mkv, "pdf": scan_pdf, "mp4": scan_iso, "mov": scan_iso, "m4a": scan_iso,
}
STRIPPERS: dict[str, Callable[[bytes], bytes]] = {
    "png": strip_png, "jpg": strip_jpeg, "webp": strip_riff, "wav": strip_riff, "avi": strip_riff, "gif": strip_gif, "mp3": strip_mp3, "flac": strip_flac, "svg": strip_svg, "rtf": strip_rtf,
    "docx": strip_office, "xlsx": strip_office, "pptx": strip_office, "odt": strip_office, "epub": strip_epub, "mkv": strip_mkv, "webm": strip_mkv, "tiff": strip_tiff, "pdf": strip_pdf, "html": strip_html, "mp4": strip_iso, "mov": strip_iso, "m4a": strip_iso,
}


def scan(data: bytes | None, kind: str) -> list[Entry]:
    try:
        return SCANNERS[kind](data) if data and kind in SCANNERS else []
    except (ValueError, IndexError, KeyError, TypeError, AttributeError, RecursionError, struct.error, zlib.error):
        return []


def strip(data: bytes | None, kind: str) -> bytes | None:
    try:
        return STRIPPERS[kind](data) if data and kind in STRIPPERS else data
    except (ValueError, IndexError, KeyError, TypeError, AttributeError, RecursionError, struct.error, zlib.error):
        return data
