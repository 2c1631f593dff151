"""PDF files in plain Python: read objects, copy pages, rewrite, stamp, extract text.

Objects are found by scanning for `n g obj`, so a broken cross-reference table does no
harm; object streams are opened. Encrypted files are refused with a stable message.
"""

from __future__ import annotations

import io
import re
import zlib
from dataclasses import dataclass
from typing import Any

_SPACE, _DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
#: Attributes that a page takes from the nodes above it.
_INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


@dataclass(frozen=True)
class Ref:
    number: int


class Name(str):
    """A name without its slash."""


@dataclass
class Stream:
    info: dict
    raw: bytes

    def decoded(self) -> bytes:
        filters = self.info.get("Filter", [])
        data = self.raw
        for f in filters if isinstance(filters, list) else [filters]:
            if f == "FlateDecode":
                try:
                    data = zlib.decompressobj().decompress(data)
                except zlib.error:
                    return b""
            elif f == "ASCIIHexDecode":
                data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0]).decode().ljust(2, "0"))
            else:
                return b""
        return data


class Reader:
    """Values of PDF syntax from bytes, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        while self.at < len(self.data):
            c = self.data[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 0x25:
                end = re.compile(rb"[\r\n]").search(self.data, self.at)
                self.at = end.end() if end else len(self.data)
            else:
                return

    def word(self) -> bytes:
        end = self.at
        while end < len(self.data) and self.data[end] not in _SPACE and self.data[end] not in _DELIMITERS:
            end += 1
        out, self.at = self.data[self.at : max(end, self.at + 1)], max(end, self.at + 1)
        return out

    def value(self) -> Any:
        """A value; operators and keywords come as bytes; None at the end."""
        self.skip()
        d, at = self.data, self.at
        if at >= len(d):
            return None
        if d.startswith(b"<<", at):
            self.at += 2
            out: dict = {}
            while True:
                key = self.value()
                if key is None or key == b">>":
                    return out
                if isinstance(key, Name):
                    out[str(key)] = self.value()
        if d.startswith(b">>", at):
            self.at += 2
            return b">>"
        c = d[at : at + 1]
        if c == b"[":
            self.at += 1
            items: list = []
            while (item := self.value()) is not None and item != b"]":
                items.append(item)
            return items
        if c == b"]":
            self.at += 1
            return b"]"
        if c == b"/":
            self.at += 1
            raw = self.word() if self.at < len(d) and d[self.at] not in _SPACE and d[self.at] not in _DELIMITERS else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"))
        if c == b"(":
            return self.string()
        if c == b"<":
            end = d.find(b">", at)
            self.at = end + 1 if end >= 0 else len(d)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end if end >= 0 else len(d)]).decode()
            return bytearray.fromhex(digits + "0" * (len(digits) % 2))
        m = re.compile(rb"(\d+)\s+(\d+)\s+R(?![0-9A-Za-z])").match(d, at)
        if m:
            self.at = m.end()
            return Ref(int(m[1]))
        word = self.word()
        if re.fullmatch(rb"[-+]?\d+", word):
            return int(word)
        if re.fullmatch(rb"[-+]?(?:\d+\.\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False}.get(word, word)

    def string(self) -> bytearray:
        out, depth, d = bytearray(), 1, self.data
        self.at += 1
        while self.at < len(d):
            c = d[self.at]
            self.at += 1
            if c == 0x5C and self.at < len(d):
                m = re.compile(rb"[0-7]{1,3}|\r\n|.", re.S).match(d, self.at)
                self.at = m.end()
                if m[0][:1].isdigit() and m[0][0] < 0x38:
                    out.append(int(m[0], 8) & 255)
                elif m[0] not in (b"\n", b"\r", b"\r\n"):
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(m[0], m[0])
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            out.append(c)
        return out


class Document:
    """The objects of a file and its pages in order, inherited attributes filled in."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:5].startswith(b"%PDF"):
            raise ValueError("El archivo no es un PDF válido")
        self.objects: dict[int, Any] = {}
        at = 0
        while m := _OBJECT.search(data, at):
            reader = Reader(data, m.end())
            value = reader.value()
            reader.skip()
            if isinstance(value, dict) and data.startswith(b"stream", reader.at):
                start = reader.at + 6
                start += 2 if data[start : start + 2] == b"\r\n" else 1
                size = value.get("Length")
                stop = start + size if isinstance(size, int) and data[start + size : start + size + 12].lstrip()[:9] == b"endstream" else data.find(b"endstream", start)
                stop = len(data) if stop < 0 else stop
                value, reader.at = Stream(value, data[start:stop]), stop
            self.objects[int(m[1])] = value
            at = max(reader.at, m.end())
        trailers = [Reader(data, m.end()).value() for m in re.finditer(rb"trailer", data)]
        trailers += [o.info for o in self.objects.values() if isinstance(o, Stream) and o.info.get("Type") == "XRef"]
        self.trailer: dict = {}
        for t in trailers:
            self.trailer |= t if isinstance(t, dict) else {}
        if "Encrypt" in self.trailer:
            raise ValueError("El PDF está protegido con contraseña")
        for o in [o for o in self.objects.values() if isinstance(o, Stream) and o.info.get("Type") == "ObjStm"]:
            body, n, first = o.decoded(), self.at(o.info.get("N")), self.at(o.info.get("First"))
            head = Reader(body)
            for number, offset in [(head.value(), head.value()) for _ in range(n or 0)]:
                if isinstance(number, int) and isinstance(offset, int):
                    self.objects.setdefault(number, Reader(body, first + offset).value())
        root = self.at(self.trailer.get("Root")) or next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), {})
        self.pages: list[dict] = []
        self._walk(root.get("Pages"), {}, set())

    def at(self, value: Any) -> Any:
        """The object that a reference stands for."""
        for _ in range(20):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(value.number)
        return value

    def _walk(self, ref: Any, above: dict, seen: set[int]) -> None:
        if isinstance(ref, Ref):
            if ref.number in seen:
                return
            seen.add(ref.number)
        node = self.at(ref)
        if not isinstance(node, dict):
            return
        own = above | {k: node[k] for k in _INHERITED if k in node}
        if "Kids" in node:
            for kid in self.at(node["Kids"]) or []:
                self._walk(kid, own, seen)
        else:
            self.pages.append(own | node)

    def info(self) -> dict[str, str]:
        found = self.at(self.trailer.get("Info"))
        return {k: text_string(v) for k, v in found.items() if isinstance(self.at(v), (bytearray, bytes))} if isinstance(found, dict) else {}

    def content(self, page: dict) -> bytes:
        parts = self.at(page.get("Contents"))
        streams = [self.at(p) for p in (parts if isinstance(parts, list) else [parts])]
        return b"\n".join(s.decoded() for s in streams if isinstance(s, Stream))


def text_string(raw: bytes) -> str:
    return bytes(raw)[2:].decode("utf-16-be", "replace") if bytes(raw[:2]) == b"\xfe\xff" else bytes(raw).decode("latin-1")


def _written(value: Any) -> bytes:
    if isinstance(value, Ref):
        return b"%d 0 R" % value.number
    if isinstance(value, Name):
        return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02X" % m[0][0], value.encode("latin-1"))
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, dict):
        return b"<< " + b" ".join(_written(Name(k)) + b" " + _written(v) for k, v in value.items()) + b" >>"
    if isinstance(value, list):
        return b"[" + b" ".join(map(_written, value)) + b"]"
    if isinstance(value, bytearray):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, Stream):
        return _written(value.info | {"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    if isinstance(value, bytes):
        return value
    if value is None:
        return b"null"
    return (f"{value:.4f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)).encode()


#: How a file that is written begins.
HEAD = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"


class Writer:
    """Collects pages of documents into a new file; shared objects are copied once.

    Numbers start after `before`; the first `heads` objects are filled in last, and the last of
    them is the node above the pages.
    """

    def __init__(self, before: int = 0, heads: int = 2):
        self.before, self.objects = before, [None] * heads
        self.above = Ref(before + heads)
        self.kids: list[Ref] = []
        self.copied: dict[tuple[int, int], Ref] = {}

    def add(self, value: Any) -> Ref:
        self.objects.append(value)
        return Ref(self.before + len(self.objects))

    def copy(self, doc: Document, value: Any) -> Any:
        if isinstance(value, Ref):
            key = (id(doc), value.number)
            if key not in self.copied:
                target = doc.objects.get(value.number)
                if isinstance(target, dict) and target.get("Type") in ("Page", "Pages", "Catalog"):
                    return None
                self.copied[key] = self.add(None)
                self.objects[self.copied[key].number - self.before - 1] = self.copy(doc, target)
            return self.copied[key]
        if isinstance(value, dict):
            return {k: self.copy(doc, v) for k, v in value.items()}
        if isinstance(value, list):
            return [self.copy(doc, v) for v in value]
        if isinstance(value, Stream):
            return Stream(self.copy(doc, value.info), value.raw)
        return value

    def page(self, doc: Document, page: dict, stamp: Stream | None = None, fonts: dict | None = None) -> None:
        made = {k: self.copy(doc, v) for k, v in page.items() if k not in ("Parent", "B", "StructParents")}
        made |= {"Type": Name("Page"), "Parent": self.above}
        if stamp is not None:
            before = made.get("Contents")
            parts = before if isinstance(before, list) else [before] if before is not None else []
            made["Contents"] = [self.add(Stream({}, b"q")), *parts, self.add(Stream({}, b"Q")), self.add(stamp)]
            resources = dict(self.copy(doc, doc.at(page.get("Resources")) or {}))
            own = self.copy(doc, doc.at((doc.at(page.get("Resources")) or {}).get("Font")) or {})
            made["Resources"] = resources | {"Font": dict(own) | (fonts or {})}
        self.kids.append(self.add(made))

    def body(self, head: bytes = b"") -> tuple[io.BytesIO, list[int]]:
        """The objects after `head`, and where each begins."""
        out, at = io.BytesIO(), []
        out.write(head)
        for i, value in enumerate(self.objects, self.before + 1):
            at.append(out.tell())
            out.write(b"%d 0 obj\n" % i + _written(value) + b"\nendobj\n")
        return out, at

    def bytes(self) -> bytes:
        self.objects[0] = {"Type": Name("Catalog"), "Pages": Ref(2)}
        self.objects[1] = {"Type": Name("Pages"), "Kids": self.kids, "Count": len(self.kids)}
        out, at = self.body(HEAD)
        start = out.tell()
        out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at))
        out.write(b"trailer\n" + _written({"Size": len(at) + 1, "Root": Ref(1)}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)
        return out.getvalue()


def page_count(data: bytes) -> int:
    return len(Document(data).pages)


def with_pages(data: bytes, pages: list[int]) -> bytes:
    """A file of the named pages (from 1) in that order; others are ignored, none is an error."""
    doc, out = Document(data), Writer()
    for p in pages:
        if 1 <= p <= len(doc.pages):
            out.page(doc, doc.pages[p - 1])
    if not out.kids:
        raise ValueError("Indica el rango de páginas")
    return out.bytes()


def without_pages(data: bytes, removed: list[int]) -> bytes:
    keep = [p for p in range(1, page_count(data) + 1) if p not in set(removed)]
    if not keep:
        raise ValueError("No puedes eliminar todas las páginas")
    return with_pages(data, keep)


def merged(files: list[bytes]) -> bytes:
    docs, out = [], Writer()
    for k, data in enumerate(files):
        try:
            docs.append(Document(data))
        except ValueError as e:
            raise ValueError(f"Archivo {k + 1}: {e}") from None
    for doc in docs:
        for page in doc.pages:
            out.page(doc, page)
    return out.bytes()


def _piece(data: bytes, before: int, above: int) -> Writer:
    doc, out = Document(data), Writer(before, 1)
    for page in doc.pages:
        out.page(doc, page)
    out.objects[0] = {"Type": Name("Pages"), "Kids": out.kids, "Count": len(out.kids), "Parent": Ref(above)}
    return out


def piece_size(data: bytes) -> tuple[int, int]:
    """Objects and pages of a file's piece() in a merge."""
    out = _piece(data, 0, 0)
    return len(out.objects), len(out.kids)


def piece(data: bytes, before: int, above: int) -> tuple[bytes, list[int]]:
    """A file's pages as objects of a larger file, numbered after `before`, and where each begins; the first is the node of its pages, under the object `above`."""
    out, at = _piece(data, before, above).body()
    return out.getvalue(), at


def piece_text(body: bytes) -> str:
    """Text of a piece()'s pages, joined by an empty line."""
    node = _OBJECT.match(body)
    doc = Document(HEAD + body + (b"0 0 obj\n<< /Type /Catalog /Pages %s 0 R >>\nendobj\n" % node[1] if node else b""))
    return "\n\n".join(page_text(doc, p) for p in doc.pages)


def compressed(data: bytes) -> bytes:
    """All pages rewritten: streams deflated, document information and unused objects gone."""
    doc, out = Document(data), Writer()
    for value in doc.objects.values():
        if isinstance(value, Stream) and not value.info.get("Filter"):
            value.raw, value.info = zlib.compress(value.raw, 9), value.info | {"Filter": Name("FlateDecode")}
    for page in doc.pages:
        out.page(doc, page)
    return out.bytes()


def signed(data: bytes, text: str = "Firmado", every: bool = True, position: str = "abajo") -> bytes:
    """A centred text on all pages or the first; position is arriba, centro or abajo."""
    doc, out = Document(data), Writer()
    shown = text.encode("cp1252", "replace")
    for k, page in enumerate(doc.pages):
        if k and not every:
            out.page(doc, page)
            continue
        x0, y0, x1, y1 = (float(doc.at(v)) for v in (doc.at(page.get("MediaBox")) or [0, 0, 595.28, 841.89]))
        y = {"arriba": y1 - 40, "centro": (y0 + y1) / 2}.get(position, y0 + 30)
        body = b"q 0.2 g BT /Stamp 14 Tf %.2f %.2f Td <%s> Tj ET Q" % ((x0 + x1) / 2 - 3.5 * len(shown), y, shown.hex().encode())
        font = out.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
        out.page(doc, page, Stream({}, body), {"Stamp": font})
    return out.bytes()


def _to_unicode(doc: Document, page: dict) -> dict[str, dict[int, str]]:
    """Character maps of a page's fonts that have one."""
    out = {}
    fonts = doc.at((doc.at(page.get("Resources")) or {}).get("Font")) or {}
    for name, ref in fonts.items():
        cmap = doc.at((doc.at(ref) or {}).get("ToUnicode"))
        if isinstance(cmap, Stream):
            body, table = cmap.decoded(), {}
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
                for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    table[int(a, 16)] = bytes.fromhex(b.decode()).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
                for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    table |= {x: chr(int(c, 16) + x - int(a, 16)) for x in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1)}
            out[name] = table
    return out


def page_text(doc: Document, page: dict) -> str:
    """Text of the showing operators, a line for each change of line."""
    reader, stack, lines, now = Reader(doc.content(page)), [], [], []
    maps, table = _to_unicode(doc, page), None

    def shown(raw: bytes) -> str:
        if table:
            wide = max(table) > 255
            codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if wide else list(raw)
            return "".join(table.get(c, "") for c in codes)
        return bytes(raw).decode("cp1252", "replace")

    def newline() -> None:
        if now:
            lines.append("".join(now))
            now.clear()

    while (token := reader.value()) is not None:
        if not isinstance(token, bytes) or isinstance(token, bytearray):
            stack.append(token)
            continue
        if token == b"Tf" and len(stack) >= 2:
            table = maps.get(str(stack[-2]))
        elif token in (b"T*", b"Td", b"TD", b"Tm", b"ET", b"'", b'"'):
            newline()
        if token in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytearray):
            now.append(shown(stack[-1]))
        elif token == b"TJ" and stack and isinstance(stack[-1], list):
            now.append("".join(shown(x) if isinstance(x, bytearray) else " " if isinstance(x, (int, float)) and x < -200 else "" for x in stack[-1]))
        stack.clear()
    newline()
    return "\n".join(lines)


def to_text(data: bytes) -> str:
    """Pages joined by an empty line; a file without text is an error."""
    doc = Document(data)
    out = "\n\n".join(page_text(doc, p) for p in doc.pages)
    if not out.strip():
        raise ValueError("El PDF no contiene texto seleccionable")
    return out
