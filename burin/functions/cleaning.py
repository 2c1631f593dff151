"""What a cleaning removes: blocks of metadata by kind, light and deep mode, risks, and verification.

Light mode removes the named blocks and leaves every other byte as it is; without a named
block the file is the same. Deep mode removes every block.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib

from burin.functions import media

# The removable blocks of each kind, in the order in which they are shown.
BLOCKS: dict[str, tuple[tuple[str, str], ...]] = {
    "pdf": (("info", "Información del documento"), ("xmp", "Metadatos XMP")),
    "docx": (("props", "Propiedades del documento"), ("custom", "Propiedades personalizadas"), ("comments", "Comentarios y revisores"), ("thumb", "Miniatura")),
    "md": (("frontmatter", "Frontmatter YAML"),),
    "html": (("meta", "Metadatos <meta>"), ("links", "Enlaces de autoría")),
    "png": (("exif", "Datos de cámara (EXIF/GPS)"), ("xmp", "Metadatos XMP"), ("text", "Texto y comentarios")),
    "jpg": (("exif", "Datos de cámara (EXIF/GPS)"), ("xmp", "Metadatos XMP"), ("text", "Texto y comentarios")),
    "webp": (("exif", "Datos de cámara (EXIF/GPS)"), ("xmp", "Metadatos XMP")),
    "gif": (("text", "Comentarios"), ("xmp", "Metadatos XMP")),
    "tiff": (("exif", "Datos de cámara (EXIF/GPS)"),),
    "mp3": (("id3v2", "Etiqueta ID3v2"), ("id3v1", "Etiqueta ID3v1"), ("ape", "Etiqueta APEv2"), ("lyrics", "Letras (Lyrics3)")),
    "flac": (("vorbis", "Comentarios Vorbis"), ("pictures", "Imágenes incrustadas")),
    "wav": (("info", "Información del archivo (LIST/INFO)"), ("tech", "Datos de producción")),
    "svg": (("metadata", "Metadatos del documento (RDF)"), ("title", "Título y descripción"), ("comments", "Comentarios e instrucciones"), ("editor", "Datos del editor")),
    "rtf": (("info", "Información del documento"), ("generator", "Generador")),
    "odt": (("meta", "Metadatos del documento"), ("settings", "Ajustes de usuario y vista"), ("thumb", "Miniatura")),
    "epub": (("metadata", "Metadatos del OPF"), ("sidecars", "Sidecars de lectura/tienda")),
}
BLOCKS |= {"xlsx": BLOCKS["docx"], "pptx": BLOCKS["docx"]}
# Kinds without metadata of their own, which pass through.
PLAIN = ("txt", "csv", "json", "xml", "yaml", "toml")
# Parts of an office package by block.
_PARTS = {
    "props": re.compile(r"^docProps/(?:core|app)\.xml$"), "custom": re.compile(r"^(?:docProps/custom\.xml$|customXml/)"),
    "comments": re.compile(r"(?i)^(?!docProps/).*(?:comment|people\.xml|person\.xml)"), "thumb": re.compile(r"(?i)thumbnail"),
}
_MACROS = re.compile(r"(?i)vbaProject|vbaData")
_FRONTMATTER = re.compile(r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)")
# Heads of APP1 segments that carry metadata.
_APP1 = ((b"Exif\0\0", "exif"), (b"http://ns.adobe.com/xap/1.0/\0", "xmp"), (b"http://ns.adobe.com/xmp/extension/\0", "xmp"))
_UNREADABLE = (ValueError, IndexError, KeyError, TypeError, AttributeError, RecursionError, OSError, struct.error, zlib.error, zipfile.BadZipFile)


def regions(data: bytes, kind: str) -> list[tuple[str, int, int]]:
    """(block, start, end) of what a cleaning by blocks may cut out of a file."""
    if kind == "html":
        return list(media.html_removable(data))
    if kind == "png":
        names = {b"eXIf": "exif", b"tEXt": "text", b"zTXt": "text", b"iTXt": "text", b"tIME": "text"}
        xmp = lambda a: data[a + 8 :].startswith(b"XML:com.adobe.xmp\0")
        return [("xmp" if k == b"iTXt" and xmp(a) else names[k], a, b) for k, a, b in media.png_chunks(data) if k in names]
    if kind == "jpg":
        out = []
        for marker, a, b in media.jpeg_segments(data):
            if marker == 0xFE:
                out.append(("text", a, b))
            elif marker == 0xE1:
                own = next((block for head, block in _APP1 if data.startswith(head, a + 4, b)), None)
                out += [(own, a, b)] if own else []
        return out
    if kind == "gif":
        return [("xmp" if k == "xmp" else "text", a, b) for k, a, b in media.gif_blocks(data) if k in ("comment", "plain text", "xmp")]
    if kind == "mp3":
        out = [("id3v2", 0, end)] if (end := media.id3_region(data)) else []
        if ape := media.ape_region(data):
            out.append(("ape", *ape))
        tail = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
        if tail < len(data):
            out.append(("id3v1", tail, len(data)))
        if data[tail - 9 : tail] == b"LYRICS200" and data[tail - 15 : tail - 9].isdigit():
            out.append(("lyrics", max(0, tail - 15 - int(data[tail - 15 : tail - 9])), tail))
        return out
    if kind == "rtf":
        return media.rtf_groups(data)
    if kind == "wav":
        tech = (b"bext", b"iXML", b"cue ", b"acid", b"smpl", b"JUNK")
        return [("info" if k == b"LIST" else "tech", a, b) for k, a, b in media.riff_chunks(data) if k in tech or k == b"LIST" and data[a + 8 : a + 12] == b"INFO"]
    return []


def _svg(data: bytes, blocks: tuple[str, ...]) -> bytes:
    text = media._svg(data)
    if text is None:
        return data

    def of(m: re.Match) -> str:
        body = m[0]
        block = "comments" if body.startswith(("<!--", "<?")) else "title" if m[1] else "editor" if m[2] else "metadata"
        return "" if block in blocks else body

    text = media._SVG_GONE.sub(of, text)
    return (media._SVG_ATTRIBUTES.sub("", text) if "editor" in blocks else text).encode()


def _office(data: bytes, blocks: tuple[str, ...], deep: bool) -> bytes:
    """The package without the parts of the blocks, and of macros in deep mode; what refers to them goes too."""
    package, out = zipfile.ZipFile(io.BytesIO(data)), io.BytesIO()
    dropped = {n for n in package.namelist() if any(_PARTS[b].search(n) for b in blocks if b in _PARTS) or deep and _MACROS.search(n)}
    if not dropped:
        return data
    with zipfile.ZipFile(out, "w") as z:
        for item in package.infolist():
            if item.filename in dropped:
                continue
            body = package.read(item.filename)
            if item.filename.endswith(".rels") or item.filename == "[Content_Types].xml":
                folder = item.filename.rsplit("/_rels/", 1)[0] if "/_rels/" in item.filename else ""

                def kept(m: re.Match, folder: str = folder) -> bytes:
                    target = m[1].decode("utf-8", "replace").lstrip("/")
                    return b"" if {target, f"{folder}/{target}".strip("/")} & dropped else m[0]

                body = re.sub(rb"<(?:Relationship|Override)\b[^>]*?\b(?:Target|PartName)=\"([^\"]*)\"[^>]*/>", kept, body)
            z.writestr(zipfile.ZipInfo(item.filename, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _flac(data: bytes, blocks: tuple[str, ...]) -> bytes:
    found = media.flac_blocks(data)
    gone = {4: "vorbis", 6: "pictures"}
    kept = [(k, a, b) for k, a, b in found if gone.get(k) not in blocks]
    if len(kept) == len(found) or not kept:
        return data
    last = len(kept) - 1
    return b"fLaC" + b"".join(bytes([k | (0x80 if i == last else 0)]) + data[a + 1 : b] for i, (k, a, b) in enumerate(kept)) + data[found[-1][2] :]


def frontmatter(text: str) -> tuple[list[tuple[str, str]], str]:
    """(keys and values, text after them) of a text that begins with a frontmatter."""
    m = _FRONTMATTER.match(text)
    if not m:
        return [], text
    pairs = [(p[1].strip(), p[2].strip()) for line in re.split(r"\r?\n", m[1]) if (p := re.match(r"\s*([^:]+):\s*(.*?)\s*$", line)) and p[1].strip()]
    return pairs, text[m.end() :]


def clean(data: bytes, kind: str, mode: str = "deep", blocks: tuple[str, ...] = ()) -> bytes:
    """A file cleaned; kinds that no cleaning is known for raise ValueError, unreadable files stay as they are."""
    if not data:
        raise ValueError("Se necesita un archivo")
    if kind in PLAIN:
        return data
    if kind != "md" and kind not in media.STRIPPERS:
        raise ValueError("La limpieza de metadata para este formato llega en una fase próxima")
    if mode == "light" and not blocks:
        return data
    own = tuple(b for b, _ in BLOCKS.get(kind, ()))
    wanted = own if mode == "deep" else tuple(b for b in blocks if b in own)
    try:
        if kind == "md":
            text = data.decode("utf-8", "replace")
            return frontmatter(text)[1].encode() if "frontmatter" in wanted else data
        if kind in ("docx", "xlsx", "pptx"):
            return _office(data, wanted, mode == "deep")
        if mode == "deep":
            return media.STRIPPERS[kind](data)
        if kind == "svg":
            return _svg(data, wanted)
        if kind == "flac":
            return _flac(data, wanted)
        if kind == "jpg" and "exif" in wanted:
            turned = media.strip_jpeg(data)  # keeps the orientation; what was not asked for comes back
            back = b"".join(data[a:b] for block, a, b in regions(data, kind) if block not in wanted)
            return turned[:2] + back + turned[2:]
        cut = [(a, b) for block, a, b in regions(data, kind) if block in wanted]
        if kind in ("html", "png", "jpg", "gif", "mp3", "rtf"):
            return media.cut(data, cut)
        if kind == "wav":
            out = bytearray(media.cut(data, cut))
            struct.pack_into("<I", out, 4, len(out) - 8)
            return bytes(out)
    except _UNREADABLE:
        return data
    if own and set(wanted) == set(own):
        return media.strip(data, kind)
    raise ValueError("Este formato solo se limpia entero")


def risks(data: bytes, kind: str) -> list[tuple[str, str, str, str, str]]:
    """(id, label, detail, severity, mode) of what a cleaning would lose besides metadata."""
    out = []
    try:
        if kind == "pdf":
            out = _pdf_risks(data)
        elif kind in ("docx", "xlsx", "pptx"):
            if any(_MACROS.search(n) for n in zipfile.ZipFile(io.BytesIO(data)).namelist()):
                out.append(("office-macros", "Macros", "El modo profundo elimina las macros del documento (vbaProject).", "high", "deep"))
        elif kind == "webp" and b"ANMF" in [k for k, _, _ in media.riff_chunks(data)]:
            out.append(("webp-animated", "WebP animado", "El modo profundo conserva solo el primer fotograma del WebP animado.", "medium", "deep"))
        elif kind in ("jpg", "png") and any(e[1] == "Orientation" and e[2] not in ("", "1") for e in media.scan(data, kind)):
            detail = "Al permitir modificar el archivo, la imagen se re-codifica (puede perder algo de calidad) y se elimina toda la metadata residual; la orientación se conserva. El modo ligero no re-codifica."
            out.append(("image-reencode", "Re-codificación de la imagen", detail, "medium", "deep"))
    except _UNREADABLE:
        return out
    return out


def _pdf_risks(data: bytes) -> list[tuple[str, str, str, str, str]]:
    """Forms, signatures, links, annotations and outlines, by the objects of a document."""
    from burin.functions import pdf

    doc = pdf.Document(data)
    dicts = [v for v in doc.objects.values() if isinstance(v, dict)]
    out = []
    form = next((v for v in dicts if isinstance(v.get("Fields"), list)), None)
    if form and form["Fields"]:
        n = len(form["Fields"])
        out.append(("pdf-forms", "Formularios", f"El modo profundo elimina los formularios rellenables ({n} {'campo' if n == 1 else 'campos'}).", "high", "deep"))
    if form and ("SigFlags" in form or any(v.get("FT") == "Sig" for v in dicts)):
        out.append(("pdf-signatures", "Firmas digitales", "El modo profundo elimina las firmas digitales del documento.", "high", "deep"))
    notes = [v for v in dicts if v.get("Subtype") in ("Link", "Text", "Widget", "Highlight", "FreeText", "Popup", "Underline", "Stamp", "Ink") and "Rect" in v]
    links = sum(v.get("Subtype") == "Link" for v in notes)
    if links:
        out.append(("pdf-links", "Enlaces", f"El modo profundo elimina los enlaces seleccionables ({links} {'enlace' if links == 1 else 'enlaces'}).", "medium", "deep"))
    if notes:
        out.append(("pdf-annotations", "Anotaciones", f"El modo profundo elimina las anotaciones y comentarios ({len(notes)}).", "medium", "deep"))
    if any("Outlines" in v for v in dicts):
        out.append(("pdf-outlines", "Marcadores", "El modo profundo elimina los marcadores (índice del documento).", "medium", "deep"))
    return out


def entries(data: bytes | None, kind: str) -> list[media.Entry]:
    """The inventory of a file, Markdown and HTML tags included."""
    if kind == "md":
        return [("frontmatter", k, media.shown(v), "medium", "with-container") for k, v in frontmatter((data or b"").decode("utf-8", "replace"))[0]]
    if kind == "html" and data:
        tags = [(block, block, media.shown(data[a:b].decode("utf-8", "replace")), "medium", "with-container") for block, a, b in media.html_removable(data)]
        return [*tags, ("cabecera", "viewport", "", "low", "never")] if media.html_readable(data) else []
    return media.scan(data, kind)


def verdict(before: list[media.Entry], after: list[media.Entry], most: int = 5) -> tuple[str, int, list[str]]:
    """(status, leftovers, first labels): a leftover is a removable entry with a value that stands in both."""
    if not before and not after:
        return "unverifiable", 0, []
    still = {e[:3] for e in after}
    left = [e for e in before if e[4] != "never" and e[2] != "" and e[:3] in still]
    return ("remaining" if left else "clean"), len(left), [e[1] for e in left[:most]]
