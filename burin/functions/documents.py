"""Conversions of whole documents that need a parser: plain Python, one value in, one out.

Each function takes a text or bytes and gives a text or bytes, or raises ValueError with
a stable message. burin.operators.convert runs them as Arrow functions.
"""

from __future__ import annotations

import html
import io
import itertools
import json
import re
import tomllib
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree


def parse_csv(text: str) -> list[list[str]]:
    """Rows of cells: a quote anywhere toggles quoting, \\r outside quotes goes, rows may be ragged."""
    rows, row, cell, at = [], [], "", 0
    plain = re.compile(r'[^",\r\n]*')
    while at < len(text):
        part = plain.match(text, at)
        cell, at = cell + part[0], part.end()
        if at == len(text):
            break
        mark, at = text[at], at + 1
        if mark == '"':
            while True:
                end = text.find('"', at)
                if end < 0:
                    cell, at = cell + text[at:], len(text)
                    break
                cell, at = cell + text[at:end], end + 1
                if text[at : at + 1] != '"':
                    break
                cell, at = cell + '"', at + 1
        elif mark != "\r":
            row.append(cell)
            cell = ""
            if mark == "\n":
                rows.append(row)
                row = []
    if cell or row:
        rows.append([*row, cell])
    return rows


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        raise ValueError("El archivo no es JSON válido") from None


def _js(value):
    """Numbers as JavaScript writes them; integer-like keys first, in order."""
    if isinstance(value, float):
        return int(value) if value.is_integer() and abs(value) < 1e21 else value
    if isinstance(value, list):
        return [_js(v) for v in value]
    if isinstance(value, dict):
        whole = sorted((k for k in value if re.fullmatch(r"0|[1-9]\d{0,9}", k) and int(k) < 4294967295), key=int)
        return {k: _js(value[k]) for k in [*whole, *(k for k in value if k not in set(whole))]}
    return value


def dumps(value, indent: int | None = 2) -> str:
    return json.dumps(_js(value), ensure_ascii=False, indent=indent, separators=(",", ": ") if indent else (",", ":"))


def csv_to_json(text: str) -> str:
    header, *body = parse_csv(text) or [[]]
    return dumps([{k: (cells[i] if i < len(cells) else "") for i, k in enumerate(header)} for cells in body])


def csv_cell(value) -> str:
    s = value if isinstance(value, str) else "" if value is None else dumps(value, None)
    return '"' + s.replace('"', '""') + '"' if re.search('[",\r\n]', s) else s


def _csv(records: list[dict]) -> str:
    keys = list(dict.fromkeys(k for r in records for k in r))
    return "\n".join([",".join(keys), *(",".join(csv_cell(r.get(k)) for k in keys) for r in records)])


def json_to_csv(text: str) -> str:
    value = _loads(text)
    return _csv([_js(x) for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)])


def json_pretty(text: str) -> str:
    return dumps(_loads(text))


def json_minify(text: str) -> str:
    return dumps(_loads(text), None)


def escape_xml(text: str) -> str:
    return html.escape(text, quote=True).replace("&#x27;", "&apos;")


def _scalar(value) -> str:
    return escape_xml(value if isinstance(value, str) else dumps(value, None))


def _node(name: str, value) -> str:
    tag = escape_xml(name)
    if isinstance(value, list):
        return "".join(_node(name, v) for v in value)
    if isinstance(value, dict):
        return f"<{tag}>{''.join(_node(k, v) for k, v in value.items())}</{tag}>"
    return f"<{tag}/>" if value is None else f"<{tag}>{_scalar(value)}</{tag}>"


def json_to_xml(text: str) -> str:
    value = _js(_loads(text))
    if isinstance(value, list):
        body = "".join(_node("item", v) for v in value)
    else:
        body = "".join(_node(k, v) for k, v in value.items()) if isinstance(value, dict) else _scalar(value)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<root>{body}</root>'


def csv_to_xml(text: str) -> str:
    header, *body = parse_csv(text) or [[]]
    names = [escape_xml(h.strip() or f"col{i + 1}") for i, h in enumerate(header)]
    rows = ["<row>" + "".join(f"<{n}>{escape_xml(c[i] if i < len(c) else '')}</{n}>" for i, n in enumerate(names)) + "</row>" for c in body]
    return '<?xml version="1.0" encoding="UTF-8"?>\n<root>' + "\n".join(rows) + "</root>"


def xml_value(element: ElementTree.Element):
    """An element as attributes `@_name`, `#text` and children, repeated children as lists."""
    out: dict = {f"@_{k}": v for k, v in element.attrib.items()}
    for child in element:
        name, value = child.tag, xml_value(child)
        if name not in out:
            out[name] = value
        elif isinstance(out[name], list):
            out[name].append(value)
        else:
            out[name] = [out[name], value]
    text = "".join([element.text or "", *((c.tail or "") for c in element)]).strip()
    if not out:
        return text
    return out | ({"#text": text} if text else {})


def _xml(text: str) -> dict:
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        raise ValueError("El archivo no es XML válido") from None
    return {root.tag: xml_value(root)}


def xml_to_json(text: str) -> str:
    return dumps(_xml(text))


def _records(value) -> list | None:
    """The first list of records, depth first."""
    if isinstance(value, list):
        if value and all(isinstance(v, dict) for v in value):
            return value
        return next((r for v in value if (r := _records(v))), None)
    return next((r for v in value.values() if (r := _records(v))), None) if isinstance(value, dict) else None


def xml_to_csv(text: str) -> str:
    if not (found := _records(_xml(text))):
        raise ValueError("No se encontraron registros en el XML")
    return _csv(found)


def toml_to_json(text: str) -> str:
    try:
        return dumps(json.loads(json.dumps(tomllib.loads(text), default=str)))
    except tomllib.TOMLDecodeError:
        raise ValueError("El archivo no es TOML válido") from None


def _toml_key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k, ensure_ascii=False)


def _toml_value(v) -> str:
    if isinstance(v, dict):
        return "{ " + ", ".join(f"{_toml_key(k)} = {_toml_value(x)}" for k, x in v.items()) + " }"
    if isinstance(v, list):
        return "[ " + ", ".join(map(_toml_value, v)) + " ]"
    if v is None:
        raise ValueError("El JSON no se puede representar en TOML")
    return json.dumps(v, ensure_ascii=False)


def json_to_toml(text: str) -> str:
    value = _loads(text)
    if not isinstance(value, dict):
        raise ValueError("El JSON no se puede representar en TOML")
    lines: list[str] = []

    def table(prefix: str, t: dict) -> None:
        plain = {k: v for k, v in t.items() if not isinstance(v, dict) and not (isinstance(v, list) and v and all(isinstance(x, dict) for x in v))}
        if prefix and (plain or not t):
            lines.append(f"[{prefix}]")
        lines.extend(f"{_toml_key(k)} = {_toml_value(v)}" for k, v in plain.items())
        for k, v in t.items():
            path = f"{prefix}.{_toml_key(k)}" if prefix else _toml_key(k)
            if isinstance(v, dict):
                lines.append("")
                table(path, v)
            elif k not in plain:
                for item in v:
                    lines.extend(["", f"[[{path}]]"])
                    lines.extend(f"{_toml_key(a)} = {_toml_value(b)}" for a, b in item.items())

    table("", value)
    return "\n".join(lines).strip("\n") + "\n"


def _yaml():
    import yaml

    class Core(yaml.SafeLoader):
        """The 1.2 core schema: only true/false and null words, no dates or octal."""

    Core.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("int", r"^[-+]?[0-9]+$", "-+0123456789"),
        ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", "-+.0123456789"),
    ):
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))
    return yaml, Core


def yaml_to_json(text: str) -> str:
    yaml, core = _yaml()
    try:
        return dumps(json.loads(json.dumps(yaml.load(text, core), default=str)))
    except yaml.YAMLError:
        raise ValueError("El archivo no es YAML válido") from None


def json_to_yaml(text: str) -> str:
    yaml, _ = _yaml()
    return yaml.safe_dump(_js(_loads(text)), allow_unicode=True, sort_keys=False, default_flow_style=False)


def _ts(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, list):
        return f"{_ts(value[0])}[]" if value else "unknown[]"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        inner = "\n    ".join(f"{k}: {_ts(v)}" for k, v in value.items())
        return f"{{\n    {inner}\n  }}" if value else "Record<string, unknown>"
    return "number"


def json_to_ts(text: str) -> str:
    value = _js(_loads(text))
    if isinstance(value, list):
        return f"type Root = {_ts(value[0])}[]" if value else "type Root = unknown[]"
    if not isinstance(value, dict):
        return f"type Root = {_ts(value)}"
    body = "\n".join(f"  {k}: {_ts(v)}" for k, v in value.items())
    return f"interface Root {{\n{body}\n}}\n\nexport default Root" if value else "interface Root {}\n\nexport default Root"


# Inline Markdown in the order in which it applies.
_INLINE = ((r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), (r"__([^_]+)__", r"<strong>\1</strong>"), (r"\*([^*]+)\*", r"<em>\1</em>"), (r"_([^_]+)_", r"<em>\1</em>"), (r"`([^`]+)`", r"<code>\1</code>"))


def _inline(text: str) -> str:
    for pattern, by in _INLINE:
        text = re.sub(pattern, by, text)
    return text


def _line_kind(line: str) -> str:
    return "heading" if re.match(r"#{1,6}\s", line) else "item" if re.match(r"\s*[-*+]\s", line) else "text"


def _prose_html(lines: list[str]) -> Iterator[str]:
    """Headings and paragraphs line by line, neighbouring list items as one list."""
    for kind, group in itertools.groupby(lines, _line_kind):
        if kind == "item":
            items = [_inline(re.sub(r"^\s*[-*+]\s+", "", line)) for line in group]
            yield "<ul>\n" + "\n".join(f"  <li>{i}</li>" for i in items) + "\n</ul>"
            continue
        for line in group:
            marks = len(line) - len(line.lstrip("#")) if kind == "heading" else 0
            if marks:
                yield f"<h{marks}>{line[marks:].lstrip()}</h{marks}>"
            elif line.strip():
                yield f"<p>{_inline(line)}</p>"


def md_body_to_html(escaped: str) -> str:
    """Escaped Markdown as HTML: fences part it into prose and code in turn, the last code may be open."""
    lines = re.split(r"\r?\n", escaped)
    fences = [i for i, line in enumerate(lines) if line.lstrip().startswith("```")]
    blocks: list[str] = []
    for k, (before, end) in enumerate(itertools.pairwise([-1, *fences, len(lines)])):
        part = lines[before + 1 : end]
        if k % 2 == 0:
            blocks += _prose_html(part)
        elif part:
            blocks.append("<pre><code>" + "\n".join(part) + "</code></pre>")
    return "\n".join(blocks)


def md_to_html(text: str, name: str = "documento") -> str:
    text = re.sub(r"\A---\r?\n[\s\S]*?\r?\n---\r?\n?", "", text)
    heading = re.search(r"^#{1,6}\s+(.+)$", text, re.M)
    title = html.escape(heading[1].strip()) if heading else name
    escaped = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    return "\n".join(["<!doctype html>", '<html lang="es">', "<head>", '  <meta charset="utf-8">', f"  <title>{title}</title>", "</head>", "<body>", md_body_to_html(escaped), "</body>", "</html>"])


class _ToMarkdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.href: list[str] = []
        self.lists: list[list] = []
        self.skip = self.pre = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("  \n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "hr":
            self.out.append("\n\n* * *\n\n")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "img":
            at = dict(attrs)
            self.out.append(f"![{at.get('alt') or ''}]({at.get('src') or ''})")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n\n" if len(self.lists) == 1 else "")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "    " * max(0, len(self.lists) - 1) + ("*   " if kind[0] == "ul" else f"{kind[1]}.  "))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n\n" if not self.lists else "")
        elif tag[:1] == "h" and tag[1:].isdigit() or tag in ("p", "div", "blockquote"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_md(text: str) -> str:
    parser = _ToMarkdown()
    parser.feed(text)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n(?!\n)", lambda m: m[0] if m[0] == "  \n" else "\n", "".join(parser.out))).strip()


def wrap_text(text: str, width: int = 90) -> list[str]:
    """Greedy lines of at most `width` characters; longer words are split, blank lines stay."""
    out: list[str] = []
    for line in re.split(r"\r?\n", text):
        now = ""
        for word in line.split():
            while len(word) > width:
                if now:
                    out.append(now)
                    now = ""
                out.append(word[:width])
                word = word[width:]
            if word and now and len(now) + 1 + len(word) > width:
                out.append(now)
                now = word
            else:
                now = f"{now} {word}".strip() if word else now
        out.append(now)
    return out


def pdf_of_pages(pages: list[list[str]]) -> bytes:
    """A minimal PDF: A4, Helvetica 11, leading 14.2, margin 48, one content stream a page."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for lines in pages:
        shown = [line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for line in lines]
        stream = zlib.compress(b"BT /F1 11 Tf 14.2 TL 48 782 Td\n" + b"\n".join(b"(" + s + b") Tj T*" for s in shown) + b"\nET")
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595.28 841.89] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids)
    out, at = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    for i, body in enumerate(objects):
        at.append(out.tell())
        out.write(b"%d 0 obj\n" % (i + 1) + body + b"\nendobj\n")
    start = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at))
    out.write(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))
    return out.getvalue()


def txt_to_pdf(text: str, width: int = 90, lines_a_page: int = 48) -> bytes:
    lines = wrap_text(text, width)
    return pdf_of_pages([lines[i : i + lines_a_page] for i in range(0, len(lines), lines_a_page)] or [[]])


def _unzipped(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError):
        raise ValueError("El archivo no es un ZIP válido") from None


def _part(package: zipfile.ZipFile, name: str) -> str:
    try:
        return package.read(name).decode("utf-8", "replace")
    except KeyError:
        raise ValueError(f"Falta {name}") from None


def _entities(text: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = text.replace(a, b)
    return text


def docx_to_txt(content: bytes) -> str:
    """A line a paragraph, without XML's white space at either end; other spaces are text."""
    body = re.sub(r"</w:p>", "\n", _part(_unzipped(content), "word/document.xml"))
    return _entities(re.sub(r"<[^>]+>", "", body)).strip(" \n\t\r")


def odt_to_txt(content: bytes) -> str:
    body = re.sub(r"</text:(?:p|h)>", "\n", _part(_unzipped(content), "content.xml"))
    return _entities(re.sub(r"<[^>]+>", "", body)).strip()


def pptx_to_txt(content: bytes) -> str:
    package = _unzipped(content)
    slides = sorted((int(m[1]), n) for n in package.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return "\n\n".join(f"— Slide {k} —\n" + _entities(" ".join(re.findall(r"<a:t[^>]*>([^<]*)</a:t>", _part(package, n)))) for k, n in slides)


def epub_to_txt(content: bytes) -> str:
    package, out = _unzipped(content), []
    for name in sorted(n for n in package.namelist() if re.search(r"\.x?html?$", n, re.I)):
        body = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", _part(package, name))
        body = re.sub(r"(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr|section)>", "\n", body)
        out.append(f"— {name} —\n" + re.sub(r"\n\s*\n+", "\n", _entities(re.sub(r"<[^>]+>", "", body))).strip())
    return "\n\n".join(out)


def xlsx_rows(content: bytes) -> list[list]:
    """Cells of the first sheet as texts, numbers, booleans and None; gaps are filled by their references."""
    package = _unzipped(content)
    shared = []
    if "xl/sharedStrings.xml" in package.namelist():
        shared = [_entities("".join(re.findall(r"<t[^>]*>([^<]*)</t>", si))) for si in re.findall(r"(?s)<si\b[^>]*>(.*?)</si>", _part(package, "xl/sharedStrings.xml"))]
    rows = []
    for row in re.findall(r"(?s)<row\b(?:[^>]*[^/])?>(.*?)</row>", _part(package, "xl/worksheets/sheet1.xml")):
        cells: list = []
        for attributes, body in re.findall(r"(?s)<c\b((?:[^>]*[^/])?)>(.*?)</c>", re.sub(r"<c\b([^>]*)/>", r"<c\1></c>", row)):
            ref = re.search(r'\br="([A-Z]+)\d+"', attributes)
            if ref:
                column = 0
                for ch in ref[1]:
                    column = column * 26 + ord(ch) - 64
                cells += [None] * (column - 1 - len(cells))
            kind = re.search(r'\bt="(\w+)"', attributes)
            value = re.search(r"(?s)<v[^>]*>(.*?)</v>", body)
            if kind and kind[1] == "s":
                k = int(value[1]) if value else -1
                cells.append(shared[k] if 0 <= k < len(shared) else None)
            elif kind and kind[1] == "inlineStr":
                cells.append(_entities("".join(re.findall(r"<t[^>]*>([^<]*)</t>", body))))
            elif not value or (kind and kind[1] == "e"):
                cells.append(None)
            elif kind and kind[1] == "b":
                cells.append(value[1].strip() not in ("0", "false"))
            elif kind and kind[1] in ("str", "d"):
                cells.append(_entities(value[1]))
            else:
                cells.append(_number(value[1]))
        rows.append(cells)
    return rows


def _number(text: str):
    try:
        value = float(text)
    except ValueError:
        return _entities(text)
    return value if abs(value) < 1e308 else text


def xlsx_to_csv(content: bytes) -> str:
    shown = lambda v: ("TRUE" if v else "FALSE") if isinstance(v, bool) else csv_cell(v)
    return "\n".join(",".join(map(shown, row)) for row in xlsx_rows(content))


def xlsx_to_json(content: bytes) -> str:
    """A record a row with any cell: numbers and booleans as such, empty cells left out, names made for columns without one or with one that stands before."""
    header, *body = xlsx_rows(content) or [[]]
    width, names = max((len(r) for r in [header, *body]), default=0), []
    for h in header + [None] * (width - len(header)):
        stem = "__EMPTY" if h in (None, "") else ("TRUE" if h else "FALSE") if isinstance(h, bool) else h if isinstance(h, str) else dumps(h)
        name, n = stem, 0
        while name in names:
            n += 1
            name = f"{stem}_{n}"
        names.append(name)
    records = ({k: v for k, v in zip(names, row, strict=False) if v is not None} for row in body)
    return dumps([r for r in records if r])


def rows_to_xlsx(rows: list[list], sheet: str = "Datos") -> bytes:
    """A workbook of one sheet; texts, numbers and booleans keep their types, None is no cell."""

    def cell(v, at: str) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{dumps(v)}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape_xml(v)}</t></is></c>'

    def column(i: int) -> str:
        return (column(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    body = "".join(f'<row r="{n}">' + "".join(cell(v, f"{column(i)}{n}") for i, v in enumerate(r)) + "</row>" for n, r in enumerate(rows, 1))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape_xml(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    return _zip([(n, ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + p).encode()) for n, p in parts.items()])


def csv_to_xlsx(text: str) -> bytes:
    """Cells that are written as numbers or as TRUE and FALSE become such, empty ones no cell; numbers of over 15 digits stay texts, so that none is lost."""

    def typed(v: str):
        if re.fullmatch(r"[-+]?(?=[.]?\d)\d{0,15}(?:\.\d{0,15})?(?:[eE][-+]?\d{1,2})?", v):
            return float(v)
        return {"": None, "TRUE": True, "FALSE": False}.get(v, v)

    return rows_to_xlsx([list(map(typed, row)) for row in parse_csv(text)])


def json_to_xlsx(text: str) -> bytes:
    value = _js(_loads(text))
    records = [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
    keys = list(dict.fromkeys(k for r in records for k in r))
    plain = lambda v: dumps(v, None) if isinstance(v, (dict, list)) else v
    return rows_to_xlsx([keys, *([plain(r.get(k)) for k in keys] for r in records)])


def txt_to_docx(text: str) -> bytes:
    """One paragraph a line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape_xml(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    kinds = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    parts = [
        ("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{kinds}"/></Types>'),
        ("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'),
        ("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'),
    ]
    return _zip([(n, ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + p).encode()) for n, p in parts])


def _zip(parts: list[tuple[str, bytes]]) -> bytes:
    """A package with fixed dates; `mimetype` first and stored, the others in order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in sorted(parts, key=lambda p: p[0] != "mimetype"):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            z.writestr(info, body, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def zip_manifest(content: bytes) -> str:
    return "\n".join(f"{i.filename} | {i.file_size}" for i in _unzipped(content).infolist())


# RTF control words that stand for text.
_RTF_WORDS = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def rtf_to_txt(text: str) -> str:
    """Plain text by control words and escapes; destinations are not dropped."""

    def control(m: re.Match) -> str:
        if m[1]:
            return bytes([int(m[1], 16)]).decode("cp1252", "replace")
        if m[2]:
            return chr(int(m[2]) % 65536)
        return _RTF_WORDS.get(m[3], "") if m[3] else m[4]

    out = re.sub(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+)\s?\??|\\([a-zA-Z]+)-?\d*\s?|\\([\\{}])", control, text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<!\\)[{}]", "", out)).strip()


def md_plain(text: str) -> str:
    """Markdown without its marks, by the rules that the column expression has."""
    from burin.functions.text import JS_SPACE, MARKDOWN_RULES

    space = JS_SPACE.replace(r"\x{", r"\u").replace("}", "")
    text = re.sub(r"\A---\r?\n[\s\S]*?\r?\n---\r?\n?", "", text)
    for pattern, by in MARKDOWN_RULES:
        text = re.sub(pattern.replace(JS_SPACE, space), by.replace("$1", r"\1").replace("$2", r"\2"), text)
    return text


def html_plain(text: str) -> str:
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>"):
        text = re.sub(pattern, " ", text)
    return " ".join(_entities(text).split())


def docx_to_html(content: bytes) -> str:
    """Paragraphs, headings, list items, bold and italic runs."""
    body, out = _part(_unzipped(content), "word/document.xml"), []
    for paragraph in re.findall(r"(?s)<w:p\b(?:[^>]*[^/])?>(.*?)</w:p>", body):
        style = re.search(r'<w:pStyle w:val="[^"\d]*(\d?)"', paragraph)
        runs = []
        for run in re.findall(r"(?s)<w:r\b[^>]*>(.*?)</w:r>", paragraph):
            text = html.escape(_entities("".join(re.findall(r"<w:t\b[^>]*>([^<]*)</w:t>", run))), quote=False)
            text = f"<em>{text}</em>" if re.search(r"<w:i(?:/|\s)", run) else text
            runs.append(f"<strong>{text}</strong>" if re.search(r"<w:b(?:/|\s)", run) else text)
        tag = "li" if "<w:numPr>" in paragraph else f"h{style[1]}" if style and style[1] else "p"
        if line := "".join(runs):
            out.append(f"<{tag}>{line}</{tag}>")
    return re.sub(r"((?:<li>.*?</li>)+)", r"<ul>\1</ul>", "".join(out))


def pdf_to_txt(content: bytes) -> str:
    from burin.functions import pdf

    return pdf.to_text(content)


def pdf_to_csv(content: bytes) -> str:
    """One cell a line of the text."""
    return "\n".join(csv_cell(line) for line in pdf_to_txt(content).split("\n"))


def pdf_to_docx(content: bytes) -> bytes:
    return txt_to_docx(pdf_to_txt(content))


def docx_to_pdf(content: bytes) -> bytes:
    return txt_to_pdf(docx_to_txt(content))


def pptx_to_pdf(content: bytes) -> bytes:
    return txt_to_pdf(pptx_to_txt(content))


def md_to_pdf(text: str) -> bytes:
    return txt_to_pdf(md_plain(text))


def html_to_pdf(text: str) -> bytes:
    return txt_to_pdf(html_plain(text))
