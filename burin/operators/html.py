"""Pages as token streams, in the JVM: inventory, removable regions and cleaning of HTML.

One regular expression cuts a page into tokens (elements with raw text are one token with their
content); aggregate() folds them with the state that a token needs: the section that is open and
the place that is reached. A page whose last token has no end cannot be read: its inventory is
empty and a cleaning returns it as it is.

The expressions are written as SQL, which Spark parses at once; each is a lambda of one value
and so computes that value once, however often it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burin.functions import html_tokens as T
from burin.functions.text import JS_SPACE, decode_utf8

ENTRY = "array<struct<ord:int,where:string,key:string,label:string,value:string,sensitivity:string,removal:string,block:string>>"
REGIONS = "array<struct<block:string,start:int,end:int>>"
#: The longest value that the inventory of a page shows, in UTF-16 units.
VALUE_LENGTH = 200
#: How many leftovers a verification names.
SAMPLE = 5
# Relations of links that name an author.
RELATIONS = ("author", "me", "publisher")
#: Attributes of meta and link tags that count.
_READ = ("name", "property", "itemprop", "charset", "http-equiv", "content", "rel", "href")


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _apply(value: Column, name: str, body: str) -> Column:
    """The SQL expression body of a value of that name."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {_lit(f'^{JS_SPACE}+|{JS_SPACE}+$')}, '')"


def _shown(x: str) -> str:
    """White space as single blanks, cut after VALUE_LENGTH units; `Presente` for nothing."""
    text = _trim(f"regexp_replace(coalesce({x}, ''), {_lit(JS_SPACE + '+')}, ' ')")
    head = f"decode(substring(encode(v, 'UTF-16BE'), 1, {2 * VALUE_LENGTH}), 'UTF-16BE')"
    # A pair of units that the cut parts leaves its first half, which is shown as U+FFFD.
    split = f"hex(substring(encode(v, 'UTF-16BE'), {2 * VALUE_LENGTH - 1}, 1)) BETWEEN 'D8' AND 'DB'"
    parted = f"concat(decode(substring(encode(v, 'UTF-16BE'), 1, {2 * VALUE_LENGTH - 2}), 'UTF-16BE'), '\\uFFFD')"
    return _let("v", text, f"CASE WHEN v = '' THEN 'Presente' WHEN octet_length(encode(v, 'UTF-16BE')) <= {2 * VALUE_LENGTH} THEN v ELSE concat(CASE WHEN {split} THEN {parted} ELSE {head} END, '…') END")


def _tags(page: str, places: bool) -> str:
    """Declarations, meta and link tags: array of (token, name, section, start, end), null for a page that cannot be read.

    Without places start and end count tags only, and the text between tags is not looked at.
    """
    pieces = f"regexp_extract_all({page}, {_lit(T.PIECES if places else T.TOKENS)}, 0)"
    kept = "p" if places else f"filter(p, t -> t RLIKE {_lit(T.NAME)})"
    named = f"transform({kept}, t -> named_struct('token', t, 'name', translate(lower(regexp_extract(t, {_lit(T.NAME)}, 1)), ' \\t\\n\\r\\u000b\\f', ''), 'n', length(t)))"
    tag = "named_struct('token', t.token, 'name', t.name, 'section', s.section, 'start', s.at, 'end', s.at + t.n)"
    step = f"""named_struct(
      'section', CASE WHEN t.name IN ('head', 'body') AND NOT endswith(t.token, '/>') THEN t.name WHEN startswith(t.name, '/') THEN '' ELSE s.section END,
      'at', s.at + t.n,
      'tags', CASE WHEN t.name IN ('meta', 'link', '!') THEN concat(s.tags, array({tag})) ELSE s.tags END)"""
    start = "named_struct('section', '', 'at', 0, 'tags', CAST(array() AS array<struct<token:string,name:string,section:string,start:int,end:int>>))"
    return _let("p", pieces, f"CASE WHEN size(p) = 0 OR element_at(p, -1) RLIKE {_lit(T.WHOLE)} THEN aggregate({named}, {start}, (s, t) -> {step}, s -> s.tags) END")


def _seen(found: str) -> str:
    """Meta and link tags with the attributes that count; the first of a name holds, null without one."""
    inner = f"regexp_extract(t.token, {_lit(r'(?s)\A<[^ \t\n\r/>]++(.*)>\z')}, 1)"
    raw = f"regexp_extract(m, {_lit(r'(?s)\A[^=]*+=[ \t\n\r]*+(.*)\z')}, 1)"
    value = _let("r", raw, f"""CASE WHEN startswith(r, '"') THEN regexp_replace(r, {_lit(r'\A"|"\z')}, '') WHEN startswith(r, '\\'') THEN regexp_replace(r, {_lit(r"\A'|'\z")}, '') ELSE r END""")
    pairs = f"transform(regexp_extract_all({inner}, {_lit(T.ATTRIBUTE)}, 0), m -> named_struct('name', lower(regexp_extract(m, {_lit(r'\A[ \t\n\r]*+([^ \t\n\r=/>]*+)')}, 1)), 'value', {value}))"
    first = ", ".join(f"'{n.replace('-', '_')}', get(filter(own, a -> a.name = '{n}'), 0).value" for n in _READ)
    return f"transform(filter({found}, t -> t.name <> '!'), t -> {_let('own', pairs, f'''named_struct('tag', t.name, 'section', t.section, 'start', t.start, 'end', t.end, {first})''')})"


_VIEWPORT = f"(t.tag = 'meta' AND lower({_trim('t.name')}) <=> 'viewport')"
#: struct(attr, key) of a meta tag that carries metadata, null for others.
_KEY = f"""CASE WHEN t.tag = 'meta' AND t.charset IS NULL AND t.http_equiv IS NULL AND NOT {_VIEWPORT}
  THEN coalesce({", ".join(f"CASE WHEN {_trim('t.' + n)} <> '' THEN named_struct('attr', '{n}', 'key', t.{n}) END" for n in ("name", "property", "itemprop"))}) END"""
#: The relation of a link that names an author, null for others.
_RELATION = f"CASE WHEN t.tag = 'link' THEN get(filter(split(lower(coalesce(t.rel, '')), {_lit(JS_SPACE + '+')}), r -> r IN {RELATIONS}), 0) END"


def _entry(where: str, key: str, label: str, value: str, sensitivity: str, removal: str, block: str) -> str:
    return f"named_struct('where', {where}, 'key', {key}, 'label', {label}, 'value', {value}, 'sensitivity', {sensitivity}, 'removal', {removal}, 'block', {block})"


def _entries(page: str) -> str:
    section = "CASE WHEN t.section = '' THEN '' ELSE concat(t.section, ' > ') END"
    meta = _entry(f"concat({section}, 'meta[', k.attr, '=', k.key, ']')", "k.key", "k.key", _shown("t.content"), "CASE WHEN lower(k.key) RLIKE 'author|creator' THEN 'medium' ELSE 'low' END", "'with-container'", "'meta'")
    link = _entry(f"concat({section}, 'link[rel=', k, ']')", "concat('rel:', k)", "concat('Enlace de autoría (', k, ')')", _shown("t.href"), "'medium'", "'with-container'", "'links'")
    never = lambda where, key, label, value: _entry(f"'{where}'", f"'{key}'", f"'{label}'", value, "'low'", "'never'", "'format'")
    typed = f"CASE WHEN lower({_trim('t.http_equiv')}) = 'content-type' THEN nullif(regexp_extract(t.content, {_lit(r'(?i)charset\s*=\s*([^;' + chr(34) + r'\s]+)')}, 1), '') END"
    charset = f"get(filter(transform(seen, t -> CASE WHEN t.tag = 'meta' THEN coalesce(nullif({_trim('t.charset')}, ''), {typed}) END), c -> c IS NOT NULL), 0)"
    doctype = "get(filter(found, t -> t.name = '!'), 0).token"
    fixed = f"""array(
      {_let("k", doctype, f"CASE WHEN k IS NOT NULL THEN {never('documento', 'doctype', 'Tipo de documento', _shown('k'))} END")},
      {_let("k", charset, f"CASE WHEN k IS NOT NULL THEN {never('head > meta[charset]', 'charset', 'Juego de caracteres', 'k')} END")},
      {never('cabecera', 'viewport', 'Viewport', f"CASE WHEN exists(seen, t -> {_VIEWPORT}) THEN 'Sí' ELSE 'No' END")})"""
    every = f"""filter(concat(
      transform(seen, t -> {_let("k", _KEY, f"CASE WHEN k IS NOT NULL THEN {meta} END")}),
      transform(seen, t -> {_let("k", _RELATION, f"CASE WHEN k IS NOT NULL THEN {link} END")}), {fixed}), e -> e IS NOT NULL)"""
    listed = _let("found", _tags(page, False), f"CASE WHEN found IS NOT NULL THEN {_let('seen', _seen('found'), every)} END")
    numbered = f"transform({listed}, (e, i) -> named_struct('ord', i + 1, {', '.join(f'''{chr(39)}{n}{chr(39)}, e.{n}''' for n in ('where', 'key', 'label', 'value', 'sensitivity', 'removal', 'block'))}))"
    return f"coalesce(CASE WHEN length({page}) > 0 THEN {numbered} END, CAST(array() AS {ENTRY}))"


def html_entries(page: Column) -> Column:
    """Inventory of a page: meta tags, authorship links, then doctype, charset and viewport; empty for an empty page or one that cannot be read."""
    return _apply(page, "page", _entries("page")).cast(ENTRY)


def html_regions(page: Column) -> Column:
    """Removable tags of a page: array of (block, start, end) in the page's units; none for a page that cannot be read."""
    block = f"CASE WHEN ({_KEY}) IS NOT NULL THEN 'meta' WHEN ({_RELATION}) IS NOT NULL THEN 'links' END"
    own = f"filter(transform({_seen('found')}, t -> named_struct('block', {block}, 'start', t.start, 'end', t.end)), r -> r.block IS NOT NULL)"
    body = _let("found", _tags("page", True), f"CASE WHEN found IS NOT NULL THEN {own} END")
    return F.coalesce(_apply(page, "page", body), F.array().cast(REGIONS))


_KEPT = """aggregate(
    array_sort(transform(c.regions, r -> named_struct('start', CAST(r.start AS int), 'end', CAST(r.end AS int)))),
    named_struct('reach', 0, 'kept', CAST(array() AS array<struct<start:int,end:int>>)),
    (s, r) -> named_struct(
      'reach', CASE WHEN r.end > greatest(s.reach, r.start) THEN r.end ELSE s.reach END,
      'kept', CASE WHEN r.end > greatest(s.reach, r.start) AND r.start > s.reach THEN concat(s.kept, array(named_struct('start', s.reach, 'end', r.start))) ELSE s.kept END),
    s -> concat(s.kept, array(named_struct('start', s.reach, 'end', octet_length(c.bytes)))))"""


def subtract(content: Column, regions: Column) -> Column:
    """Bytes without the regions (array of start, end): sorted, merged by the furthest end reached, and what lies between put together.

    Regions may overlap, come in any order and reach beyond the bytes; one that does not end after it starts is none. Null bytes or regions give null.
    """
    # ISO-8859-1 has a character for each byte, so bytes survive as text.
    parts = f"transform({_KEPT}, p -> decode(substring(c.bytes, p.start + 1, greatest(p.end - p.start, 0)), 'ISO-8859-1'))"
    return _apply(F.struct(content.alias("bytes"), regions.alias("regions")), "c", f"CASE WHEN c.bytes IS NOT NULL AND c.regions IS NOT NULL THEN encode(array_join({parts}, ''), 'ISO-8859-1') END")


def strip_html(content: Column, blocks: tuple[str, ...] = ("meta", "links")) -> Column:
    """A page's bytes without the tags of the named blocks; every other byte stays."""
    return subtract(content, F.filter(html_regions(F.decode(content, "ISO-8859-1")), lambda r: r["block"].isin(*blocks)))


#: struct(status, remaining, sample) of inventories v.before and v.after: leftovers are removable entries with a value that stand in both.
_VERDICT = _let(
    "rest", "filter(v.before, e -> e.removal <> 'never' AND e.value <> '' AND exists(v.after, a -> a.where = e.where AND a.key = e.key AND a.value = e.value))",
    f"""named_struct('status', CASE WHEN size(v.before) = 0 AND size(v.after) = 0 THEN 'unverifiable' WHEN size(rest) > 0 THEN 'remaining' ELSE 'clean' END,
      'remaining', CAST(size(rest) AS bigint), 'sample', transform(slice(rest, 1, {SAMPLE}), e -> e.label))""",
)


def cleaned_pages(pages: DataFrame, content: str, mode: str = "deep", blocks: tuple[str, ...] = ()) -> DataFrame:
    """Rows with result, status, remaining and sample: pages cleaned and verified. Light mode removes the named blocks, deep mode all; null pages have null results.

    A generator makes the columns, so that a page is cleaned once however many of them are used.
    """
    wanted = ("meta", "links") if mode == "deep" else blocks
    result = strip_html(F.col(content), wanted) if wanted else F.col(content)
    held = pages.select("*", F.inline(F.array(F.struct(result.alias("result")))))
    pair = F.struct(html_entries(decode_utf8(F.col(content))).alias("before"), html_entries(decode_utf8(F.col("result"))).alias("after"))
    verdict = _apply(pair, "v", _VERDICT)
    return held.select("*", F.inline(F.array(F.when(F.col(content).isNotNull(), verdict).otherwise(F.lit(None).cast("struct<status:string,remaining:bigint,sample:array<string>>")))))


# Fixed value: the block of keys at the head of a Markdown text.
FRONTMATTER = r"\A---\r?\n(?>[\s\S]*?\r?\n---(?:\r?\n|\z))"


def strip_frontmatter(content: Column) -> Column:
    """A Markdown text's bytes without its frontmatter (and byte order mark; bad bytes become U+FFFD)."""
    return F.encode(F.regexp_replace(decode_utf8(content), FRONTMATTER, ""), "UTF-8")
