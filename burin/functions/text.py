"""Text and encoding conversions as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of JavaScript's \s and trim, as a Java regular expression class.
JS_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: The characters of JS_SPACE.
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# JS_SPACE with one comparison, not one a range, for a character that is neither Latin nor a space.
_QUICK_SPACE = r"[\t\n\x0B\f\r \x{00A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def js_trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def ext_of(name: Column) -> Column:
    """Lower-case extension after the last dot; empty for dot-files and names without one."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def base_name(name: Column) -> Column:
    stripped = F.regexp_replace(name, r"\.[^.]+$", "")
    return F.when(stripped == "", F.lit("documento")).otherwise(stripped)


UNITS = ("B", "KB", "MB", "GB", "TB")


def format_bytes(n: Column, units: tuple[str, ...] = UNITS) -> Column:
    """Base 1024, one decimal without a trailing .0, in the last of the units from there on; nothing positive is `0 B`."""
    step = F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0))), F.lit(len(units) - 1)).cast("int")
    value = n / F.pow(F.lit(1024.0), step)
    unit = F.element_at(F.array(*map(F.lit, units)), step + 1)
    shown = F.when(step == 0, n.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.1f", value), r"\.0$", ""))
    return F.when(n > 0, F.concat(shown, F.lit(" "), unit)).otherwise("0 B")


def decode_utf8(content: Column) -> Column:
    """Bytes as text: bad bytes become U+FFFD, a leading byte order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^\x{FEFF}", "")


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("long")


def word_count(x: Column) -> Column:
    return let(js_trim(x), lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"{_QUICK_SPACE}+"))).cast("long"))


def line_count(x: Column) -> Column:
    return F.when(x == "", F.lit(0)).otherwise(F.size(F.split(x, r"\r?\n"))).cast("long")


def reading_time(words: Column) -> Column:
    minutes = words / 200
    return F.when(minutes < 1, F.lit("<1 min")).otherwise(F.concat(F.lit("~"), F.floor(minutes + 0.5).cast("string"), F.lit(" min")))


def text_stats(x: Column) -> Column:
    lines = lambda words: F.concat(F.lit("Caracteres: "), utf16_length(x).cast("string"), F.lit("\nPalabras: "), words.cast("string"), F.lit("\nLíneas: "), line_count(x).cast("string"), F.lit("\nTiempo de lectura: "), reading_time(words))
    return let(word_count(x), lines)


def _replaced(x: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


# Entities in the order in which they are replaced.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
XML_ESCAPES = (*HTML_ESCAPES[:4], ("'", "&apos;"))
UNESCAPES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def html_escape(x: Column) -> Column:
    return _replaced(x, HTML_ESCAPES)


def xml_escape(x: Column) -> Column:
    return _replaced(x, XML_ESCAPES)


def unescape(x: Column) -> Column:
    return _replaced(x, UNESCAPES)


def url_encode(x: Column) -> Column:
    """encodeURIComponent."""
    return _replaced(F.url_encode(x), (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")))


def url_decode(x: Column) -> Column:
    """decodeURIComponent; null where it would fail."""
    return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def rot13(x: Column) -> Column:
    turn = lambda s: s[13:] + s[:13]
    return F.translate(x, UPPER + LOWER, turn(UPPER) + turn(LOWER))


def base64_encode(content: Column) -> Column:
    """Padded, on one line whatever the session's chunking is."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def base64_decode(x: Column) -> Column:
    """Bytes; null where the text, without white space, is no valid Base64."""
    valid = lambda packed: (F.length(packed) % 4 == 0) & packed.rlike(r"^[A-Za-z0-9+/]*={0,2}$")
    return let(F.regexp_replace(x, f"{_QUICK_SPACE}+", ""), lambda packed: F.when(valid(packed), F.unbase64(packed)))


# What is between words, and the places where the case changes.
_BETWEEN = r"[^\p{L}\p{N}]+|(?=\p{Lu})(?:(?<=[\p{Ll}\p{N}])|(?<=\p{Lu})(?=\p{Lu}\p{Ll}))"


def words_of(x: Column) -> Column:
    """Words as the case conversions see them: letters and digits, split at case changes."""
    return F.filter(F.split(x, _BETWEEN), lambda w: w != "")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


#: Case conversions of words_of() a text.
CASES: dict[str, Callable[[Column], Column]] = {
    "snake": lambda words: F.array_join(F.transform(words, F.lower), "_"),
    "kebab": lambda words: F.array_join(F.transform(words, F.lower), "-"),
    "constant": lambda words: F.array_join(F.transform(words, F.upper), "_"),
    "pascal": lambda words: F.array_join(F.transform(words, _capital), ""),
    "camel": lambda words: F.array_join(F.transform(words, lambda v, i: F.when(i == 0, F.lower(v)).otherwise(_capital(v))), ""),
    "title": lambda words: F.array_join(F.transform(words, _capital), " "),
    "sentence": lambda words: let(F.array_join(F.transform(words, F.lower), " "), _capital),
    "slug": lambda words: F.array_join(F.transform(words, F.lower), "-"),
}


def case_snake(x: Column) -> Column:
    return CASES["snake"](words_of(x))


def case_kebab(x: Column) -> Column:
    return CASES["kebab"](words_of(x))


def case_constant(x: Column) -> Column:
    return CASES["constant"](words_of(x))


def case_pascal(x: Column) -> Column:
    return CASES["pascal"](words_of(x))


def case_camel(x: Column) -> Column:
    return CASES["camel"](words_of(x))


def case_title(x: Column) -> Column:
    return CASES["title"](words_of(x))


def case_sentence(x: Column) -> Column:
    return CASES["sentence"](words_of(x))


def case_slug(x: Column) -> Column:
    """Words in lower case with hyphens; white space at the ends is between words anyway."""
    return CASES["slug"](words_of(x))


def strip_frontmatter(x: Column) -> Column:
    return F.regexp_replace(x, r"\A---\r?\n[\s\S]*?\r?\n---\r?\n?", "")


# The Markdown rules in the order in which they apply.
MARKDOWN_RULES = (
    (r"```", ""),
    (rf"(?m)^#{{1,6}}{JS_SPACE}+", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (rf"(^|{JS_SPACE})\*([^*\n]+)\*", "$1$2"),
    (rf"(^|{JS_SPACE})_([^_\n]+)_", "$1$2"),
    (rf"(?m)^{JS_SPACE}*>{JS_SPACE}?", ""),
    (rf"(?m)^{JS_SPACE}*[-*+]{JS_SPACE}+", ""),
    (r"`([^`]+)`", "$1"),
    (r"\n{3,}", "\n\n"),
)


def md_to_txt(x: Column) -> Column:
    x = strip_frontmatter(x)
    for pattern, by in MARKDOWN_RULES:
        x = F.regexp_replace(x, pattern.replace(JS_SPACE, _QUICK_SPACE), by)
    return x


def html_to_text(x: Column) -> Column:
    for pattern in (r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>", r"<[^>]+>"):
        x = F.regexp_replace(x, pattern, " ")
    return js_trim(F.regexp_replace(unescape(x), f"{_QUICK_SPACE}+", " "))


def csv_cell(x: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(x.isNull(), F.lit("")).when(x.rlike('[",\\r\\n]'), quoted).otherwise(x)


def md_table_csv(md: Column) -> Column:
    """Every line that starts with a bar, without separator rows, as CSV; null without such a line."""
    lines = F.filter(F.transform(F.split(md, r"\r?\n"), js_trim), lambda line: line.startswith("|") & ~line.rlike(r"^\|[\s:|-]+\|$"))
    cells = lambda line: F.transform(F.slice(F.split(line, r"\|"), F.lit(2), F.greatest(F.size(F.split(line, r"\|")) - 2, F.lit(0))), lambda c: csv_cell(js_trim(c)))
    return let(lines, lambda own: F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda line: F.array_join(cells(line), ",")), "\n")))


def sanitize_name(x: Column) -> Column:
    """A safe file name: no folders, control or bidirectional characters, leading dots; 200 characters."""
    x = F.regexp_replace(x, r"(?s)^.*[/\\]", "")
    x = F.regexp_replace(x, r"[\x00-\x1F\x7F\x{202A}-\x{202E}]", "")
    x = js_trim(F.substring(F.regexp_replace(x, r"^\.+", ""), 1, 200))
    return F.when(x == "", F.lit("archivo")).otherwise(x)


def humanize(x: Column) -> Column:
    """camelCase as `Camel Case`."""
    spaced = F.regexp_replace(x, r"([A-Z])", " $1")
    return F.trim(F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30)))


def truncated(x: Column, most: int) -> Column:
    """The first `most` UTF-16 units and …; a half of a pair that the cut leaves becomes U+FFFD. Shorter text as it is."""
    units = F.encode(x, "UTF-16BE")
    return F.when(F.octet_length(units) <= 2 * most, x).otherwise(F.concat(_utf16_head(x, units, most), F.lit("…")))


def _utf16_head(x: Column, units: Column, most: int) -> Column:
    """The text of the first `most` UTF-16 units."""
    def split_pair(last: Column) -> Column:
        cut = last.between("D800", "DBFF")
        whole = F.decode(F.substring(units, 1, 2 * most - 2), "UTF-16BE")
        return F.when(cut, F.concat(whole, F.lit("\ufffd"))).otherwise(F.decode(F.substring(units, 1, 2 * most), "UTF-16BE"))

    return F.when(F.length(x) == utf16_length(x), F.substring(x, 1, most)).otherwise(let(F.hex(F.substring(units, 2 * most - 1, 2)), split_pair))


def short_hex(content: Column, most: int = 32) -> Column:
    """Up to `most` bytes in hexadecimal, with a space between; … for what follows."""
    shown = F.regexp_replace(F.lower(F.hex(F.substring(content, 1, most))), "(..)(?=.)", "$1 ")
    return F.when(F.octet_length(content) > most, F.concat(shown, F.lit("…"))).otherwise(shown)
