"""Numbers, Roman numerals, colours, durations and image geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burin.functions.text import js_trim, let


def js_round(x: Column) -> Column:
    """Math.round: halves go up."""
    return F.floor(x + 0.5)


def integer_of(text: Column) -> Column:
    """A decimal, 0x or 0b integer (a sign only before a decimal) with white space around it; null where it is none."""
    return let(js_trim(text), lambda t: (
        F.when(t.rlike("(?i)^0x[0-9a-f]+$"), F.conv(F.substring(t, 3, 64), 16, 10).try_cast("long"))
        .when(t.rlike("(?i)^0b[01]+$"), F.conv(F.substring(t, 3, 64), 2, 10).try_cast("long"))
        .when(t.rlike("^-?[0-9]+$"), t.try_cast("long"))
    ))


def base_lines(number: Column) -> Column:
    """Three lines of a whole number: decimal, hexadecimal and binary."""
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(F.lit("decimal: "), number.cast("string"), F.lit("\nhex: "), sign, F.lit("0x"), F.lower(F.hex(F.abs(number))), F.lit("\nbinary: "), sign, F.lit("0b"), F.bin(F.abs(number)))


def number_base(text: Column) -> Column:
    """Three lines of an integer_of(); null where it is none."""
    return let(integer_of(text), base_lines)


# Numerals of units, tens, hundreds and thousands.
_UNITS = ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
_TENS = ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")
_HUNDREDS = ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM")
_THOUSANDS = ("", "M", "MM", "MMM")


def to_roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999; null beyond."""
    digit = lambda names, by: F.element_at(F.array(*map(F.lit, names)), ((n / by).cast("int") % 10 + 1).cast("int"))
    safe = F.when(n.between(1, 3999), n)
    n = safe
    return F.when(safe.isNotNull(), F.concat(digit(_THOUSANDS + ("",) * 6, 1000), digit(_HUNDREDS, 100), digit(_TENS, 10), digit(_UNITS, 1)))


#: What is a numeral in upper case, as a class: a dotless i is one.
ROMAN = r"[IVXLCDMivxlcdm\x{131}]"


def from_roman(x: Column) -> Column:
    """Subtractive sum without a check of the order; null for other characters or nothing."""
    return let(js_trim(x), lambda t: F.when(t.rlike(f"^{ROMAN}+$"), _roman_sum(F.upper(t))))


def _roman_sum(t: Column) -> Column:
    value = F.create_map(*[F.lit(v) for v in ("I", 1, "V", 5, "X", 10, "L", 50, "C", 100, "D", 500, "M", 1000)])
    numbers = F.transform(F.split(t, ""), lambda c: F.coalesce(value[c], F.lit(0)))
    return F.aggregate(
        numbers, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, v: F.struct((a["sum"] + v - F.when(a["last"] < v, a["last"] * 2).otherwise(0)).cast("int").alias("sum"), v.alias("last")),
        lambda a: a["sum"],
    )


def rgb_of(text: Column) -> Column:
    """struct(r, g, b) of #rgb, #rrggbb, rgb() or hsl(); null where the text is none."""
    return let(js_trim(text), _rgb_of)


def _rgb_of(t: Column) -> Column:
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    # The forms of a colour.
    hex6, hex3 = "(?i)^#([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})$", "(?i)^#([0-9a-f])([0-9a-f])([0-9a-f])$"
    rgb = r"(?i)^rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)$"
    hsl = r"(?i)^hsl\(\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)%\s*,\s*(\d+(?:\.\d+)?)%\s*\)$"
    from_hex6 = [F.conv(part(hex6, k), 16, 10).cast("int") for k in (1, 2, 3)]
    from_hex3 = [F.conv(F.concat(part(hex3, k), part(hex3, k)), 16, 10).cast("int") for k in (1, 2, 3)]
    from_rgb = [F.least(F.lit(255), part(rgb, k).try_cast("int")) for k in (1, 2, 3)]
    h, s, light = part(hsl, 1).try_cast("double"), part(hsl, 2).try_cast("double") / 100, part(hsl, 3).try_cast("double") / 100
    chroma = (1 - F.abs(2 * light - 1)) * s
    sector = h / 60
    x, zero, m = chroma * (1 - F.abs(sector % 2 - 1)), F.lit(0.0), light - chroma / 2
    wheel = ((chroma, x, zero), (x, chroma, zero), (zero, chroma, x), (zero, x, chroma), (x, zero, chroma), (chroma, zero, x))
    from_hsl = []
    for channel in range(3):
        value = wheel[5][channel]
        for k in range(4, -1, -1):
            value = F.when(sector < k + 1, wheel[k][channel]).otherwise(value)
        from_hsl.append(js_round((value + m) * 255).cast("int"))
    made = lambda c: F.struct(*[v.cast("int").alias(n) for v, n in zip(c, "rgb", strict=True)])
    return F.when(t.rlike(hex6), made(from_hex6)).when(t.rlike(hex3), made(from_hex3)).when(t.rlike(rgb), made(from_rgb)).when(t.rlike(hsl), made(from_hsl))


def hex_of(c: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c[k].cast("long")), 2, "0")) for k in "rgb"])


def hsl_of(c: Column) -> Column:
    r, g, b = (c[k] / 255.0 for k in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    light, delta = (top + low) / 2, top - low
    sat = F.when(light > 0.5, delta / (2 - top - low)).otherwise(delta / (top + low))
    hue = F.when(top == r, (g - b) / delta + F.when(g < b, 6).otherwise(0)).when(top == g, (b - r) / delta + 2).otherwise((r - g) / delta + 4)
    some = delta > 0
    values = (F.when(some, js_round(hue * 60)).otherwise(0), F.when(some, js_round(sat * 100)).otherwise(0), js_round(light * 100))
    return F.concat(F.lit("hsl("), values[0].cast("string"), F.lit(", "), values[1].cast("string"), F.lit("%, "), values[2].cast("string"), F.lit("%)"))


def color_convert(text: Column) -> Column:
    """Four lines HEX, RGB, HSL and css; null where the text is no colour."""
    rgb = lambda c: F.concat(F.lit("rgb("), c["r"].cast("string"), F.lit(", "), c["g"].cast("string"), F.lit(", "), c["b"].cast("string"), F.lit(")"))
    return let(rgb_of(text), lambda c: F.when(c.isNotNull(), F.concat(F.lit("HEX: "), hex_of(c), F.lit("\nRGB: "), rgb(c), F.lit("\nHSL: "), hsl_of(c), F.lit("\ncss: "), hex_of(c))))


def format_duration(seconds: Column) -> Column:
    """`12,5 s` under a minute, then m:ss, then h:mm:ss; `0 s` for nothing positive."""
    whole = js_round(seconds)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    short = F.concat(F.replace(F.format_string("%.1f", seconds.cast("double")), F.lit("."), F.lit(",")), F.lit(" s"))
    return F.when(~(seconds > 0), F.lit("0 s")).when(seconds < 60, short).when(whole >= 3600, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), two(s)))


def resize_target(width: Column, height: Column, want_w: Column, want_h: Column, percent: Column) -> Column:
    """struct(w, h): a percentage other than 100 wins, one side keeps the ratio, never under 1."""
    one = lambda x: F.greatest(F.lit(1), js_round(x)).cast("int")
    pair = lambda w, h: F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))
    return (
        F.when(percent.isNotNull() & (percent != 100), pair(one(width * percent / 100.0), one(height * percent / 100.0)))
        .when(want_w.isNotNull() & want_h.isNotNull(), pair(want_w, want_h))
        .when(want_w.isNotNull(), pair(want_w, one(height * want_w / width)))
        .when(want_h.isNotNull(), pair(one(width * want_h / height), want_h))
        .otherwise(pair(width, height))
    )


def clamp_crop(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct(x, y, w, h) inside the image: size first, then origin."""
    cw, ch = F.greatest(F.lit(1), F.least(js_round(w), width)), F.greatest(F.lit(1), F.least(js_round(h), height))
    cx, cy = F.greatest(F.lit(0), F.least(js_round(x), width - cw)), F.greatest(F.lit(0), F.least(js_round(y), height - ch))
    return F.struct(cx.cast("int").alias("x"), cy.cast("int").alias("y"), cw.cast("int").alias("w"), ch.cast("int").alias("h"))


# The ISO forms of a date and of a time of day that may follow it.
_ISO_DATE, _ISO_TIME = r"\d{4}(?:-\d{2}(?:-\d{2})?)?", r"\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?"
#: Milliseconds on either side of 1970 that a date can have.
_MOST_MS = 8_640_000_000_000_000


# The forms of a date with a month's name or with slashes, and what may follow it.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_DAYS = (rf"{_MONTH}[ -]*(\d{{1,2}})(?:,? +|-)(\d{{4}})", rf"(\d{{1,2}})[ -]*{_MONTH},?[ -]*(\d{{4}})", r"(\d{1,2})/(\d{1,2})/(\d{4})", r"(\d{4})/(\d{1,2})/(\d{1,2})")
_CLOCK = r"(?:,? +(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,3})\d*)?)?(?: *(am|pm))?)?(?: *(?:gmt|utc|z)? *([+-]\d{2}):?(\d{2})| *(?:gmt|utc|z))?"
#: Groups of the month, the day and the year in each of the forms of a day.
_PLACES = ((1, 2, 3), (5, 4, 6), (7, 8, 9), (11, 12, 10))


def _spoken_date(text: Column) -> Column:
    """Epoch milliseconds of `Jan 2, 2024`, `Tue, 02 Jan 2024 10:20:30 GMT`, `1/2/2024 3:04 pm` and the like; null for others.

    Names of days and remarks in brackets are left out, `1/2` is the second of January, a day past
    the end of its month (up to 31) goes on into the next, and a date without a zone is in UTC.
    """
    pattern = "^" + "(?:" + "|".join(_DAYS) + ")" + _CLOCK + "$"
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\([^()]*\)", " "), r"^ *(?:sun|mon|tue|wed|thu|fri|sat)[a-z]*\.?,? +", ""))

    def parsed(t: Column) -> Column:
        group = lambda i: F.regexp_extract(t, pattern, i)
        number = lambda i: F.coalesce(group(i).try_cast("int"), F.lit(0))
        any_of = lambda k: F.coalesce(*[F.nullif(group(p[k]), F.lit("")) for p in _PLACES])
        named = F.instr(F.lit(_MONTHS), F.substring(any_of(0), 1, 3))
        month = F.when(named > 0, ((named + 2) / 3).cast("int")).otherwise(any_of(0).try_cast("int"))
        day, year = any_of(1).try_cast("int"), any_of(2).try_cast("int")
        hour, half = number(13), group(17)
        of_day = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
        seconds = (of_day * 60 + number(14)) * 60 + number(15)
        zone = F.when(F.startswith(group(18), F.lit("-")), -1).otherwise(1) * (F.abs(number(18)) * 60 + number(19)) * 60
        valid = t.rlike(pattern) & month.between(1, 12) & day.between(1, 31) & (of_day <= 24) & (number(14) < 60) & (number(15) < 60) & (seconds <= 86400)
        days = F.unix_date(F.make_date(year, F.when(month.between(1, 12), month), F.lit(1))) + day - 1
        return F.when(valid, (days.cast("long") * 86400 + seconds - zone) * 1000 + F.rpad(group(16), 3, "0").try_cast("long"))

    return let(bare, parsed)


def date_of(text: Column) -> Column:
    """Epoch milliseconds of a date as typed: a whole number of them, an ISO date, or a date with a month's name or slashes; null where it is none.

    White space around it is left out; a date without a zone is in UTC.
    """
    def parsed(t: Column) -> Column:
        day = F.regexp_extract(t, f"^({_ISO_DATE})", 1)
        time, zone = F.regexp_extract(t, rf"[T ]({_ISO_TIME})", 1), F.regexp_extract(t, r"(Z|[+-]\d{2}:?\d{2})$", 1)
        has_time = F.contains(t, F.lit(":"))
        zone = F.when(has_time & (zone != ""), F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2")).otherwise(F.lit("Z"))
        whole = F.concat(day, F.when(F.length(day) == 4, F.lit("-01-01")).when(F.length(day) == 7, F.lit("-01")).otherwise(F.lit("")))
        iso = F.unix_millis(F.try_to_timestamp(F.concat(whole, F.lit("T"), F.when(~has_time, F.lit("00:00:00")).when(F.length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time), zone)))
        ms = F.when(t.rlike(r"^-?\d+$") & (F.length(t) < 18), t.try_cast("long")).when(t.rlike(rf"^{_ISO_DATE}(?:[T ]{_ISO_TIME}(?:Z|[+-]\d{{2}}:?\d{{2}})?)?$"), iso).otherwise(_spoken_date(t))
        return let(ms, lambda m: F.when(m.between(-_MOST_MS, _MOST_MS), m))

    return let(js_trim(text), parsed)


def _utc(ms: Column, pattern: str) -> Column:
    """Text of epoch milliseconds in UTC, whatever the session's time zone is."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), pattern)


def iso_lines(ms: Column) -> Column:
    """ISO and epoch lines of epoch milliseconds."""
    return F.concat(F.lit("ISO: "), _utc(ms, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("\nEpoch (ms): "), ms.cast("string"))


def timestamp_lines(ms: Column) -> Column:
    """UTC, ISO and epoch lines of epoch milliseconds."""
    return F.concat(F.lit("Fecha (UTC): "), _utc(ms, "yyyy-MM-dd HH:mm:ss"), F.lit("\n"), iso_lines(ms))


def mp4_time(seconds: Column) -> Column:
    """UTC text of seconds since 1904; null for 0."""
    return F.when(seconds > 0, F.date_format(F.timestamp_seconds(seconds - 2082844800), "yyyy-MM-dd HH:mm:ss"))


def matroska_time(nanos: Column) -> Column:
    """UTC text of nanoseconds since 2001."""
    return F.date_format(F.timestamp_micros(F.call_function("div", nanos, F.lit(1000)) + 978307200000000), "yyyy-MM-dd HH:mm:ss")
