"""Numbers, colours, durations, dates and image geometry over parts, line items, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from burin.functions import numeric as N
from burin.plans.registry import query, table


@query("SELECT p_partkey, concat('decimal: ', v, chr(10), 'hex: ', CASE WHEN v < 0 THEN '-' ELSE '' END, '0x', lower(to_hex(abs(v))), chr(10), 'binary: ', CASE WHEN v < 0 THEN '-' ELSE '' END, '0b', to_binary(abs(v))) AS lines FROM (SELECT p_partkey, CAST(p_size * (CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS v FROM part)")
def number_base(spark, d):
    v = F.col("p_size").cast("long") * F.when(F.col("p_partkey") % 3 == 0, -1).otherwise(1)
    text = F.when((F.col("p_partkey") % 3 == 1) & (F.col("p_partkey") % 2 == 0), F.concat(F.lit("0x"), F.lower(F.hex(v)))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("0b"), F.bin(v))).otherwise(v.cast("string"))
    return table(spark, d, "part").select("p_partkey", N.number_base(text).alias("lines"))


_ROMAN = "concat(repeat('M', n // 1000), ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1], ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1], ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1])"


@query(f"SELECT o_orderkey, CASE WHEN n BETWEEN 1 AND 3999 THEN {_ROMAN} END AS roman, CASE WHEN n BETWEEN 1 AND 3999 THEN CAST(n AS INTEGER) END AS back FROM (SELECT o_orderkey, o_orderkey % 4100 AS n FROM orders)")
def roman_numerals(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", N.to_roman((F.col("o_orderkey") % 4100).cast("int")).alias("roman"))
    return rows.select("o_orderkey", "roman", N.from_roman(F.col("roman")).cast("int").alias("back"))


_RGB = "p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b"


@query(f"""WITH c AS (SELECT p_partkey, {_RGB} FROM part),
e AS (SELECT *, r / 255.0::DOUBLE AS x, g / 255.0::DOUBLE AS y, b / 255.0::DOUBLE AS z FROM c),
m AS (SELECT *, greatest(x, y, z) AS mx, least(x, y, z) AS mn FROM e),
l AS (SELECT *, (mx + mn) / 2 AS li, mx - mn AS de FROM m),
h AS (SELECT *, CASE WHEN de = 0 THEN 0 WHEN mx = x THEN (y - z) / de + (CASE WHEN y < z THEN 6 ELSE 0 END) WHEN mx = y THEN (z - x) / de + 2 ELSE (x - y) / de + 4 END AS hu, CASE WHEN de = 0 THEN 0 WHEN li > 0.5 THEN de / (2 - mx - mn) ELSE de / (mx + mn) END AS sa FROM l)
SELECT p_partkey, concat('#', lpad(lower(to_hex(r)), 2, '0'), lpad(lower(to_hex(g)), 2, '0'), lpad(lower(to_hex(b)), 2, '0')) AS hex,
  concat('hsl(', CAST(floor(hu * 60 + 0.5) AS BIGINT), ', ', CAST(floor(sa * 100 + 0.5) AS BIGINT), '%, ', CAST(floor(li * 100 + 0.5) AS BIGINT), '%)') AS hsl FROM h""")
def color_convert(spark, d):
    part = [(F.col("p_partkey") * k % 256).cast("string") for k in (7, 13, 29)]
    text = F.concat(F.lit("rgb("), part[0], F.lit(", "), part[1], F.lit(","), part[2], F.lit(")"))
    rows = table(spark, d, "part").select("p_partkey", N.rgb_of(text).alias("c"))
    return rows.select("p_partkey", N.hex_of(F.col("c")).alias("hex"), N.hsl_of(F.col("c")).alias("hsl"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s <= 0 THEN '0 s' WHEN s < 60 THEN concat(replace(printf('%.1f', floor(s * 10 + 0.5) / 10), '.', ','), ' s') WHEN t >= 3600 THEN concat(t // 3600, ':', lpad(CAST(t // 60 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(t % 60 AS VARCHAR), 2, '0')) ELSE concat(t // 60, ':', lpad(CAST(t % 60 AS VARCHAR), 2, '0')) END AS shown FROM (SELECT l_orderkey, l_linenumber, s, CAST(floor(s + 0.5) AS BIGINT) AS t FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 3) * l_linenumber * 30.25 AS s FROM lineitem))")
def format_durations(spark, d):
    s = (F.col("l_quantity") - 3) * F.col("l_linenumber") * 30.25
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.format_duration(s).alias("shown"))


@query("SELECT event_id, concat('Fecha (UTC): ', strftime(ts, '%Y-%m-%d %H:%M:%S'), chr(10), 'ISO: ', strftime(ts, '%Y-%m-%dT%H:%M:%S'), '.', lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0'), 'Z', chr(10), 'Epoch (ms): ', epoch_us(ts) // 1000) AS lines FROM events")
def event_ts_format(spark, d):
    return table(spark, d, "events").select("event_id", N.timestamp_lines(F.unix_millis(F.col("ts").cast("timestamp"))).alias("lines"))


_AS_TYPED = "CASE o_orderkey % 4 WHEN 0 THEN CAST(epoch_ms(o_orderdate) AS VARCHAR) WHEN 3 THEN 'hoy' ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query(f"""SELECT o_orderkey, CASE WHEN ok THEN concat('Fecha (UTC): ', strftime(t, '%Y-%m-%d %H:%M:%S'), chr(10), lines) END AS date, CASE WHEN ok THEN lines END AS stamp, CASE WHEN NOT ok THEN 'No pude interpretar la fecha (usa formato ISO o epoch en ms)' END AS error
FROM (SELECT *, concat('ISO: ', strftime(t, '%Y-%m-%dT%H:%M:%S'), '.000Z', chr(10), 'Epoch (ms): ', epoch_ms(t)) AS lines
  FROM (SELECT o_orderkey, o_orderkey % 4 <> 3 AS ok, CASE o_orderkey % 4 WHEN 2 THEN date_trunc('day', o_orderdate) + INTERVAL 7200 SECOND ELSE date_trunc('day', o_orderdate) END AS t FROM orders))""")
def dates_as_typed(spark, d):
    """Epoch and ISO dates, with and without time and zone, with white space around; others are errors."""
    from burin.operators.convert import convert

    day = F.date_format(F.date_trunc("day", "o_orderdate"), "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    typed = F.when(k == 0, F.unix_millis(F.date_trunc("day", "o_orderdate").cast("timestamp")).cast("string")).when(k == 1, day).when(k == 2, F.concat(day, F.lit("T03:30:00.000+0130"))).otherwise("hoy")
    padded = F.concat(F.lit("\t "), typed, F.lit("\r\n"))
    rows = table(spark, d, "orders").select("o_orderkey", convert(padded, "timestamp-to-date").alias("a"), convert(padded, "date-to-timestamp").alias("b"))
    return rows.select("o_orderkey", F.col("a.result").alias("date"), F.col("b.result").alias("stamp"), F.col("b.error").alias("error"))


@query("""SELECT o_orderkey, CASE WHEN n BETWEEN 1 AND 3999 THEN %s END AS roman, CASE WHEN n = 7 THEN 'No pude identificar la base del número (usa decimal, 0x… o 0b…)' WHEN n NOT BETWEEN 1 AND 3999 THEN 'El número debe ser un entero entre 1 y 3999' END AS error
FROM (SELECT o_orderkey, CASE WHEN o_orderkey %% 4100 = 7 THEN NULL ELSE o_orderkey %% 4100 END AS n FROM orders)""".replace("n = 7", "n IS NULL") % _ROMAN)
def roman_as_typed(spark, d):
    """Decimal, 0x and 0b input with tabs and line breaks around it."""
    from burin.operators.convert import convert

    n = F.col("o_orderkey") % 4100
    typed = F.when(n == 7, "siete").when(n % 3 == 0, F.concat(F.lit("0X"), F.hex(n))).when(n % 3 == 1, F.concat(F.lit("0b"), F.bin(n))).otherwise(n.cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", convert(F.concat(F.lit("\t"), typed, F.lit("\n")), "dec-to-roman").alias("c"))
    return rows.select("o_orderkey", F.col("c.result").alias("roman"), F.col("c.error").alias("error"))


@query("SELECT o_orderkey, strftime(to_timestamp(s - 2082844800), '%Y-%m-%d %H:%M:%S') AS mp4, strftime(make_timestamp(n // 1000 + 978307200000000), '%Y-%m-%d %H:%M:%S') AS mkv FROM (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + 2082844800 AS s, o_orderkey * 1000003000000 AS n FROM orders)")
def container_times(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 2082844800).alias("s"), (F.col("o_orderkey") * 1000003000000).alias("n"))
    return rows.select("o_orderkey", N.mp4_time(F.col("s")).alias("mp4"), N.matroska_time(F.col("n")).alias("mkv"))


_GEOMETRY = "CAST(p_size * 40 + 1 AS INTEGER) AS w, CAST(p_partkey % 900 + 1 AS INTEGER) AS h, CAST(CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 300 + 1 END AS INTEGER) AS ww, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 200 + 1 END AS INTEGER) AS wh, CAST(CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 400 + 1 END AS INTEGER) AS pc"


@query(f"""SELECT p_partkey, CAST(CASE WHEN pc IS NOT NULL AND pc <> 100 THEN greatest(1, floor(w * pc / 100.0 + 0.5)) WHEN ww IS NOT NULL THEN ww WHEN wh IS NOT NULL THEN greatest(1, floor(w * wh / h::DOUBLE + 0.5)) ELSE w END AS INTEGER) AS tw,
  CAST(CASE WHEN pc IS NOT NULL AND pc <> 100 THEN greatest(1, floor(h * pc / 100.0 + 0.5)) WHEN wh IS NOT NULL THEN wh WHEN ww IS NOT NULL THEN greatest(1, floor(h * ww / w::DOUBLE + 0.5)) ELSE h END AS INTEGER) AS th FROM (SELECT p_partkey, {_GEOMETRY} FROM part)""")
def resize_target(spark, d):
    g = table(spark, d, "part").selectExpr("p_partkey", *_GEOMETRY.replace("CAST(p_size", "|CAST(p_size").replace(", CAST", "|CAST").strip("|").split("|"))
    return g.select("p_partkey", N.resize_target(*map(F.col, ("w", "h", "ww", "wh", "pc"))).alias("t")).select("p_partkey", F.col("t.w").alias("tw"), F.col("t.h").alias("th"))


@query(f"""SELECT p_partkey, CAST(greatest(0, least(x, w - cw)) AS INTEGER) AS x, CAST(greatest(0, least(y, h - ch)) AS INTEGER) AS y, CAST(cw AS INTEGER) AS cw, CAST(ch AS INTEGER) AS ch
FROM (SELECT p_partkey, w, h, p_partkey % 700 AS x, p_partkey % 500 AS y, greatest(1, least(p_partkey % 650, w)) AS cw, greatest(1, least(p_partkey % 450, h)) AS ch FROM (SELECT p_partkey, {_GEOMETRY} FROM part))""")
def crop_clamp(spark, d):
    g = table(spark, d, "part").selectExpr("p_partkey", *_GEOMETRY.replace(", CAST", "|CAST").split("|"))
    key = F.col("p_partkey")
    return g.select("p_partkey", N.clamp_crop(F.col("w"), F.col("h"), key % 700, key % 500, key % 650, key % 450).alias("c")).select("p_partkey", F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("c.w").alias("cw"), F.col("c.h").alias("ch"))
