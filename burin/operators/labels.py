"""Labels and sensitivities of raw metadata keys: rules by prefix, the longest that fits holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (kind of tags, key, whether it is a prefix, label, sensitivity).
RULES = (
    ("exif", "Make", False, "Fabricante", "medium"), ("exif", "Model", False, "Modelo", "medium"), ("exif", "Software", False, "Software", "medium"), ("exif", "ProcessingSoftware", False, "Software de procesado", "medium"),
    ("exif", "DateTimeOriginal", False, "Fecha original", "medium"), ("exif", "CreateDate", False, "Fecha de creación", "medium"), ("exif", "ModifyDate", False, "Fecha de modificación", "medium"),
    ("exif", "OffsetTimeOriginal", False, "Desfase de hora", "low"), ("exif", "ExposureTime", False, "Tiempo de exposición", "low"), ("exif", "FNumber", False, "Apertura", "low"), ("exif", "ISO", False, "Sensibilidad ISO", "low"),
    ("exif", "FocalLength", False, "Distancia focal", "low"), ("exif", "LensModel", False, "Objetivo", "low"), ("exif", "LensMake", False, "Fabricante del objetivo", "low"), ("exif", "Orientation", False, "Orientación", "low"),
    ("exif", "WhiteBalance", False, "Balance de blancos", "low"), ("exif", "Flash", False, "Flash", "low"), ("exif", "Artist", False, "Artista", "medium"), ("exif", "Copyright", False, "Copyright", "medium"),
    ("exif", "ImageDescription", False, "Descripción", "low"), ("exif", "UserComment", False, "Comentario", "high"), ("exif", "GPSLatitude", False, "Latitud GPS", "high"), ("exif", "GPSLongitude", False, "Longitud GPS", "high"),
    ("exif", "GPSAltitude", False, "Altitud GPS", "high"), ("exif", "GPSDateStamp", False, "Fecha GPS", "high"), ("exif", "GPSTimeStamp", False, "Hora GPS", "high"), ("exif", "ImageWidth", False, "Ancho", "low"), ("exif", "ImageHeight", False, "Alto", "low"),
    ("exif", "ExifImageWidth", False, "Ancho", "low"),
    ("id3", "TIT2", False, "Título", "low"), ("id3", "TPE1", False, "Artista", "medium"), ("id3", "TPE2", False, "Álbum artista", "medium"), ("id3", "TALB", False, "Álbum", "low"), ("id3", "TDRC", False, "Año", "low"), ("id3", "TYER", False, "Año", "low"),
    ("id3", "TCON", False, "Género", "low"), ("id3", "TCOM", False, "Compositor", "medium"), ("id3", "TPUB", False, "Editor", "low"), ("id3", "TRCK", False, "Pista", "low"), ("id3", "TPOS", False, "Disco", "low"), ("id3", "TCOP", False, "Copyright", "medium"),
    ("id3", "TENC", False, "Codificado por", "medium"), ("id3", "TSSE", False, "Software", "medium"), ("id3", "TSRC", False, "ISRC", "medium"), ("id3", "USLT", False, "Letra", "medium"), ("id3", "TXXX", False, "Texto personalizado", "medium"),
    ("id3", "WXXX", False, "URL", "low"), ("id3", "COMM", False, "Comentario", "medium"), ("id3", "APIC", False, "Carátula", "high"), ("id3", "PIC", False, "Carátula", "high"),
    ("ilst", "©nam", False, "Título", "low"), ("ilst", "©ART", False, "Artista", "medium"), ("ilst", "©alb", False, "Álbum", "low"), ("ilst", "©day", False, "Año", "low"), ("ilst", "©cmt", False, "Comentario", "medium"), ("ilst", "©gen", False, "Género", "low"),
    ("ilst", "©too", False, "Software", "medium"), ("ilst", "©swr", False, "Software", "medium"),
)
# The sensitivity of keys that no rule knows, by kind of tags; and of kinds without one.
DEFAULTS = {"exif": "low", "id3": "medium", "ilst": "medium"}
OTHERWISE = "low"
#: Rules that are sent to every task; more are joined as any table.
MOST_SENT = 10_000


def rules(spark: SparkSession, rows=RULES) -> DataFrame:
    return spark.createDataFrame(list(rows), "tags string, prefix string, open boolean, label string, sensitivity string")


def labelled(entries: DataFrame, table: DataFrame, tags: str = "tags", key: str = "key") -> DataFrame:
    """entries with label and sensitivity: those of the longest rule of the same tags that is the key or, if open, begins it.

    Without a rule the label is the key and the sensitivity the default of the tags. Distinct
    keys meet the rules once, by equality: a key is cut only to the lengths that rules have, so
    a key has at most as many candidates as there are lengths. A rule that stands twice counts
    once, by its label and sensitivity. Null keys or tags meet no rule.
    """
    held = table.select(F.col("tags").alias("r_tags"), F.col("prefix").alias("r_prefix"), F.col("open").alias("r_open"), F.col("label").alias("r_label"), F.col("sensitivity").alias("r_sensitivity"))
    lengths = sorted(r["n"] for r in held.select(F.length("r_prefix").alias("n")).where("n IS NOT NULL").distinct().collect())
    small = held.limit(MOST_SENT + 1).count() <= MOST_SENT
    keys = entries.select(F.col(tags).alias("k_tags"), F.col(key).alias("k_key")).where("k_tags IS NOT NULL AND k_key IS NOT NULL").distinct()
    cut = keys.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).where(F.col("n") <= F.length("k_key")).withColumn("head", F.expr("left(k_key, n)"))
    met = cut.join(F.broadcast(held) if small else held, (F.col("k_tags") == F.col("r_tags")) & (F.col("head") == F.col("r_prefix")) & (F.col("r_open") | (F.col("n") == F.length("k_key"))))
    best = met.groupBy("k_tags", "k_key").agg(F.max(F.struct("n", F.col("r_label").alias("label"), F.col("r_sensitivity").alias("sensitivity"))).alias("best"))
    plain = entries.drop("label", "sensitivity")
    default = F.coalesce(F.create_map(*[F.lit(x) for pair in DEFAULTS.items() for x in pair])[F.col(tags)], F.lit(OTHERWISE))
    joined = plain.join(best, (plain[tags] == best["k_tags"]) & (plain[key] == best["k_key"]), "left")
    return joined.select(*[plain[c] for c in plain.columns], F.coalesce("best.label", plain[key]).alias("label"), F.coalesce("best.sensitivity", default).alias("sensitivity"))
