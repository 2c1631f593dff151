"""Ranges of positions across rows: islands, and offsets moved by what changed before them.

One artifact may hold a third of all rows. Artifacts of more than `most` rows are cut into pieces
at approximate quantiles of their positions; every piece is a window of its own, and what the
pieces before it hand on (the furthest end, a sum) comes from one row a piece. The artifacts that
are cut and their cuts are the only rows that reach the driver: at most rows / most of them.

Defined results: rows with a null position are left out, a null artifact is an artifact of its
own, repeated rows count as often as they stand (sums) or once (islands).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an artifact that one window takes, pieces of a larger artifact, shares of a position that many rows hold.
MOST_ROWS, PIECES, SALTS = 1 << 20, 64, 8


def _cuts(rows: DataFrame, most: int) -> DataFrame | None:
    """(a, cuts): sorted positions that cut the artifacts `a` of more than `most` rows by position `at`; None without such artifacts."""
    spark = rows.sparkSession
    kind = rows.select("a").schema
    hot = rows.groupBy("a").count().where(F.col("count") > most).select("a").collect()
    if not hot:
        return None
    shares = [i / PIECES for i in range(1, PIECES)]
    keys = spark.createDataFrame(hot, kind).withColumnRenamed("a", "hot")
    found = rows.join(keys, F.col("a").eqNullSafe(F.col("hot")), "left_semi").groupBy("a").agg(F.array_sort(F.array_distinct(F.percentile_approx("at", shares, 10_000))).alias("cuts"))
    return spark.createDataFrame(found.collect(), found.schema)


def _pieced(rows: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """rows with `piece`: the number of cuts at or before the position; 0 for artifacts that are not cut, with `cut` false."""
    if cuts is None:
        return rows.withColumns({"piece": F.lit(0), "cut": F.lit(False)})
    named = cuts.withColumnRenamed("a", "hot")
    joined = rows.join(named, F.col("a").eqNullSafe(F.col("hot")), "left")
    piece = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda c: c <= F.col("at"))))
    return joined.withColumns({"piece": piece, "cut": F.col("cuts").isNotNull()}).drop("hot", "cuts")


def _carried(rows: DataFrame, cuts: DataFrame | None, per_piece: Column, over_pieces, name: str) -> DataFrame:
    """rows with `name`: over_pieces of the per-piece aggregates of all earlier pieces of the artifact; null in the first."""
    if cuts is None:
        return rows.withColumn(name, F.lit(None).cast(rows.groupBy().agg(per_piece.alias("x")).schema["x"].dataType))
    each = rows.where("cut").groupBy("a", "piece").agg(per_piece.alias("x"))
    before = Window.partitionBy("a").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    known = each.select(F.col("a").alias("of"), F.col("piece").alias("nth"), over_pieces("x").over(before).alias(name))
    return rows.join(known, F.col("a").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("nth")), "left").drop("of", "nth")


def sums_before(rows: DataFrame, artifact: str, at: str, values: list[str], ties: tuple[str, ...] = (), most: int = MOST_ROWS) -> DataFrame:
    """rows with `<value>_before` for each of the values: its sum (long) over the rows of the artifact before this one.

    Rows stand in order of the number `at` and then of the columns `ties`, nulls first; rows that
    are equal in all of them stand in any order. A null value counts as 0.
    """
    named = rows.withColumnsRenamed({artifact: "a", at: "at"})
    cuts = _cuts(named, most)
    out = _pieced(named, cuts)
    by = Window.partitionBy("a", "piece").orderBy("at", *ties).rowsBetween(Window.unboundedPreceding, -1)
    for v in values:
        out = _carried(out, cuts, F.sum(v), F.sum, "carried")
        before = F.coalesce(F.sum(v).over(by), F.lit(0)) + F.coalesce("carried", F.lit(0))
        out = out.withColumn(f"{v}_before", before.cast("long")).drop("carried")
    return out.drop("piece", "cut").withColumnsRenamed({"a": artifact, "at": at})


def merged_regions(regions: DataFrame, artifact: str, start: str = "start", end: str = "end", most: int = MOST_ROWS) -> DataFrame:
    """Overlapping and touching regions of each artifact joined (gaps and islands)."""
    return _islands(*_slim(regions, artifact, start, end, most)).select(F.col("a").alias(artifact), F.col("at").alias(start), F.col("to").alias(end))


def _slim(regions: DataFrame, artifact: str, start: str, end: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    slim = regions.select(F.col(artifact).alias("a"), F.col(start).alias("at"), F.col(end).alias("to")).where("at IS NOT NULL AND to IS NOT NULL")
    return slim, _cuts(slim, most)


def _islands(slim: DataFrame, cuts: DataFrame | None) -> DataFrame:
    rows = _pieced(slim.groupBy("a", "at").agg(F.max("to").alias("to")), cuts)
    by = Window.partitionBy("a", "piece").orderBy("at")
    known = _carried(rows, cuts, F.max("to"), F.max, "carried")
    reach = F.greatest(F.max("to").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    opened = known.withColumn("reach", reach).withColumn("opens", F.when(F.col("reach").isNull() | (F.col("at") > F.col("reach")), F.col("at")))
    # A row belongs to the island that opened last: in its piece, or in a piece before.
    held = _carried(opened, cuts, F.max("opens"), F.max, "last_opened")
    island = F.coalesce(F.max("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.col("last_opened"))
    return held.withColumn("island", island).groupBy("a", "island").agg(F.max("to").alias("to")).select("a", F.col("island").alias("at"), "to")


def gaps(regions: DataFrame, artifact: str, start: str = "start", end: str = "end", most: int = MOST_ROWS) -> DataFrame:
    """What lies between the islands of each artifact: (artifact, start, end), the complement within its first start and last end."""
    slim, cuts = _slim(regions, artifact, start, end, most)
    rows = _carried(_pieced(_islands(slim, cuts), cuts), cuts, F.max("to"), F.max, "carried")
    by = Window.partitionBy("a", "piece").orderBy("at")
    before = F.coalesce(F.lag("to").over(by), F.col("carried"))
    return rows.withColumn("before", before).where("before IS NOT NULL").select(F.col("a").alias(artifact), F.col("before").alias(start), F.col("at").alias(end))


def translated(offsets: DataFrame, changes: DataFrame, artifact: str, at: str, end: str, delta: str, to: str = "moved", most: int = MOST_ROWS) -> DataFrame:
    """offsets with `to`: the position `at` after changes (artifact, end, delta) of the same artifact that end at or before it.

    Each distinct position is placed among the changes once, by a running sum in order of
    position; no pair of an offset and a change is ever made. Offsets of artifacts without
    changes stay where they are; a null position has a null result.
    """
    steps = changes.select(F.col(artifact).alias("a"), F.col(end).alias("at"), F.col(delta).alias("d")).where("at IS NOT NULL").groupBy("a", "at").agg(F.sum("d").alias("d"))
    places = offsets.select(F.col(artifact).alias("a"), F.col(at).alias("at")).where("at IS NOT NULL").distinct()
    events = places.select("a", "at", F.lit(0).cast("long").alias("d"), F.lit(True).alias("asked")).unionAll(steps.select("a", "at", F.col("d").cast("long").alias("d"), F.lit(False).alias("asked")))
    cuts = _cuts(events, most)
    rows = _carried(_pieced(events, cuts), cuts, F.sum("d"), F.sum, "carried")
    by = Window.partitionBy("a", "piece").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    shift = F.sum("d").over(by) + F.coalesce("carried", F.lit(0))
    shares = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    placed = rows.withColumn("shift", shift).where("asked").select(F.col("a").alias("__a"), F.col("at").alias("__at"), F.col("shift").alias("__shift"), shares.alias("__share"))
    # A position that a third of the offsets hold goes back to SALTS shares of them.
    dealt = offsets.withColumn("__salt", F.pmod(F.xxhash64(*offsets.columns), F.lit(SALTS)).cast("int"))
    met = dealt.join(placed, dealt[artifact].eqNullSafe(placed["__a"]) & (dealt[at] == placed["__at"]) & (dealt["__salt"] == placed["__share"]), "left")
    return met.select(*[dealt[c] for c in offsets.columns], (dealt[at] + F.col("__shift")).alias(to))
