"""Page algebra: page lists as arrays, documents as a relation (doc_id, page_no)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burin.functions.text import js_trim

#: The widest range of pages that a list may name.
WIDEST = 100_000


def up_to(n: Column) -> Column:
    """1 .. n; empty for nothing positive."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def parse_page_list(text: Column) -> Column:
    """`2,5-7` as [2, 5, 6, 7]: order and repeats stay, what is no page or range goes."""
    pattern = r"^(\d+)\s*-\s*(\d+)$"

    def pages(raw: Column) -> Column:
        token = js_trim(raw)
        a, b = F.regexp_extract(token, pattern, 1).try_cast("int"), F.regexp_extract(token, pattern, 2).try_cast("int")
        none = F.array().cast("array<int>")
        return F.when(a.isNotNull() & b.isNotNull() & (b >= a) & (b - a <= WIDEST), F.sequence(a, F.greatest(a, b))).when(token.rlike(r"^\d+$") & (token.try_cast("int") >= 1), F.array(token.try_cast("int"))).otherwise(none)

    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), ","), pages))


def in_range(pages: Column, total: Column) -> Column:
    return F.filter(pages, lambda p: (p >= 1) & (p <= total))


def complete_order(order: Column, total: Column) -> Column:
    """The named pages once each, then the others ascending."""
    named = F.array_distinct(in_range(order, total))
    return F.concat(named, F.array_except(up_to(total), named))


def preset_pages(preset: Column, total: Column) -> Column:
    return F.filter(up_to(total), lambda p: F.when(preset == "pares", p % 2 == 0).when(preset == "impares", p % 2 == 1).otherwise(True))


def move_in_order(order: Column, source: Column, target: Column) -> Column:
    """The item at `source` (from 0) moved to `target`; unchanged if either is outside."""
    n = F.size(order)
    rest = F.concat(F.slice(order, F.lit(1), source), F.slice(order, source + 2, F.greatest(n - source - 1, F.lit(0))))
    moved = F.concat(F.slice(rest, F.lit(1), target), F.array(F.element_at(order, source + 1)), F.slice(rest, target + 1, F.greatest(n - 1 - target, F.lit(0))))
    valid = (source >= 0) & (source < n) & (target >= 0) & (target < n)
    return F.when(valid, moved).otherwise(order)


def all_selected(selected: Column, total: Column) -> Column:
    every = (F.size(selected) == total) & (F.size(F.array_distinct(selected)) == total) & F.forall(selected, lambda p: (p >= 1) & (p <= total))
    return F.when(total == 0, F.size(selected) == 0).otherwise(every)


def can_submit(kind: Column, selected: Column, total: Column) -> Column:
    return F.when(kind != "delete", selected > 0).otherwise((selected > 0) & (selected < total))


def split(pages: DataFrame, order: Column, doc: str = "doc_id", page: str = "page_no", dedupe: bool = True) -> DataFrame:
    """Rows of the pages that `order` (an array by row, constant within a document) names, with their new position.

    The visual selector dedupes; the text mode keeps repeats. Each page row finds its own
    positions, so nothing is shuffled.
    """
    named = F.array_distinct(order) if dedupe else order
    at = F.filter(F.transform(named, lambda p, i: F.struct((i + 1).cast("int").alias("pos"), p.alias("p"))), lambda s: s["p"] == F.col(page))
    return pages.withColumn("__at", F.explode(at)).withColumn("pos", F.col("__at.pos")).drop("__at")


def delete(pages: DataFrame, removed: Column, page: str = "page_no") -> DataFrame:
    """Pages that are not removed."""
    return pages.where(~F.array_contains(removed, F.col(page)))


def with_position(pages: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    return pages.withColumn("pos", F.row_number().over(Window.partitionBy(doc).orderBy(page)).cast("int"))


def merge(parts: DataFrame, target: str, file_order: str, page: str = "page_no") -> DataFrame:
    """Pages of several files of one target document, in file order, numbered anew."""
    by = Window.partitionBy(target).orderBy(file_order, page)
    return parts.withColumn("pos", F.row_number().over(by).cast("int"))
