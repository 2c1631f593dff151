"""Page tools on PDF bytes as columns: struct(result, error)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burin.functions import documents, pdf
from burin.functions.text import base_name, let
from burin.operators import pages as P
from burin.operators import ranges
from burin.operators.convert import _guarded
from burin.storage import persisted

RESULT = "result binary, error string"


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["result", "error"], dtype=object)


def page_count(content: Column) -> Column:
    """Pages of a file; null where it cannot be read."""

    @F.pandas_udf("int")
    def apply(data: pd.Series) -> pd.Series:
        return data.map(lambda b: _guarded(pdf.page_count)(b)[0]).astype("Int32")

    return apply(content)


def select_pages(content: Column, pages: Column) -> Column:
    """The named pages in their order: split, reorder."""

    @F.pandas_udf(RESULT)
    def apply(data: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        return _frame(_guarded(lambda b, w=w: pdf.with_pages(b, list(w)))(b) for b, w in zip(data, wanted, strict=True))

    return apply(content, pages)


def reordered_text(text: Column, order: Callable[[int], list[int]]) -> Column:
    """struct(pages, result, error): a text laid out as a file, its pages counted, put in the order that `order` has for their number, and read again.

    The files live one at a time in the worker that makes them: the same steps as columns would
    run a worker for each step beside the others, and hold a batch of files in each.
    """
    def turned(content: bytes) -> tuple[int, str]:
        pages = pdf.page_count(content)
        return pages, pdf.to_text(pdf.with_pages(content, order(pages)))

    make, turn = _guarded(documents.txt_to_pdf), _guarded(turned)

    def one(value: str | None) -> tuple[int | None, str | None, str | None]:
        content, error = make(value)
        found, error = (None, error) if error else turn(content)
        return (*(found or (None, None)), error)

    @F.pandas_udf("pages int, result string, error string")
    def apply(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(map(one, texts)), columns=["pages", "result", "error"], dtype=object)

    return apply(text)


def split_plan(total: Column, mode: Column, text: Column, pages: Column | None = None, output: Column | None = None) -> Column:
    """struct(pages, separate, suffix, error) of a split.

    With `pages` (the selector's: no repeats, pages that exist) `output` is unido or separado;
    else `mode` is rango (of the page list `text`), pares, impares or cada. `total` is used in
    lambdas, so a page_count() has to be a column of a written table, not of the same plan.
    """
    every, mode = P.up_to(total), F.coalesce(mode, F.lit("rango"))
    classic = F.when(mode == "cada", every).when(mode.isin("pares", "impares"), P.preset_pages(mode, total)).otherwise(P.in_range(P.parse_page_list(text), total))
    named = classic if pages is None else F.when(pages.isNotNull(), F.array_distinct(P.in_range(pages, total))).otherwise(classic)
    apart = mode == "cada"
    if pages is not None:
        chosen = F.coalesce(output, F.lit("unido")) if output is not None else F.lit("unido")
        apart = F.when(pages.isNotNull(), chosen == "separado").otherwise(apart)
        mode = F.when(pages.isNotNull(), F.lit("rango")).otherwise(mode)
    suffix = F.when(apart, "-paginas.zip").when(mode.isin("pares", "impares"), F.concat(F.lit("-"), mode, F.lit(".pdf"))).otherwise("-recortado.pdf")
    return let(named, lambda p: F.struct(p.alias("pages"), apart.alias("separate"), suffix.alias("suffix"), F.when(F.size(p) == 0, "Indica el rango de páginas").alias("error")))


def split(content: Column, name: Column, plan: Column) -> Column:
    """struct(file struct(result, error), name) of a split_plan(): one file, or a ZIP with a file for each page."""

    def one(data: bytes, pages: list[int], separate: bool) -> bytes:
        if not separate:
            return pdf.with_pages(data, pages)
        return documents._zip([(f"pagina-{p}.pdf", pdf.with_pages(data, [p])) for p in pages])

    @F.pandas_udf(RESULT)
    def apply(data: pd.Series, pages: pd.Series, separate: pd.Series) -> pd.DataFrame:
        return _frame(_guarded(lambda b, p=p, s=s: one(b, [int(x) for x in p], bool(s)))(b) for b, p, s in zip(data, pages, separate, strict=True))

    named = F.concat(base_name(name), plan["suffix"])
    return F.struct(apply(content, plan["pages"], plan["separate"]).alias("file"), named.alias("name"))


def delete_pages(content: Column, pages: Column) -> Column:
    @F.pandas_udf(RESULT)
    def apply(data: pd.Series, removed: pd.Series) -> pd.DataFrame:
        return _frame(_guarded(lambda b, r=r: pdf.without_pages(b, list(r)))(b) for b, r in zip(data, removed, strict=True))

    return apply(content, pages)


def compress(content: Column) -> Column:
    @F.pandas_udf(RESULT)
    def apply(data: pd.Series) -> pd.DataFrame:
        return _frame(map(_guarded(pdf.compressed), data))

    return apply(content)


def sign(content: Column, text: str = "Firmado", every: bool = True, position: str = "abajo") -> Column:
    @F.pandas_udf(RESULT)
    def apply(data: pd.Series) -> pd.DataFrame:
        return _frame(map(_guarded(lambda b: pdf.signed(b, text, every, position)), data))

    return apply(content)


#: Files under one node of a merged file's page tree; the last place that its table of objects can name.
NODE, LAST_PLACE = 1024, 9_999_999_999


def merge(files: DataFrame, target: str, order: str, content: str = "bytes", most: int = ranges.MOST_ROWS) -> DataFrame:
    """All pages of a target's files in one file, in pieces: (target, at, bytes, error).

    The pieces of a target by `at` are the whole file (sources.packages.save_pieces() writes them);
    no task holds more than one of its files, and 1,024 references for each node of its pages.
    Files stand in order of the number `order`, then of their digest. Object numbers, places in
    the file and its table of objects come from sums over the files before. A target with a
    broken or missing file, or with a result that the format cannot hold, is one row with an error
    that names the first such file. Files are parsed twice; sizes and renumbered objects are
    tables in the shared folder.
    """

    @F.pandas_udf("objects int, pages int, error string")
    def sized(data: pd.Series) -> pd.DataFrame:
        found = map(_guarded(pdf.piece_size), data)
        return pd.DataFrame([(*(size or (None, None)), error) for size, error in found], columns=["objects", "pages", "error"], dtype=object)

    @F.pandas_udf("body binary, starts array<int>")
    def renumbered(data: pd.Series, before: pd.Series, above: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pdf.piece(b, int(x), int(y)) for b, x, y in zip(data, before, above, strict=True)], columns=["body", "starts"])

    col = F.col
    given = files.select(col(target).alias("a"), col(order).alias("nth"), col(content).alias("content"), F.sha2(col(content), 256).alias("digest"), F.uuid().alias("uid"))
    known = persisted(given.withColumn("s", sized("content")).select("*", "s.*").drop("s"))
    small = known.select("a", "nth", "digest", "uid", "objects", "pages", "error", F.lit(1).alias("files"))
    placed = ranges.sums_before(small, "a", "nth", ["files", "objects"], ("digest", "uid"), most)
    named = F.concat(F.lit("Archivo "), (col("files_before") + 1).cast("string"), F.lit(": "), col("error"))
    totals = placed.groupBy("a").agg(F.sum("pages").alias("all_pages"), F.ceil(F.count("*") / NODE).cast("long").alias("nodes"), F.min_by(named, F.when(col("error").isNotNull(), col("files_before"))).alias("wrong"))
    good = totals.where("wrong IS NULL")
    renamed = good.select(col("a").alias("of"), "nodes")
    numbered = placed.join(renamed, placed["a"].eqNullSafe(renamed["of"])).select(
        "a", "uid", "pages", "nodes", "files_before", (col("objects_before") + col("nodes") + 2).alias("before"), F.expr(f"files_before div {NODE}").alias("node")
    )

    text = lambda *parts: F.encode(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), "ISO-8859-1")
    shown = lambda c: c.cast("string")
    refs = lambda numbers: F.array_join(F.transform(numbers, lambda n: F.concat(shown(n), F.lit(" 0 R"))), " ")
    root = text("1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n")
    above = text("2 0 obj\n<< /Type /Pages /Count ", shown(col("all_pages")), " /Kids [", refs(F.sequence(F.lit(3).cast("long"), col("nodes") + 2)), "] >>\nendobj\n")
    head = F.lit(bytearray(pdf.HEAD))
    heads = good.select("a", F.lit(0).cast("long").alias("place"), F.concat(head, root, above).alias("body"), F.array(F.octet_length(head), F.octet_length(F.concat(head, root))).alias("starts"))
    under = numbered.groupBy("a", "node").agg(F.sum("pages").alias("pages"), F.array_sort(F.collect_list(col("before") + 1)).alias("kids"))
    node = text(shown(col("node") + 3), " 0 obj\n<< /Type /Pages /Parent 2 0 R /Count ", shown(col("pages")), " /Kids [", refs(col("kids")), "] >>\nendobj\n")
    nodes = under.select("a", (col("node") + 1).alias("place"), node.alias("body"), F.array(F.lit(0)).alias("starts"))
    made = known.select("uid", "content").join(numbered, "uid").withColumn("p", renumbered("content", "before", col("node") + 3))
    bodies = made.select("a", (col("nodes") + col("files_before") + 1).alias("place"), "p.body", "p.starts")
    pieces = persisted(heads.unionByName(nodes).unionByName(bodies))

    sizes = pieces.select("a", "place", F.octet_length("body").cast("long").alias("size"), F.size("starts").cast("long").alias("entries"))
    ends = sizes.groupBy("a").agg(F.sum("size").alias("table_at"), (F.sum("entries") + 1).alias("entries"))
    first = text("xref\n0 ", shown(col("entries")), "\n0000000000 65535 f \n")
    ends = ends.withColumn("first", first).withColumn("rest_at", col("table_at") + F.octet_length("first")).where(col("table_at") <= LAST_PLACE)
    last = text("trailer\n<< /Size ", shown(col("entries")), " /Root 1 0 R >>\nstartxref\n", shown(col("table_at")), "\n%%EOF\n")
    frame = ends.select("a", F.explode(F.array(F.struct(col("table_at").alias("at"), col("first").alias("bytes")), F.struct((col("rest_at") + 20 * (col("entries") - 1)).alias("at"), last.alias("bytes")))).alias("f")).select("a", "f.*")
    whole = ends.select(col("a").alias("of"), "rest_at")
    before = ranges.sums_before(sizes, "a", "place", ["size", "entries"], (), most)
    spots = before.join(whole, before["a"].eqNullSafe(whole["of"])).select(col("of"), col("place").alias("in"), col("size_before").alias("at"), (col("rest_at") + 20 * col("entries_before")).alias("entry_at"))
    met = pieces.join(spots, pieces["a"].eqNullSafe(spots["of"]) & (pieces["place"] == spots["in"]))
    entry = F.transform("starts", lambda s: F.concat(F.lpad(shown(s + col("at")), 10, "0"), F.lit(" 00000 n \n")))
    both = F.array(F.struct("at", col("body").alias("bytes")), F.struct(col("entry_at").alias("at"), text(F.array_join(entry, "")).alias("bytes")))
    out = frame.unionByName(met.select("a", F.explode(both).alias("b")).select("a", "b.*"))
    too_long = sizes.groupBy("a").agg(F.sum("size").alias("size")).where(col("size") > LAST_PLACE).select("a", F.lit("El archivo resultante es demasiado grande").alias("error"))
    refused = totals.where("wrong IS NOT NULL").select("a", col("wrong").alias("error")).unionByName(too_long)
    rows = out.withColumn("error", F.lit(None).cast("string")).unionByName(refused, allowMissingColumns=True)
    return rows.select(col("a").alias(target), "at", "bytes", "error")


def piece_text(content: Column) -> Column:
    """Text of a file's pages in a piece of merge(); empty for pieces that hold no page."""

    @F.pandas_udf("string")
    def apply(data: pd.Series) -> pd.Series:
        return data.map(pdf.piece_text, na_action="ignore")

    return apply(content)
