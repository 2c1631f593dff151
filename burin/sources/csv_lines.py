"""CSV files larger than a task: byte ranges are read side by side, although a quote anywhere toggles quoting.

Spark's text source cuts a file into blocks of lines. Whether a line break ends a row depends on
all quotes before it, so each block is counted for both cases, an even and an odd number of
quotes before it; a running parity over the blocks of a file (one row a block) tells which case
holds and how many rows came before. Only then are lines put together to rows, by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cells(row: Column) -> Column:
    """Cells of one row: commas outside quotes part them, quotes go, a doubled quote inside quotes is one, \\r outside quotes goes."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), row), F.lit(r'\G,((?:[^",]++|"[^"]*+(?:"|\z))*+)'), F.lit(1))
    # A piece in quotes without its closing quote runs to the end of the text and has no other mark to drop.
    unquoted = lambda p: F.when(F.startswith(p, F.lit('"')), F.regexp_replace(F.regexp_extract(p, r'\A"((?:[^"]++|"")*+)', 1), '""', '"')).when(F.startswith(p, F.lit("\r")), F.lit("")).otherwise(p)
    plain = lambda c: F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r'[^"\r]++|\r++|"(?:[^"]++|"")*+"?'), F.lit(0)), unquoted), "")
    return F.transform(parts, lambda c: F.when(c.rlike(r'["\r]'), plain(c)).otherwise(c))


def read_rows(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, row, cells) of the CSV files under a path, rows numbered from 0 in each file.

    Rows may be ragged, a blank line is one empty cell, a line break at the end of a file adds
    no row and belongs to no cell. A quote that is never closed makes the rest of its file one
    row. Bytes that are no UTF-8 become U+FFFD. Empty files have no rows. Blocks are as large as
    spark.sql.files.maxPartitionBytes; a compressed file is one block.
    """
    lines = (
        spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.make_valid_utf8("value").alias("line"))
    )
    quotes = F.length(F.regexp_replace("line", '[^"]++', "")) % 2
    in_block = Window.partitionBy("path", "block").orderBy("n")
    before = F.coalesce(F.sum(quotes).over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    counted = lines.withColumns({"odd": before, "quotes": quotes})
    # For each block: its parity, and the rows that open in it after an even and after an odd number of quotes.
    blocks = counted.groupBy("path", "block").agg((F.sum("quotes") % 2).alias("parity"), F.count_if(F.col("odd") == 0).alias("even_rows"), F.count_if(F.col("odd") == 1).alias("odd_rows"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entered = blocks.withColumn("entry", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    opened = F.when(F.col("entry") == 0, F.col("even_rows")).otherwise(F.col("odd_rows"))
    known = entered.withColumn("rows_before", F.coalesce(F.sum(opened).over(earlier), F.lit(0))).select("path", "block", "entry", "rows_before")
    opens = F.when(F.col("odd") == F.col("entry"), 1).otherwise(0)
    number = F.col("rows_before") + F.sum(opens).over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - 1
    numbered = counted.join(known, ["path", "block"]).withColumn("row", number)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "line"))), lambda p: p["line"])
    return numbered.groupBy("path", "row").agg(F.array_join(parts, "\n").alias("text")).select("path", "row", cells(F.col("text")).alias("cells"))
