"""New files into two tables, accepted and rejected, each file once.

A batch of the stream overwrites its own folder `batch=<id>` in both tables, so a batch that is
repeated after a failure replaces what it wrote. Of files with the same bytes the first one is
kept: within a batch that of the smallest id, across batches that of the earlier batch; others
are rejected with its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burin.sources.artifacts import stream_files

# Fixed value: what a file of no known kind is told.
UNKNOWN = "No reconocemos este tipo de archivo todavía"
EMPTY, REPEATED = "empty", "repeated"
KNOWN = "hash string, id string, batch long"


def judged(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (id, name, kind, size, bytes) with hash, reason (null: accepted) and first, the id of the file with the same bytes.

    known: (hash, id) of files accepted before. Only ids and hashes meet, bytes are never grouped:
    a third of all files may be copies of one.
    """
    hashed = files.withColumn("hash", F.sha2("bytes", 256))
    wanted = hashed.where("kind <> 'unknown' AND size > 0")
    here = wanted.groupBy("hash").agg(F.min("id").alias("here"))
    before = known.groupBy(F.col("hash").alias("h")).agg(F.min("id").alias("before"))
    firsts = here.join(before, here["hash"] == before["h"], "left").select("hash", F.coalesce("before", "here").alias("first"), F.col("before").isNotNull().alias("known"))
    out = hashed.join(firsts, "hash", "left")
    reason = F.when(F.col("size") == 0, EMPTY).when(F.col("kind") == "unknown", UNKNOWN).when(F.col("known") | (F.col("first") != F.col("id")), REPEATED)
    return out.select("id", "name", "kind", "size", "bytes", "hash", reason.alias("reason"), F.when(reason == REPEATED, F.col("first")).alias("first"))


def take_batch(files: DataFrame, batch: int, accepted: str, rejected: str) -> None:
    """Write one batch into both tables, over what the same batch wrote before."""
    spark = files.sparkSession
    files = files.persist()  # one reading of the batch for both tables
    try:
        known = _table(spark, accepted).where(F.col("batch") < batch)
        rows = judged(files, known)
        rows.where("reason IS NULL").drop("reason", "first").write.mode("overwrite").parquet(f"{accepted}/batch={batch}")
        rows.where("reason IS NOT NULL").drop("bytes").write.mode("overwrite").parquet(f"{rejected}/batch={batch}")
    finally:
        files.unpersist()


def _table(spark: SparkSession, path: str) -> DataFrame:
    """(hash, id, batch) of a table that may not be there yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(hadoop) or not store.listStatus(hadoop):
        return spark.createDataFrame([], KNOWN)
    return spark.read.schema(KNOWN).parquet(path)


def start(spark: SparkSession, source: str, accepted: str, rejected: str, checkpoint: str, pattern: str = "*"):
    """Take what is new under a path and end; returns the stream's query. Started again, it goes on where it ended."""
    files = stream_files(spark, source, pattern)
    return files.writeStream.foreachBatch(lambda df, n: take_batch(df, n, accepted, rejected)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
