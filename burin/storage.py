"""Tables in the folder that the driver and all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dir: dict[str, str] = {}
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a temporary one where none is set and all runs in this process.

    On a cluster without that setting this raises: no other folder is known to be shared.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found and (current := sc._jsc.sc().getCheckpointDir()).isDefined():
        found = current.get()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local_dir.setdefault(sc.applicationId, "")
        if not found:
            found = _local_dir[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="burin-")
    return found


def folder(spark: SparkSession, keep: bool = False) -> str:
    """A new path in the shared folder; what is written there goes at the end of the enclosing scratch() or application."""
    path = f"{shared_dir(spark).rstrip('/')}/burin-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    written = sc._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(written)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return path


def persisted(df: DataFrame, keep: bool = False) -> DataFrame:
    """df cut from its lineage by a Parquet table in the shared folder.

    Every executor can read it again after losses; columns and row groups are
    pruned as in any table, which checkpoint() files are not. The table goes at the end of
    the enclosing scratch(), if it is not to be kept, and else when the application ends.
    """
    path = folder(df.sparkSession, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside, but for those to be kept, are deleted at the end."""
    _scratch.append([])
    try:
        yield
    finally:
        sc = spark.sparkContext
        for path in _scratch.pop():
            written = sc._jvm.org.apache.hadoop.fs.Path(path)
            written.getFileSystem(sc._jsc.hadoopConfiguration()).delete(written, True)
