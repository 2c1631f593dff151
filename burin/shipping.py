"""Gets this package onto the executors of a running session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to every Python worker, once an application.

    Workers then import it whatever their working folder or PYTHONPATH is.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="burin-src-"), f"{root.name}-{os.getpid()}.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent).as_posix())
        sc.addPyFile(os.path.realpath(target))
        _shipped.add(sc.applicationId)
    return spark
