"""Removal that follows references: entries of a manifest without a file, and all that refers to what goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burin.storage import persisted


def present(manifest: DataFrame, files: DataFrame, package: str, path: str, root: str = "/") -> DataFrame:
    """Rows of a manifest whose path is a file of the same package, and the root's row. Null packages are no package; a null path is no file."""
    kept = files.select(F.col(package).alias("__p"), F.col(path).alias("__f")).distinct()
    own = manifest.where(F.col(path) != root).join(kept, (F.col(package) == F.col("__p")) & (F.col(path) == F.col("__f")), "left_semi")
    return manifest.where(F.col(path) == root).unionAll(own)


def reached(edges: DataFrame, roots: DataFrame, source: str = "source", target: str = "target", node: str = "node") -> DataFrame:
    """(node, depth) of all nodes that the roots lead to, themselves included, with the fewest steps.

    Each round joins only the nodes that are new to the edges and drops those known before;
    rounds end with the longest shortest way. Every round's nodes are a table in the shared
    folder, so a lost executor repeats a round at most; the driver sees one count a round. A
    target that many edges share becomes one row before the next shuffle. Null nodes are none;
    cycles, loops and repeated edges change nothing.
    """
    slim = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s IS NOT NULL AND t IS NOT NULL AND s <> t").distinct()
    held = persisted(slim)
    new = persisted(roots.select(F.col(node).alias("n")).where("n IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    rounds = [new]
    known = new
    while True:
        depth = len(rounds)
        found = held.join(new.withColumnRenamed("n", "s"), "s").select(F.col("t").alias("n")).distinct().join(known.select("n"), "n", "left_anti").withColumn("depth", F.lit(depth))
        new = persisted(found)
        if not new.limit(1).count():
            break
        rounds.append(new)
        known = known.unionAll(new)
        if depth % 16 == 0:  # many small tables become one
            known = persisted(known)
    return known.select(F.col("n").alias(node), "depth")


def removed_in_chain(items: DataFrame, gone: DataFrame, package: str, key: str, refers_to: str) -> DataFrame:
    """(package, key, depth) of the items of each package that go: those of `gone`, and, in chain, those that refer to one that goes.

    items: package, key, refers_to (null for none). A package's key is a node of its own, so
    equal keys of two packages have nothing to do with each other.
    """
    node = lambda p, k: F.struct(p.alias("p"), k.alias("k"))
    known = F.col(package).isNotNull() & F.col(key).isNotNull()
    edges = items.where(known & F.col(refers_to).isNotNull()).select(node(F.col(package), F.col(refers_to)).alias("source"), node(F.col(package), F.col(key)).alias("target"))
    roots = gone.where(known).select(node(F.col(package), F.col(key)).alias("node"))
    return reached(edges, roots).select(F.col("node.p").alias(package), F.col("node.k").alias(key), "depth")
