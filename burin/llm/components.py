"""Connected components of links between ids, by distributed label propagation.

Each round every node takes the smallest label among its own, its neighbours' and its
label's label; labels are written to the shared folder after each round. Nothing but
one number a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burin.llm.common import persisted


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b); the label is the smallest node of its component.

    Null ids are not nodes; loops and repeated links change nothing.
    """
    some = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    pairs = some.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = persisted(pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").dropDuplicates())
    labels = persisted(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        hooked = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        far = labels.select(F.col("u").alias("label"), F.col("label").alias("far"))
        jumped = persisted(hooked.join(far, "label", "left").select("u", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        changed = jumped.where("old <> label").limit(1).count()
        labels = jumped.select("u", "label")
        if not changed:
            return labels.select(F.col("u").alias("node"), "label")
