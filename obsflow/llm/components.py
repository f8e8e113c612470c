"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's smallest node.

    Each round takes the smallest label among neighbours, and then the label's
    own label, so chains shrink by powers of two. Labels and links stay in
    Spark; only the number of changes comes to the driver. No links give no rows.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        known = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        lower = stage(lower.join(known, "root").select("node", F.least("root", "further").alias("root"), "old"), "labels")
        changed = lower.where("root != old").limit(1).count()
        labels = lower.select("node", "root")
        if not changed:
            return labels
