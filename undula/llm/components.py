"""Connected components of a table of links, by hash joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (a, b) reach, for each node that has any.

    Labels spread to neighbours and jump to their label's label until none changes, so
    rounds grow with the logarithm of a chain's length. Each round is written; nothing
    is collected. A node that very many links end at is a skewed key of joins whose other
    side has one row for it: adaptive execution splits it, and minima are taken partly
    before rows move. Repeated links count once; links of a node with itself or with
    null don't count; an empty table gives no rows; other columns are ignored.
    """
    both = scratch.table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label"))
    labels = scratch.table(labels, "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        spread = scratch.table(spread, "spread")
        roots = spread.select(F.col("node").alias("root"), F.col("label").alias("next"))
        jumped = scratch.table(spread.join(roots, F.col("label") == F.col("root")).select("node", "old", F.least("label", "next").alias("label")), "labels")
        changed = not jumped.where("label <> old").isEmpty()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
