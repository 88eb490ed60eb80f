"""Connected components of a graph in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import durable, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each end of the edges (a, b): label is the least node of its component.

    Each round takes the least label of the neighbours and then follows the label's
    own label, so the rounds grow with the logarithm of the diameter. Minima are
    combined before the shuffle, and Spark splits joins at hubs. Each round is
    written to the shared folder. Nothing but one count per round reaches the driver.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = hooked.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label")
        after = durable(jumped.select("node", "old", F.least("label", "further").alias("label")), "labels")
        release(labels)
        labels = after
        if after.where("old <> label").isEmpty():
            release(both)
            return labels.select("node", "label")
