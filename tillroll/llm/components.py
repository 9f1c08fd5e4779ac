"""Connected components of a distributed list of links."""

from pyspark.sql import functions as F

from tillroll.sources.scratch import written


def components(links, a="a", b="b"):
    """(node, label): the smallest node reachable from each linked node.

    Nodes take the smallest label among their neighbours, then the label of their
    label, until nothing changes; every round is a stored table. Links may repeat;
    nodes without links do not appear.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = written(both.union(both.select("other", "node")).distinct(), "links")
    labels = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label"))
    labels = written(labels, "labels")
    while True:
        seen = labels.withColumnsRenamed({"node": "other", "label": "seen"})
        nearest = both.join(seen, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        lower = labels.join(nearest, "node").select(
            "node", "label", F.least("label", "seen").alias("next")
        )
        lower = written(lower, "lower")
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        step = lower.join(jump, "next", "left").select(
            "node", "label", F.least("next", F.coalesce("far", "next")).alias("next")
        )
        step = written(step, "labels")
        if step.filter("next <> label").isEmpty():
            return labels
        labels = step.select("node", F.col("next").alias("label"))
