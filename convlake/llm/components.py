"""Connected components of an edge table by minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.frames import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is the
    smallest node reachable. Each round takes the smallest label among the
    neighbours and then the label of the label, so rounds grow with the logarithm
    of a path's length; every round is written to the shared folder."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        near = (both.join(labels.withColumnsRenamed({"node": "other", "component": "seen"}), "other")
                .groupBy("node").agg(F.min("seen").alias("seen")))
        nearer = labels.join(near, "node").select("node", F.col("component").alias("was"),
                                                  F.least("component", "seen").alias("component"))
        up = nearer.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = stored(nearer.join(up, "component").select("node", "was", F.least("component", "up").alias("component")), "labels")
        labels = after.select("node", "component")
        if not after.filter("was <> component").limit(1).count():
            return labels
