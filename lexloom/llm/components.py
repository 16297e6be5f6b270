"""Connected components of an edge table, by repeated minima and pointer jumping over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs: a row (node, component) for each node, component being the smallest node reachable.

    Each round gives a node the least label among its neighbours' and its own, then the label of that label; rounds end
    when no label changes. Only a count reaches the driver. Loops, repeated edges and null ends are harmless.
    """
    whole = edges.where("a <> b").select("a", "b")
    both = materialise(whole.union(whole.select("b", "a")).distinct().toDF("node", "other"), "edges")
    labels = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        now = materialise(near.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        if not now.where("component <> was").limit(1).count():
            return now.select("node", "component")
        labels = now.select("node", "component")
