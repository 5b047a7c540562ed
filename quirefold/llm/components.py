"""Connected components of an edge table, as Spark rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, label): label is the smallest node reachable. Nodes without edges do not appear.

    Each round takes the least label among a node's neighbours and then the label of that label, so long chains are
    followed in few rounds. Labels are summed up before each shuffle; a hub's edges may be many (a skewed join, which
    Spark splits). Every round starts from a written table. Without edges the result is empty.
    """
    pairs = edges.where("a <> b").select("a", "b")
    both = cut(pairs.union(pairs.select("b", "a")).distinct().toDF("node", "near"), "edges")
    labels = cut(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    for _ in range(most_rounds):
        around = both.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("label").alias("other"))
        step = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        step = cut(step, "step")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = cut(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
