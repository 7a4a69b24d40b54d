"""Connected components of an edge table, in Spark alone.

Every node takes the smallest label among itself and its neighbours, then the
label of that label; rounds go on until no label changes. Nothing is gathered:
minima are aggregated before the exchange, and a node with very many links only
makes one side of a join skewed, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes in ``edges`` (a, b): label is the smallest node reachable.

    Null ends and self links are left out; repeated edges count once; no edges give no rows.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = C.written(e.union(e.select("b", "a")).distinct())
    labels = C.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:  # labels only fall, so this ends
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        step = C.written(step)
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = C.written(step.join(up, "label").select("node", F.least("label", "up").alias("label"), "was"))
        labels = step.select("node", "label")
        if not step.where("label <> was").limit(1).count():
            return labels
