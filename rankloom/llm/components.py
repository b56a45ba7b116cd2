"""Connected components of an edge list, as Spark joins with a written table after every step.

Every round gives each node the smallest of its label, its neighbours' labels and the label of its label, so chains
shorten by half a round. All joins are between written tables with a small aggregate in between: a node with very
many edges is combined before the shuffle, and adaptive execution can split its side of a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has two long columns a, b. Result: node, component (the smallest node reachable), for nodes with edges.

    Null ends and loops are ignored, repeated edges count once; no edges give no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    few = 4 * edges.sparkSession.sparkContext.defaultParallelism  # files of a step; a row is two or three numbers
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", parts=few)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels", parts=few)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        new = labels.select("node", "label").join(onward, "label").join(near, F.col("node") == F.col("a"))
        new = cut(new.select("node", F.least("label", "onward", "near").alias("label"), F.col("label").alias("old")), "labels", parts=few)
        if not new.where("label <> old").take(1):
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
