"""Connected components by contraction: every node moves to its smallest neighbour until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of `edges(a, b)`: nodes are connected when their labels agree.

    A round takes the smallest neighbour of every node, follows it twice more, and renames both ends of
    every edge; the label is the smallest node of the component. Node numbers should be hashes, so that
    the number of rounds grows with the logarithm of the component size. Each round is stored, which
    cuts lineage; every shuffle moves rows of two numbers, and the minimum is taken before shuffling.
    """
    left = stored(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), name)
    labels = None
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p"))
        for _ in range(2):
            upper = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(upper, "p").select("node", F.col("pp").alias("p"))
        parent = stored(parent, name)
        if labels is None:
            labels = parent.withColumnRenamed("p", "label")
        else:
            to = parent.select(F.col("node").alias("label"), "p")
            labels = labels.join(to, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        labels = stored(labels, name)
        for end in ("a", "b"):
            left = left.join(parent.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("p", end)
        left = stored(left.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), name)
    if labels is None:
        labels = left.selectExpr("a node", "b label")
    return labels
