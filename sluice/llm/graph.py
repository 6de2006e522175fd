"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v); label is the component's least node.

    In each round every node points to its least neighbour or itself, pointers are
    followed to their ends, three times as far with each step, and the edges are drawn anew
    between what they lead to: long chains take few rounds.
    Sums per node are combined before the shuffle and large joins are split by
    adaptive execution, so a hub with most of the edges isn't one task's work.
    Nothing goes to the driver but whether edges are left.
    """
    left = settled(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = settled(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("to")))
        while True:
            on, after = (to.select(F.col("node").alias(a), F.col("to").alias(b)) for a, b in (("to", "next"), ("next", "last")))
            jumped = settled(to.join(on, "to").join(after, "next").select("node", F.col("last").alias("to"), (F.col("last") != F.col("to")).alias("moved")))
            to = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = to.select("node", F.col("to").alias("label"))
        else:
            step = to.select(F.col("node").alias("label"), F.col("to").alias("next"))
            labels = settled(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        a = to.select(F.col("node").alias("u"), F.col("to").alias("a"))
        b = to.select(F.col("node").alias("v"), F.col("to").alias("b"))
        left = settled(
            left.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        )
    if labels is None:
        kind = left.schema["u"].dataType.simpleString()
        return left.select(F.col("u").alias("node"), F.col("v").cast(kind).alias("label"))
    return labels
