"""Connected components by repeated minimum of the neighbours' labels, with pointer jumping and reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.runtime import cut, discard


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of each component, for every node that has an edge.

    Edges may be given in either direction, repeatedly, and as loops. No component is gathered in one place: labels travel
    along the edges, and each round also follows the label's own label, so that rounds grow with the logarithm of a chain's length.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    both = cut(pairs.unionAll(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    written = labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("component")))
    while True:  # a label only ever falls, so this ends
        offered = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("component").alias("offer"))
        step = labels.join(offered, labels.node == offered.x, "left").select("node", "component", F.least("component", F.coalesce("offer", "component")).alias("next"))
        jump = labels.select(F.col("node").alias("j"), F.col("component").alias("further"))
        jumped = step.join(jump, step.next == jump.j, "left").select("node", "component", F.least("next", F.coalesce("further", "next")).alias("next"))
        before, done = written, cut(jumped)
        discard(before)
        written = done
        labels = done.select("node", F.col("next").alias("component"))
        if done.where("component <> next").isEmpty():
            return labels
