"""Connected components of a graph given as edges, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, drop, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each end of edges (u, v), label being the smallest node that it reaches.

    Each round takes the smallest label among neighbours, then the label's own label, so a path of n nodes needs about
    log2(n) rounds. Labels are cut to the shared folder in each round: both sides of each join are then plain exchanges, which
    adaptive execution can split where one node has very many edges. Without edges the result is empty.
    """
    both = cut(edges.where("u <> v").selectExpr("inline(array(struct(u, v), struct(v as u, u as v)))").distinct())
    labels, old = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:  # labels only fall, so it ends
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.least("label", "near").alias("_l"), F.col("label").alias("_old"))
        own, half_way = written(new)
        step = own.join(own.select(F.col("node").alias("_l"), F.col("_l").alias("_up")), "_l", "left")
        new, path = written(step.select("node", F.least("_l", "_up").alias("label"), "_old"))
        labels = new.select("node", "label")
        drop(edges.sparkSession, [old, half_way])
        old = path
        if new.where("label <> _old").isEmpty():
            return labels
