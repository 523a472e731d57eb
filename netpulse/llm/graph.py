"""Connected components as DataFrame joins: smallest label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpulse.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id reachable, for every node of ``edges`` (a, b).

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, so a path's length falls by a factor in each round; a star, as copies form, needs two.
    Links, labels and messages stay distributed; each round's labels are written to the shared
    checkpoint folder, which cuts the lineage.
    """
    both = edges.where("a <> b").select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = materialize(step.join(jump, "label").select("node", "was", F.least("label", "next").alias("label")))
        labels = step.select("node", "label")
        if step.where("label < was").isEmpty():
            return labels.withColumnRenamed("label", "component")
