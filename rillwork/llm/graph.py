"""Connected components by least labels with pointer jumping, over edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns node, label for every node of an edge: the least node that it can reach.

    Each round takes the least label among a node's neighbours (summed before the shuffle, so a hub is no hot spot) and
    then follows the label once; every table is written to the shared folder, so rounds do not lengthen the lineage. A
    round halves the longest chain of labels, so the number of rounds grows with the logarithm of the largest component.
    """
    both = edges.select("u", "v").where("u <> v")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = materialize(step, "cc-step")
        if step.where("label <> was").isEmpty():
            return step.select("node", "label")  # no neighbour has a lesser label: all labels are final
        target = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = materialize(step.join(target, "label").select("node", F.least("label", "next").alias("label")), "cc-labels")
