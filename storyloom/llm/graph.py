"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for each end of edges(a, b): label is the smallest node of its component.

    Rounds of: the smallest label among the neighbours; the old root takes it too, so that trees join; two jumps to the
    label's label. Each round's labels are written. A round's hot keys are labels of large components, which meet in
    plain joins that AQE can split, or in sums that are combined before the shuffle.
    """
    both = scratch.write("edges-both", edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels, name, k = scratch.write("labels-0", both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))), "labels-0", 0
    while True:
        k += 1
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        told = met.select("node", "new").union(met.where("new < label").select(F.col("label").alias("node"), "new"))
        step = scratch.write(f"step-{k}", told.groupBy("node").agg(F.min("new").alias("label")))
        jump = lambda a, b: a.join(b.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.col("next").alias("label"))
        after = scratch.write(f"labels-{k}", jump(jump(step, step), step))
        changed = after.join(labels.withColumnRenamed("label", "before"), "node").where("label <> before").limit(1).count()
        scratch.drop(f"step-{k}", name)
        labels, name = after, f"labels-{k}"
        if not changed:
            scratch.drop("edges-both")
            return labels
