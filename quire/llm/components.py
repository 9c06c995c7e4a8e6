"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_since, few_files, mark, spill


def components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected -> (node, component): the smallest node that each node can reach.

    Each round takes the smallest label among a node's neighbours, then that label's own label;
    rounds end when nothing changes. Sums over neighbours are partial before they move, and hot
    labels are split by adaptive skew handling. Tables are written between rounds. Self-loops,
    repeated edges and an empty table are fine; edges with a null end are left out.
    """
    began = mark()
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = spill(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    files = few_files(both.count(), 1_000_000)
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = spill(labels, "cc-labels", files)
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "n2", "label": "l2"}), F.col("b") == F.col("n2")).groupBy("a").agg(F.min("l2").alias("l2"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("l2", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("jl"))
        step = step.join(jump, F.col("label") == F.col("j"), "left").select("node", "was", F.least("label", F.coalesce("jl", "label")).alias("label"))
        step = spill(step, "cc-labels", files)
        drop_since(edges.sparkSession, began, both, step)
        if step.where("label <> was").isEmpty():
            drop_since(edges.sparkSession, began, step)
            return step.select("node", F.col("label").alias("component"))
        labels = step.select("node", "label")
